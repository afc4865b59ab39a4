"""Main text of web pages: a linear-chain conditional random field over a page's leaf blocks.

A page is read into leaf blocks: the text between two block-level tags, with the tags, classes and
roles of its ancestors. Each block gets features of its ancestors and of its text; two labels (main
text or not) with weights per feature and per pair of neighbours make the field. Its weights are fit
on labelled pages by gradient ascent on the log-likelihood (forward-backward), and Viterbi finds the
best labels of a page. The fit runs on the driver over at most ``TRAIN_PAGES`` labelled pages, a
documented bound; the model is one small dictionary. Pages are then judged where they are, without a
shuffle, a bounded slice of an Arrow batch at a time.

Labelled pages are lists of (html, one label per block of ``blocks(html)``). ``labelled_pages`` makes
them from page plans in which each part knows what it is; a caller may pass pages of their own.

Text of a block: character references decoded, runs of white space one space, trimmed. Blocks that
are kept are joined in page order by one space. Scripts, styles, templates, comments and the head
are never text.

Defined cases: NULL or empty html gives an empty text, as does a page without a block that is kept;
text outside any tag is a block of its own; an unclosed tag ends with the page; a comment, script or
style that is never closed runs to the end of the page. Every row is judged alone, so repeated rows
and NULL ids are fine; columns besides those named are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planlens.llm.common import chunks

TRAIN_PAGES, SEED = 700, 11  # the pages a fit sees at most, and what they are drawn with
STEPS, RATE, DECAY = 160, 0.15, 1e-3  # of the fit
CHUNK_BYTES = 1 << 19
OUT = "page_id long, url string, text string, n_chars long"

BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
                  "textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = "script|style|template|noscript|head|iframe|svg|math|object|audio|video|canvas"  # what they hold is not the page's text
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"},
         "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<unseen>%s)(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=unseen)\s*>|\Z)"""
                 r"""|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>|<[!?/][^>]*>""" % UNSEEN, re.S | re.I)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


# ---------------------------------------------------------------- pages into blocks

class Block:
    """A leaf's text and the features that describe it."""

    __slots__ = ("text", "marks", "linked")

    def __init__(self, text: str, marks: tuple[str, ...], linked: float):
        self.text, self.marks, self.linked = text, marks, linked


def _marks(name: str, rest: str) -> tuple[str, ...]:
    """What an element adds to the features of all that stands in it."""
    out = ["in=" + name] if name in BLOCK else []
    for key, value in NAMED.findall(rest) if rest else ():
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            out += ["named=" + w.lower() for w in PARTS.findall(value)]
        elif key == "hidden" or value.replace(" ", "") in ("true", "display:none"):
            out.append("unseen")
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page that have text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], str]] = []  # open elements: name, marks of it and all above, nearest block
    open_ = Counter()
    text: list[str] = []
    linked = 0  # characters of this block inside links

    def flush() -> None:
        nonlocal linked
        said = " ".join(html.unescape("".join(text)).split())
        if said:
            marks, leaf = stack[-1][1:] if stack else ((), "none")
            out.append(Block(said, (*marks, "leaf=" + leaf), min(1.0, linked / len(said))))
        text.clear()
        linked = 0

    def leave(place: int) -> None:
        open_.subtract(n for n, _, _ in stack[place:])
        del stack[place:]

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            text.append(page[at:m.start()])
            linked += (m.start() - at) * (open_["a"] > 0)
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            text.append(" ")
        if m["end"]:
            if not open_[name]:
                continue
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name or (name not in BLOCK and stack[i][0] in BLOCK)), -1)
            if place >= 0 and stack[place][0] == name:
                leave(place)
            continue
        if name in BLOCK:  # a new block ends an open paragraph, and its like in the same list or table
            ends, holds = CLOSES.get(name, set()) | {"p"}, HOLDS.get(name, set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    leave(i)
                elif stack[i][0] in holds or (stack[i][0] in BLOCK and not holds):
                    break
        if name not in VOID:
            above, leaf = stack[-1][1:] if stack else ((), "none")
            stack.append((name, tuple(dict.fromkeys((*above, *_marks(name, m["rest"])))), name if name in BLOCK else leaf))
            open_[name] += 1
    text.append(page[at:])
    flush()
    return out


def _bucket(n: int) -> str:
    return str(min(8, n.bit_length()))


def features(page: list[Block]) -> list[list[str]]:
    """Names of what holds for each block: its ancestors, its text, its place."""
    out = []
    for i, b in enumerate(page):
        words = b.text.split(" ")
        f = ["bias", *b.marks, "words=" + _bucket(len(words)), "linked=" + str(int(b.linked * 4)), "place=" + str(4 * i // len(page))]
        f.append("ends=" + ("stop" if b.text[-1] in ".!?:;…\"”" else "open"))
        if "©" in b.text or "®" in b.text:
            f.append("mark=rights")
        if any(w in "|·»›" for w in words):
            f.append("mark=rule")
        if sum(c.isdigit() for c in b.text) * 4 > len(b.text):
            f.append("mark=digits")
        out.append(f)
    return out


# ---------------------------------------------------------------- the field

class Field:
    """Weights of a chain over two labels (0 other, 1 main text): per feature, per pair of neighbours."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        rows = [[self.names[x] for x in f if x in self.names] for f in feats]
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        out = np.zeros((len(rows), 2))
        np.add.at(out, at, self.emit[np.array([x for r in rows for x in r], np.int64)])
        return out

    def viterbi(self, emitted: np.ndarray) -> np.ndarray:
        """The best labels of one page."""
        n = len(emitted)
        back, best = np.zeros((n, 2), np.int8), emitted[0]
        for t in range(1, n):
            ways = best[:, None] + self.move
            back[t] = ways.argmax(axis=0)
            best = ways.max(axis=0) + emitted[t]
        out = np.zeros(n, np.int8)
        out[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def fit(pages: list[tuple[str, list[int]]], limit: int = TRAIN_PAGES, steps: int = STEPS) -> Field:
    """The field of greatest penalised likelihood on the first ``limit`` labelled pages."""
    data = [(features(bs), labels) for page, labels in pages[:limit] if (bs := blocks(page))]
    seen = Counter(x for feats, _ in data for f in feats for x in set(f))
    names = {x: i for i, x in enumerate(sorted(x for x, c in seen.items() if c >= 3))}
    longest, m = max(len(y) for _, y in data), len(data)
    block, feat, gold, there = [], [], np.zeros((m, longest), np.int64), np.zeros((m, longest), bool)
    for i, (feats, labels) in enumerate(data):
        if len(labels) != len(feats):
            raise ValueError("a labelled page needs a label for each of its blocks")
        gold[i, :len(labels)], there[i, :len(labels)] = labels, True
        for t, f in enumerate(feats):
            ids = [names[x] for x in f if x in names]
            block += [i * longest + t] * len(ids)
            feat += ids
    block, feat = np.array(block), np.array(feat)
    pairs = there[:, 1:]
    true_emit = np.zeros((len(names), 2))
    np.add.at(true_emit, (feat, gold.ravel()[block]), 1)
    true_move = np.zeros((2, 2))
    np.add.at(true_move, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    theta, first, second = np.zeros(2 * len(names) + 4), 0.0, 0.0
    total = there.sum()
    for step in range(1, steps + 1):
        emit, move = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        u = np.stack([np.bincount(block, emit[feat, y], m * longest) for y in (0, 1)], 1).reshape(m, longest, 2)
        alpha, beta = np.zeros_like(u), np.zeros_like(u)
        alpha[:, 0] = u[:, 0]
        for t in range(1, longest):
            on = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + u[:, t]
            alpha[:, t] = np.where(there[:, t, None], on, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            on = np.logaddexp.reduce(move[None] + (u[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(there[:, t + 1, None], on, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * there[..., None]
        both = np.exp(alpha[:, :-1, :, None] + move + (u + beta)[:, 1:, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        expected = np.stack([np.bincount(feat, p.reshape(-1, 2)[block, y], len(names)) for y in (0, 1)], 1)
        slope = np.concatenate([(true_emit - expected).ravel(), (true_move - both.sum(axis=(0, 1))).ravel()]) / total - DECAY * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope ** 2
        theta = theta + RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return Field(names, theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))


# ---------------------------------------------------------------- labelled pages

class _Page:
    """Writes a page part by part, with the label of each block it makes."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []
        self.stem = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiouéü") for _ in range(rng.randint(1, 4))) for _ in range(80)]

    def words(self, lo: int, hi: int) -> str:
        n = min(hi, max(lo, round(math.exp(self.rng.uniform(math.log(lo), math.log(hi))))))
        return " ".join(self.rng.choice(self.stem) for _ in range(n))

    def said(self, lo: int, hi: int) -> str:
        return self.words(lo, hi).capitalize() + self.rng.choice(["."] * 8 + ["!", "?", "", "&hellip;"])

    def block(self, tag: str, text: str, label: int, attrs: str = "", close: bool = True) -> None:
        self.html.append(f"<{tag}{attrs}>{text}" + (f"</{tag}>" if close else ""))
        self.labels.append(label)

    def raw(self, text: str) -> None:
        self.html.append(text)

    def wrapped(self, tag: str, attrs: str, inside) -> None:
        self.raw(f"<{tag}{attrs}>")
        inside()
        self.raw(f"</{tag}>")


NAMES = {"nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs toolbar skip pagination pager tabs",
         "header": "header masthead banner topbar branding logo", "footer": "footer bottom copyright colophon legal credits",
         "aside": "sidebar aside widget related recommended trending popular rail promo teaser toc tags",
         "notice": "notice cookie consent gdpr alert modal popup overlay banner message toast subscribe paywall",
         "ad": "ad ads advert advertisement sponsor sponsored adsbygoogle promo promotion banner", "form": "form search login signup newsletter subscribe contact",
         "share": "share social sharing buttons toolbar byline meta actions", "comments": "comments comment replies discussion disqus responses respond reply",
         "main": "content main article post entry story body text page"}
SEMANTIC = {"nav": ["nav", "div", "ul", "menu"], "header": ["header", "div"], "footer": ["footer", "div", "section"], "aside": ["aside", "div", "section"],
            "notice": ["div", "dialog", "section", "p", "aside"], "ad": ["div", "aside", "ins", "section"], "form": ["form", "div"], "share": ["div", "ul", "section"],
            "comments": ["section", "div", "aside", "ol"]}
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "notice": "alert", "form": "search"}


def _attrs(p: _Page, kind: str, bare: float) -> str:
    """A class or id that names the part, now and then a role, or nothing."""
    if p.rng.random() < bare:
        return ""
    words = p.rng.sample(NAMES[kind].split(), 2)
    value = p.rng.choice([words[0], f"{words[0]}-{p.rng.choice(p.stem)}", f"{p.rng.choice(p.stem)}_{words[0]}", f"{words[0]} {words[1]}", words[0].capitalize() + "Box"])
    role = f' role="{ROLES[kind]}"' if kind in ROLES and p.rng.random() < 0.15 else ""
    return f' {p.rng.choice(["class", "class", "id"])}="{value}"{role}'


def _other(p: _Page, kind: str) -> None:
    """A part that is not main text."""
    rng, tag = p.rng, p.rng.choice(SEMANTIC[kind])
    named = tag in ("nav", "header", "footer", "aside", "form", "menu", "dialog")
    attrs = _attrs(p, kind, 0.6 if named else 0.0)

    def line(lo: int, hi: int) -> None:
        p.block(rng.choice(["p", "div", "span", "h3", "h4", "li"]) if tag not in ("p", "ul", "ol", "menu") else "li" if tag != "p" else "span", p.said(lo, hi), 0)
        if p.html[-1].startswith("<span"):  # an inline element makes no block of its own
            p.html[-1] = f"<div>{p.html[-1]}</div>" if tag != "p" else p.html[-1]

    def links() -> None:
        listed = tag not in ("ul", "ol", "menu") and rng.random() < 0.7
        p.raw("<ul>" if listed else "")
        for _ in range(rng.randint(1, 8)):
            inner = f'<a href="/{rng.choice(p.stem)}">{p.words(1, 5)}</a>'
            p.block("li" if listed or tag in ("ul", "ol", "menu") else "div", inner, 0, close=rng.random() < 0.9)
        p.raw("</ul>" if listed else "")

    def inside() -> None:
        if tag == "p":
            p.raw(p.said(3, 30))
            p.labels.append(0)
        elif kind in ("nav", "share") or (kind in ("aside", "footer", "header") and rng.random() < 0.5):
            links()
        elif kind == "form":
            for _ in range(rng.randint(1, 3)):
                p.block(rng.choice(["div", "p", "button", "legend", "option"]), p.words(1, 8), 0)
        elif kind == "comments":
            for _ in range(rng.randint(1, 6)):
                p.wrapped(rng.choice(["div", "li", "article", "p"]) if tag != "ol" else "li", rng.choice(["", ' class="comment"', ' class="reply"']),
                          lambda: (p.raw(p.said(2, 60)), p.labels.append(0)))
        elif kind == "footer" and rng.random() < 0.7:
            p.block("div", f"{rng.choice(['&copy;', '&#169;', chr(169)])} {p.words(1, 4)} {rng.choice(['&middot;', '|', '-'])} {p.said(1, 12)}", 0)
        else:
            for _ in range(rng.randint(1, 3)):
                line(2, 40)
        if kind in ("header", "footer", "aside", "notice", "ad") and rng.random() < 0.2 and tag not in ("p", "ul", "ol"):
            p.block("p", p.said(2, 60), 0)

    if tag not in ("p", "ul", "ol", "menu") and kind in ("footer", "ad", "notice", "header") and rng.random() < 0.4:
        p.block(tag, f"{rng.choice(['', '', '&copy; '])}{p.said(1, 40)}", 0, attrs)  # text right in the part
    else:
        p.wrapped(tag, attrs, inside)


def _main(p: _Page) -> None:
    """The main text, with what may stand inside it."""
    rng = p.rng
    tag = rng.choice(["article"] * 5 + ["main", "main", "div", "div", "section", "td"])
    attrs = _attrs(p, "main", 0.6 if tag in ("article", "main") else 0.0)

    def inside() -> None:
        if rng.random() < 0.85:
            p.block(rng.choice(["h1", "h1", "h1", "h2"]), p.words(1, 14).capitalize() + rng.choice(["", "", "."]), 1)
        if rng.random() < 0.2:
            _other(p, "share")
        for _ in range(max(1, round(math.exp(rng.uniform(0, 3.2))))):
            kind, odd = rng.random(), rng.random()
            text = p.said(1, 150)
            if kind < 0.05:
                p.block(rng.choice(["h2", "h3", "h4"]), p.words(1, 8).capitalize(), 1)
            elif kind < 0.1:
                p.raw("<ul>")
                for _ in range(rng.randint(1, 5)):
                    p.block("li", p.said(1, 25), 1, close=rng.random() < 0.7)
                p.raw("</ul>")
            elif kind < 0.14:
                p.block(rng.choice(["blockquote", "pre", "figcaption", "dd", "div"]), text, 1)
            elif kind < 0.17:
                p.raw("<table>")
                for _ in range(rng.randint(1, 3)):
                    p.raw("<tr>")
                    for _ in range(rng.randint(1, 3)):
                        p.block("td", p.words(1, 4), 1)
                    p.raw("</tr>")
                p.raw("</table>")
            else:
                p.block("p", ("<b>" if odd < 0.2 else "") + text + ("<br>" if odd < 0.2 else ""), 1, close=odd > 0.15)
            if rng.random() < 0.05:
                _other(p, rng.choice(["ad", "aside", "share", "form", "notice"]))
        if rng.random() < 0.25:
            _other(p, rng.choice(["comments", "share", "aside", "form", "comments", "footer"]))

    if tag == "td":
        p.raw("<table><tr>")
    p.wrapped(tag, attrs, inside)
    if tag == "td":
        p.raw("</tr></table>")


def labelled_pages(count: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """Pages made of parts that know what they are: (html, a label for each of its blocks)."""
    out, rng = [], random.Random(seed)
    while len(out) < count:
        p = _Page(rng)
        p.raw(f"<!DOCTYPE html><html><head><title>{p.words(1, 9)}</title><style>p{{margin:0}}</style></head><body>")
        outer = rng.random() < 0.25
        p.raw('<div class="wrapper">' if outer else "")
        for kind in ("notice", "header", "nav", "form", "ad", "aside", "notice"):
            if rng.random() < (0.7 if kind in ("header", "nav") else 0.25):
                _other(p, kind)
        p.raw("<script>var a='</p>';</script>" if rng.random() < 0.5 else "")
        if rng.random() < 0.96:
            _main(p)
        for kind in ("share", "comments", "form", "aside", "ad", "nav", "footer", "notice"):
            if rng.random() < (0.75 if kind == "footer" else 0.25):
                _other(p, kind)
        p.raw("</div>" if outer else "")
        p.raw("</body></html>" if rng.random() < 0.9 else "")
        page = "".join(p.html)
        if len(blocks(page)) == len(p.labels):
            out.append((page, p.labels))
    return out


# ---------------------------------------------------------------- pages in Spark

def main_text(page: str | None, field: Field) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b.text for b, kept in zip(found, field.viterbi(field.scores(features(found)))) if kept)


def _extract(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html", CHUNK_BYTES):
            texts = [main_text(h, field) for h in part.column("html").to_pylist()]
            yield pa.record_batch({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()),
                                   "n_chars": pa.array([len(t) for t in texts], pa.int64())})
    return run


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract(field or fit(labelled_pages())), OUT)
