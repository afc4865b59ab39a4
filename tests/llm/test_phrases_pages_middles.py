"""Collocations, main text of pages, and fill-in-the-middle against plain Python."""

from __future__ import annotations

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlens.llm import collocations, fill_in_middle, html_text

ODD = [(1, None), (2, ""), (3, "a"), (4, "a\nb"), (5, "\n\n"), (6, "x<P>y\nz"), (None, "q\nw\ne\n"), (7, "é\n漢字\n\r\n end"), (7, "é\n漢字\n\r\n end"),
       (8, "<\nS>\n<P\n>\n" * 5), (9, "a\n" * 300_000), (-4, "one line")]


# ---------------------------------------------------------------- fill in the middle

def cut(doc_id, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text, text)
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, len(p), len(m), out, text)


@pytest.mark.parametrize("rate", [100, 40])
def test_middles_match_plain_python_and_restore(spark, rate):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("output", F.lit("x")).withColumn("h1", F.lit(0))
    out = fill_in_middle.transform(docs, rate=rate)
    got = out.withColumn("restored", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    order = lambda r: (str(r[0]), r[5])
    assert sorted(map(tuple, got), key=order) == sorted((cut(*r, rate) for r in ODD), key=order)
    assert fill_in_middle.transform(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- pages

@pytest.fixture(scope="module")
def field():
    return html_text.fit(html_text.labelled_pages())


def test_held_out_pages(field):
    right = total = 0
    for page, labels in html_text.labelled_pages(200, seed=5):
        found = html_text.blocks(page)
        got = field.viterbi(field.scores(html_text.features(found))) if found else []
        right, total = right + sum(a == b for a, b in zip(got, labels)), total + len(labels)
    assert total > 3000 and right / total > 0.97


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n, move = int(rng.integers(1, 8)), rng.normal(size=(2, 2)) * 2
        emitted = rng.normal(size=(n, 2))
        worth = lambda y: emitted[np.arange(n), y].sum() + move[y[:-1], y[1:]].sum()
        best = max((np.array([i >> t & 1 for t in range(n)]) for i in range(1 << n)), key=worth)
        assert (html_text.Field({}, np.zeros((0, 2)), move).viterbi(emitted) == best).all()


def test_blocks_of_odd_pages():
    said = lambda page: [b.text for b in html_text.blocks(page)]
    assert said("") == [] and said("bare &amp text") == ["bare & text"]
    assert said("<p>a<p>b<br>c <b>d</b>e&nbsp;&#8364;<!-- <p>no --><script>'</p>'</script>") == ["a", "b c de €"]
    assert said("<ul><li>x<li>y<ul><li>z</ul></ul><style>p{}</style>tail<div") == ["x", "y", "z", "tail<div"]
    assert said('<a title="x > y">in</a> out</p></section><!-- open') == ["in out"]
    deep = html_text.blocks("<div>x" * 3000)
    assert len(deep) == 3000 and deep[-1].marks == ("in=div", "leaf=div")


def test_given_pages_give_their_articles(spark, field):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (-1, "u", ""), (-2, "u", "<nav><a href=x>menu</a></nav>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(rows.unionByName(odd).withColumn("text", F.lit(1)), field).collect()}
    for r in rows.collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(p|h1|br)>", " ", inner))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    assert all(got[i]["text"] == "" for i in (None, -1, -2))


# ---------------------------------------------------------------- collocations

def phrases(docs, min_count, longest=5, top=2000, share=100):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang, text = lang or "und", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found, gone = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}, set()
    for (lang, w), a in found.items():
        gone |= {(lang, w[i:i + k]) for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= share * f[lang, w[i:i + k]]}
    out = []
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    best = [(lang, sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]) for lang in n]
    return sorted((lang, i, *r[1:]) for lang, rs in best for i, r in enumerate(rs, 1))


@pytest.mark.parametrize("share", [100, 60])
def test_phrases_match_plain_counts(spark, share):
    r = random.Random(3)
    words = ["the", "of", "é", "x1", "New", "york", "City"] + [f"w{i}" for i in range(12)]
    docs = [(r.choice(["en", "de", None]), " ".join(r.choices(words, weights=[9] * 7 + [1] * 12, k=r.randint(0, 40))) + r.choice([".", ", a b", "\n", ""])) for _ in range(200)]
    docs += [("en", None), ("en", ""), ("de", "  \t.;"), ("en", "the of " * 400)]
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(5).withColumn("n", F.lit("x")).withColumn("rank", F.lit(None).cast("int"))
    got = collocations.collocations(frame, min_count=9, top=50, share=share, fan=4, shard_bytes=700)  # some 40 shards: the filters are merged in three rounds
    assert sorted(map(tuple, got.collect())) == phrases(docs, 9, top=50, share=share)


def test_no_phrase_at_all(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).count() == 0


def test_filters_lose_nothing():
    rng = np.random.default_rng(1)
    for n, bits in ((1, 40), (2, 1), (2, 3), (2, 17), (3, 20), (4, 18), (5, 25), (5, 40)):
        lanes = rng.integers(0, 1 << bits, (n, 3000)).astype(np.uint64)
        moved = collocations.permute(lanes, bits)
        assert (collocations.permute(moved, bits, back=True) == lanes).all()
        packed = collocations.pack(moved, bits)
        assert (collocations.unpack(packed, bits, n) == moved).all()
        keys, counts = collocations.summed(packed, rng.integers(1, 3000, 3000))
        for cut_bits in (6, 12):
            parts = [blob for _, blob in collocations.Filter.slices(keys, counts, n * bits, cut_bits)]
            back, back_counts = collocations.Filter.merged(iter(parts), n * bits, cut_bits)
            assert (back == keys).all() and (back_counts == counts).all()
        some = keys[:, ::3]
        known = set(map(tuple, some.T.tolist()))
        assert collocations.among(packed, some).tolist() == [tuple(x) in known for x in packed.T.tolist()]
