"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is two megabytes of whole documents inside one task. Its words become numbers in the
benchmark's vocabulary (other words: none), the suffixes that could match at all are sorted into
a suffix array, and every suffix of every benchmark item is binary-searched in it, one word
deeper at a time, which leaves its longest verbatim match and all places of it. Windows found
whole mark the words they cover; documents hit too much are removed.

The benchmark is the query set. It is read in blocks of at most ``block_bytes`` of text (the
number of blocks follows from its measured size), and one block at a time reaches the tasks; the
documents, which grow, stay where they are and are not shuffled.

Words: A-Z lower-cased, then runs of letters, digits and non-ASCII. A window is ``window``
consecutive words of an item; an item with fewer words, but some, is one window.

Defined cases: NULL and empty texts have no words and are never contaminated; items with NULL id
take part in hits but are not listed; repeated items count once; every row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from planlens.llm.common import FIRST, LOWER, NOT_WORD, Scratch, chunks, lists, rows_of, runs, text_bytes, word_spans

WINDOW = 13
SHARE = 20  # contaminated: at least one word in SHARE is hit
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 2 << 20  # text of a suffix array


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, NOT_WORD)
    return FIRST.words(data, starts, ends), rows


class Items:
    """A block of benchmark items: vocabulary, word numbers, and the suffixes that start a window."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        hashes, rows = _hashed(pa.array(texts, pa.string()))
        self.ids, self.window = ids, window
        self.vocabulary, self.words = np.unique(hashes, return_inverse=True)
        n = np.diff(rows)
        self.item = np.repeat(np.arange(len(n)), n)
        self.start = np.arange(len(self.words))  # every suffix of every item
        self.left = np.repeat(rows[1:], n) - self.start  # words of it up to the item's end
        self.need = np.minimum(window, np.repeat(n, n))  # words of a window of the item
        self.shortest = int(np.min(n[n > 0])) if (n > 0).any() else 0


class SuffixArray:
    """The suffixes of a shard, sorted; ``words`` has -1 at document ends and unknown words."""

    def __init__(self, words: np.ndarray, least: int, depth: int):
        here = np.arange(len(words))
        stop = np.concatenate(([-1], np.flatnonzero(words < 0), [len(words)]))
        after = np.searchsorted(stop, here)
        ahead = np.where(words < 0, 0, stop[after] - here)
        length = np.where(words < 0, 0, stop[after] - stop[after - 1] - 1)
        use = np.flatnonzero(length >= max(1, least))  # a shorter run of known words holds no window
        at = use[ahead[use] >= max(1, least)]
        rank = np.zeros(len(words) + 1, np.int64)  # 0: past the end of a run
        rank[use] = words[use] + 1
        have = 1
        while have < depth and len(at):  # prefix doubling: by the rank of a suffix's first half, then of its second
            second = rank[np.minimum(use + have, len(words))]
            inside = have < ahead[use]
            pair = rank[use] * (int(rank.max()) + 1) + np.where(inside, second, 0)
            values, inverse = np.unique(pair, return_inverse=True)
            rank[use] = inverse + 1
            have *= 2
            if len(values) == len(use):
                break
        self.words, self.at = np.append(words, -1), at[np.argsort(rank[at], kind="stable")]

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per item suffix: words of the longest verbatim match, how many windows' worth were
        found whole as a range (lo, hi) of the array, and the first place of the longest match."""
        n = len(items.start)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.at))
        longest, wlo, whi, place = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
        live, depth = np.arange(n), 0
        while len(live) and len(self.at):
            live = live[items.left[live] > depth]
            word = items.words[items.start[live] + depth]
            low = self._bound(lo[live], hi[live], depth, word)
            high = self._bound(low, hi[live], depth, word + 1)
            found = high > low
            live = live[found]
            depth += 1
            lo[live], hi[live], longest[live] = low[found], high[found], depth
            whole = live[items.need[live] == depth]
            wlo[whole], whi[whole] = lo[whole], hi[whole]
        met = longest > 0
        place[met] = self.at[lo[met]]
        return longest, wlo, whi, place

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
        """The first suffix in [lo, hi) whose word at ``depth`` is not below ``word``."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            probe = np.where(open_, mid, 0)
            value = self.words[np.minimum(self.at[probe] + depth, len(self.words) - 1)]
            below = open_ & (value < word)
            lo = np.where(below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)
        return lo


def _shard(column: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """The words of a shard as numbers, -1 after each document; and each document's first word there."""
    hashes, rows = _hashed(column)
    if len(items.vocabulary):
        number = np.searchsorted(items.vocabulary, hashes)
        number[number == len(items.vocabulary)] = 0
        number = np.where(items.vocabulary[number] == hashes, number, -1)
    else:
        number = np.full(len(hashes), -1)
    n = np.diff(rows)
    first = rows[:-1] + np.arange(len(n))
    words = np.full(len(hashes) + len(n), -1, np.int64)
    words[runs(first, n)] = number
    return words, np.append(first, len(words))


def _find(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=SHARD_BYTES):
            words, first = _shard(part.column("text"), items)
            depth = int(items.left.max()) if len(items.left) else 0
            array = SuffixArray(words, min(items.window, items.shortest), depth)
            longest, lo, hi, _ = array.search(items)
            full = np.flatnonzero((hi > lo) & (longest >= items.need) & (items.left >= items.need)
                                  & ((items.need == items.window) | (items.left == items.need)))
            count = hi[full] - lo[full]
            at, need = array.at[runs(lo[full], count)], np.repeat(items.need[full], count)
            doc, item = np.searchsorted(first, at, side="right") - 1, np.repeat(items.item[full], count)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + need, -1)
            step = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).view(np.int8))))
            begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            begin_doc = np.searchsorted(first, begin, side="right") - 1
            pairs = np.unique(np.stack([doc, item], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
            n = part.num_rows
            cut = np.stack([begin - first[begin_doc], end - first[begin_doc]], 1).ravel().astype(np.int32)
            ids = [items.ids[i] for i in pairs[:, 1]]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("tkey"), pa.array(np.diff(first) - 1),
                 lists(cut, 2 * np.searchsorted(begin_doc, np.arange(n + 1))),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype(np.int32)), pa.array(ids, pa.string()))],
                ["doc_id", "tkey", "n_words", "hits", "items"])
    return run


def _longest(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=SHARD_BYTES):
            words, first = _shard(part.column("text"), items)
            array = SuffixArray(words, 1, int(items.left.max()) if len(items.left) else 0)
            longest, _, _, place = array.search(items)
            met = np.flatnonzero(longest)
            doc = np.searchsorted(first, place[met], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([items.ids[i] for i in items.item[met]], pa.string()), pa.array(met - np.searchsorted(items.item, items.item[met])),
                 pa.array(longest[met]), part.column("doc_id").take(pa.array(doc)), pa.array(place[met] - first[doc])],
                ["item_id", "item_word", "n_words", "doc_id", "doc_word"])
    return run


def _blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str, block_bytes: int) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_bytes`` of text, one at a time."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).distinct().collect()
        got.sort(key=lambda r: (r.id is None, r.id or "", r.text))
        yield Items([r.id for r in got], [r.text for r in got], window)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every suffix of every item (item_id, item_word): its longest verbatim match over all
    shards, in words, with one place of it (the smallest doc_id, then word)."""
    base, out = rows_of(docs, id_col, text_col), None
    schema = "item_id string, item_word long, n_words long, doc_id long, doc_word long"
    for items in _blocks(benchmark, WINDOW, item_col, text_col, block_bytes):
        found = base.mapInArrow(_longest(items), schema)
        out = found if out is None else out.unionByName(found)
    best = F.min_by(F.struct("n_words", "doc_id", "doc_word"), F.struct(-F.col("n_words"), F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("doc_word")))
    return out.groupBy("item_id", "item_word").agg(best.alias("m")).select("item_id", "item_word", "m.*")


def _sum_up(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n_hit, n_items, digest, listed = [], [], [], []
            for hits, items in zip(part.column("hits").to_pylist(), part.column("items").to_pylist()):
                reach = total = 0
                for a, b in sorted(zip(hits[::2], hits[1::2])):
                    total, reach = total + max(0, b - max(a, reach)), max(reach, b)
                ids = sorted({i for i in items if i is not None})
                n_hit.append(total)
                n_items.append(len(ids))
                digest.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                listed.append(ids)
            bad = [h > 0 and share * h >= n for h, n in zip(n_hit, part.column("n_words").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("tkey"), part.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(bad, pa.bool_()), pa.array(listed, pa.list_(pa.string())), part.column("hits")],
                ["doc_id", "tkey", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hits"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, id_col: str = "doc_id",
                  item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, tkey, n_words, n_hit, n_items, items_sha256, contaminated,
    the item ids and the hit word intervals (start, end, ...)."""
    base, parts = rows_of(docs, id_col, text_col), []
    schema = "doc_id long, tkey long, n_words long, hits array<int>, items array<string>"
    for items in _blocks(benchmark, window, item_col, text_col, block_bytes):
        parts.append(base.mapInArrow(_find(items), schema))
    found = parts[0]
    if len(parts) > 1:  # one row of each document per block; repeated rows are told apart by their number
        merged = parts[0].where("size(hits) > 0")
        for more in parts[1:]:
            merged = merged.unionByName(more.where("size(hits) > 0"))
        merged = merged.groupBy("doc_id", "tkey").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.flatten(F.collect_set("items")).alias("items"))
        lengths = parts[0].groupBy("doc_id", "tkey").agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("times"))
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tkey") == F.col("b.tkey"))
        found = lengths.alias("a").join(merged.alias("b"), same, "left").select(
            "a.doc_id", "a.tkey", "a.n_words", F.coalesce("b.hits", F.array().cast("array<int>")).alias("hits"),
            F.coalesce("b.items", F.array().cast("array<string>")).alias("items"), F.explode(F.sequence(F.lit(1), "a.times")).alias("_k")).drop("_k")
    return found.mapInArrow(_sum_up(share), "doc_id long, tkey long, n_words long, n_hit long, n_items long, items_sha256 string, "
                                            "contaminated boolean, items array<string>, hits array<int>")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents, all columns as they were."""
    bad = contamination(docs, benchmark, window, share, id_col, text_col=text_col).where("contaminated").select("doc_id", "tkey").distinct()
    bad = Scratch(docs.sparkSession).store(bad)  # with its true size, so that a short list is broadcast and a long one is not
    same = F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("x.doc_id")) & (F.xxhash64(F.coalesce(F.col(f"d.{text_col}").cast("string"), F.lit(""))) == F.col("x.tkey"))
    return docs.alias("d").join(bad.alias("x"), same, "left_anti")
