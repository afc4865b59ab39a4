"""Substring deduplication: words of passages that an earlier document already holds are removed.

Every fixed-length window of words gets Rabin-Karp hashes, Spark finds for each window the
smallest document it starts in, and neighbouring repeated windows merge into maximal intervals.

To count 50-word windows without shuffling each of them, windows travel in *runs*. A window's
mark is the smallest hash among its (window/2)-word pieces, a function of its content, so equal
windows have equal marks; neighbouring windows with one mark form a run of some 13 windows.

1. Per mark, the smallest and largest document holding it (aggregated before the shuffle).
   Marks of one document only, nearly all, end here: their windows repeat nowhere else.
2. Per mark and run content, the smallest document. A run whose content an earlier document
   holds is removed whole; other holders of it need not be looked at again.
3. Only where runs of one mark differ (the ends of shared passages) are windows themselves
   counted, by two independent 64-bit hashes, one row per window and document.

No group is gathered: every step is an aggregation with map-side combine or a join that Spark
may split, so a passage that a third of all documents share only makes more rows.

Defined cases: NULL or empty text has no words; a text shorter than the window is kept whole;
rows with equal doc_id never remove each other's words; NULL doc_id counts as larger than any
id (rows without id never remove each other's words); every input row gives one output row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from planlens.llm.common import FIRST, SECOND, SPACE, U64, Scratch, chunks, lists, longs, mix, rows_of, runs, text_bytes, word_spans

WINDOW = 50


class _Windows:
    """Window starts of a chunk of texts with their marks, and the runs of equal marks."""

    def __init__(self, column: pa.Array, window: int, want_windows: bool = False):
        self.data, offsets = text_bytes(column)
        self.starts, self.ends, self.rows = word_spans(self.data, offsets, SPACE)
        first = FIRST.words(self.data, self.starts, self.ends)
        self.n_words = np.diff(self.rows)
        count = np.maximum(self.n_words - window + 1, 0)
        self.at = runs(self.rows[:-1], count)  # the word each window starts with
        self.row = np.repeat(np.arange(len(count)), count)
        piece = max(1, window // 2)
        low = FIRST.windows(first, piece) if len(first) >= piece else np.zeros(0, U64)
        reach, have = window - piece + 1, 1
        least = low
        while have * 2 <= reach:  # sliding minimum by doubling
            least, have = np.minimum(least[:-have], least[have:]), have * 2
        if have < reach:
            least = np.minimum(least[:len(least) - (reach - have)], least[reach - have:])
        mark = least[self.at] if len(self.at) else np.zeros(0, U64)
        new = np.ones(len(mark), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (self.at[1:] != self.at[:-1] + 1) | (self.row[1:] != self.row[:-1])
        self.run_first = np.flatnonzero(new)
        self.run_size = np.diff(np.append(self.run_first, len(mark)))
        self.run_row = self.row[self.run_first]
        self.run_mark = mark[self.run_first]
        start = self.at[self.run_first]
        self.run_key = mix(SECOND.spans(first, start, start + self.run_size - 1 + window) ^ self.run_mark)
        self.both = None
        if want_windows:
            second = SECOND.words(self.data, self.starts, self.ends)
            self.both = lambda at: (FIRST.spans(first, at, at + window), SECOND.spans(second, at, at + window))


def _own(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that only match inside their own row of the chunk."""
    return mix(keys ^ mix(rows.astype(U64)))


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each; NULL lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def _wanted_runs(w: _Windows, column: pa.Array) -> np.ndarray:
    keys, rows = _listed(column)
    return np.flatnonzero(np.isin(_own(w.run_key, w.run_row), _own(keys.view(U64), rows))) if len(keys) else np.zeros(0, np.int64)


def _emit_runs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            w = _Windows(part.column("text"), window)
            take = pa.array(w.run_row)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("tkey").take(take), longs(w.run_mark), longs(w.run_key)],
                                             ["doc_id", "tkey", "mark", "run"])
    return run


def _emit_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            w = _Windows(part.column("text"), window, want_windows=True)
            hit = _wanted_runs(w, part.column("look"))
            at = runs(w.at[w.run_first[hit]], w.run_size[hit])
            row = np.repeat(w.run_row[hit], w.run_size[hit])
            h1, h2 = w.both(at)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("tkey").take(take),
                                              longs(h1), longs(h2), pa.array((at - w.rows[row]).astype(np.int32))],
                                             ["doc_id", "tkey", "h1", "h2", "pos"])
    return run


def _remove(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            w = _Windows(part.column("text"), window)
            n = len(w.starts)
            edge = np.zeros(n + 1, np.int64)
            hit = _wanted_runs(w, part.column("gone"))
            start = w.at[w.run_first[hit]]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + w.run_size[hit] - 1 + window, -1)
            place, row = _listed(part.column("single"))
            at = place.astype(np.int64) + w.rows[row]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            covered = np.cumsum(edge)[:n] > 0
            kept, removed, digests, offs, spans = [], [], [], [0], []
            for i in range(part.num_rows):
                lo, hi = w.rows[i], w.rows[i + 1]
                cov = covered[lo:hi]
                removed.append(int(cov.sum()))
                text = _join(w, lo, hi, cov)
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept.append(text.decode("utf-8"))
                    step = np.diff(np.concatenate(([0], cov.view(np.int8), [0])))
                    cut = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1).ravel()
                    spans.append(cut)
                    offs.append(offs[-1] + len(cut))
            arrays = [part.column("doc_id"), pa.array(w.n_words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            if with_text:
                flat = np.concatenate(spans).astype(np.int32) if spans else np.zeros(0, np.int32)
                arrays += [lists(flat, np.array(offs)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", *(["removed", "kept_text"] if with_text else [])])
    return run


def _join(w: _Windows, lo: int, hi: int, covered: np.ndarray) -> bytes:
    """The words of a row that are not covered, one space between."""
    keep = np.flatnonzero(~covered) + lo
    if not len(keep):
        return b""
    if len(keep) == hi - lo:
        return b" ".join(w.data[w.starts[lo]:w.ends[hi - 1]].tobytes().split())
    cut = np.flatnonzero(np.diff(keep) > 1)
    first, last = keep[np.append(0, cut + 1)], keep[np.append(cut, len(keep) - 1)]
    return b" ".join(b" ".join(w.data[w.starts[a]:w.ends[b]].tobytes().split()) for a, b in zip(first, last))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and with ``with_text``
    the removed word intervals (start, end, start, end, ...) and the text that is left."""
    base = rows_of(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    last = (1 << 63) - 1
    own = F.coalesce("doc_id", F.lit(last))
    found = base.mapInArrow(_emit_runs(window), "doc_id long, tkey long, mark long, run long")
    marks = (found.groupBy("mark").agg(F.min(own).alias("lo"), F.max(own).alias("hi"), (F.min("run") != F.max("run")).alias("differ"))
             .where("lo < hi"))
    # Each aggregate is written before it is joined, so that both sides are dealt anew and Spark can split a hot key.
    marks = scratch.store(marks.drop("hi"))
    shared = scratch.store(found.join(marks, "mark").distinct())
    firsts = scratch.store(shared.groupBy("mark", "run").agg(F.min(own).alias("first")))
    judged = scratch.store(shared.join(firsts, ["mark", "run"]))
    gone = judged.where(F.col("first") < own)
    # a run's first holder speaks for it: its windows are counted where other runs of the mark differ
    look = judged.where("differ").where(F.col("first") == own)
    asked = look.groupBy("doc_id", "tkey").agg(F.collect_set("run").alias("look"))
    both = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.tkey") == F.col("x.tkey"))
    texts = base.alias("d").join(asked.alias("x"), both).select("d.doc_id", "d.tkey", "d.text", "x.look")
    windows = scratch.store(texts.mapInArrow(_emit_windows(window), "doc_id long, tkey long, h1 long, h2 long, pos int"))
    earliest = scratch.store(windows.groupBy("h1", "h2").agg(F.min(own).alias("first"), F.max(own).alias("latest")).where("first < latest").drop("latest"))
    single = (windows.join(earliest, ["h1", "h2"]).where(F.col("first") < own)
              .groupBy("doc_id", "tkey").agg(F.collect_set("pos").alias("single")))
    gone = gone.groupBy("doc_id", "tkey").agg(F.collect_set("run").alias("gone"))
    ask = gone.select("doc_id", "tkey", "gone", F.lit(None).cast("array<int>").alias("single")).unionByName(
        single.select("doc_id", "tkey", F.lit(None).cast("array<bigint>").alias("gone"), "single"))
    ask = ask.groupBy("doc_id", "tkey").agg(F.max("gone").alias("gone"), F.max("single").alias("single"))
    out = base.alias("d").join(ask.alias("x"), both, "left").select("d.doc_id", "d.text", "x.gone", "x.single")
    more = ", removed array<int>, kept_text string" if with_text else ""
    return out.mapInArrow(_remove(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + more)
