"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed terms: A-Z lower-cased runs of letters, digits and non-ASCII,
and the first ``PREFIXES`` bytes of longer ones, so that a rare form of a word counts with its
other forms. Terms whose presence tells nothing about the label, by a G-squared test over all
training documents counted in Spark, have no weight; on the others a factorization machine
learns one weight each and, by a short vector each, how pairs of terms act together: an insult
beside a mention of a group can weigh more than the sum of both.

Training data are bounded: at most ``max_labels`` labelled documents, those with the smallest hash
of their id, so the set is the same in each run; and at most ``max_terms`` terms. The fit on these
bounded rows runs in one task. Scoring reads every whole text once, without a shuffle, and takes
nothing but the text.

Labels: only rows with crc32(id as text) mod 3 other than 1; a doc_id labelled more than once
counts as toxic when any label says so; NULL ids and labels are not used.

Defined cases: NULL and empty texts score like a text without telling terms; without labels of
both kinds no term has a weight and every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from planlens.llm.common import FIRST, LOWER, NOT_WORD, SECOND, U64, chunks, give_back, lists, rows_of, text_bytes, word_spans

BITS = 22  # a term is one of 2^22 hashes
MAX_LABELS, MAX_TERMS, FACTORS = 20000, 2000, 8
MIN_G2, STEPS, RATE, DECAY = 20.0, 300, 0.05, 1e-4
THRESHOLD = 0.7
PREFIXES = (4, 5)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of every text, one after the other, and each text's first one."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, NOT_WORD)
    n = len(rows) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    found = [row << BITS | (FIRST.words(data, starts, ends) >> U64(64 - BITS)).astype(np.int64)]
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts > size)
        start = starts[longer]
        found.append(row[longer] << BITS | (SECOND.words(data, start, start + size) >> U64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return (both & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both >> BITS, np.arange(n + 1))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        term, first = terms(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), lists(term, first)], ["doc_id", "y", "terms"])


@dataclass
class Model:
    """Bias, and for each of at most MAX_TERMS terms (sorted) a weight and a vector."""

    bias: float
    term: np.ndarray
    weight: np.ndarray
    vector: np.ndarray

    def scores(self, term: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        logit = np.full(n, self.bias)
        if len(self.term):
            at = np.minimum(np.searchsorted(self.term, term), len(self.term) - 1)
            known = np.flatnonzero(self.term[at] == term)
            row, at = np.searchsorted(first, known, side="right") - 1, at[known]
            logit += _logit(row, at, n, self.weight, self.vector)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _sums(row: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Sums of values by row; rows are sorted."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    edge = np.searchsorted(row, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def _logit(row, at, n, weight, vector):
    own = _sums(row, n, vector[at])
    return _sums(row, n, weight[at]) + 0.5 * ((own ** 2).sum(1) - _sums(row, n, (vector[at] ** 2).sum(1)))


def fit_machine(row: np.ndarray, at: np.ndarray, y: np.ndarray, n_terms: int, factors: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-loss minimised by Adam over all rows at once, each weighing alike, so that scores are shares of toxic documents."""
    rng, n = np.random.default_rng(seed), len(y)
    params = [np.zeros(1), np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, factors))]
    moved = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for t in range(1, STEPS + 1):
        bias, weight, vector = params
        own = _sums(row, n, vector[at])
        logit = bias[0] + _sums(row, n, weight[at]) + 0.5 * ((own ** 2).sum(1) - _sums(row, n, (vector[at] ** 2).sum(1)))
        off = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n
        pull = off[row]
        g_vector = np.zeros_like(vector)
        for k in range(factors):
            g_vector[:, k] = np.bincount(at, pull * (own[row, k] - vector[at, k]), n_terms)
        grads = [np.array([off.sum()]), np.bincount(at, pull, n_terms) + DECAY * weight, g_vector + DECAY * vector]
        for p, g, (m, v) in zip(params, grads, moved):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_terms: int = MAX_TERMS, factors: int = FACTORS, seed: int = 9,
        id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text") -> Model:
    """Learn from labelled rows that are not held out."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_labels)  # bounded by the parameter, hence the broadcast
    base = rows_of(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    held = base.select("doc_id", "text", "y").mapInArrow(_terms, "doc_id long, y int, terms array<int>").persist()
    try:
        n, pos = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
        nothing = Model(float(np.log(pos / (n - pos))) if 0 < pos < n else (30.0 if n and pos == n else -30.0), np.zeros(0, np.int32), np.zeros(0), np.zeros((0, factors)))
        if not 0 < pos < n:
            return nothing
        counted = held.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))

        def part(seen, expected):
            return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
        a, b, p, q = F.col("a"), F.col("b"), float(pos), float(n - pos)
        tell = a + b
        g2 = 2 * (part(a, tell * p / n) + part(b, tell * q / n) + part(p - a, (n - tell) * p / n) + part(q - b, (n - tell) * q / n))
        best = sorted(r["term"] for r in counted.select("term", g2.alias("g2")).where(F.col("g2") >= MIN_G2).orderBy(F.desc("g2"), "term").limit(max_terms).collect())
        if not best:
            return nothing
        term = np.array(best, np.int32)

        def lean(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pylist([{"part": 0, "y": y, "terms": sorted(set(t) & chosen_terms)} for y, t in
                                                  zip(batch.column("y").to_pylist(), batch.column("terms").to_pylist())],
                                                 schema=pa.schema([("part", pa.int32()), ("y", pa.int32()), ("terms", pa.list_(pa.int32()))]))
        chosen_terms = set(best)

        def learn(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table.column("terms").to_pylist(), table.column("y").to_pylist()))
            y = np.array([v for _, v in rows], float)
            row = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
            at = np.searchsorted(term, np.array([x for t, _ in rows for x in t], np.int32))
            del rows
            bias, weight, vector = fit_machine(row, at, y, len(term), factors, seed)
            give_back()
            return pa.table({"bias": [bias], "weight": [weight.tolist()], "vector": [vector.ravel().tolist()]})
        got = (held.mapInArrow(lean, "part int, y int, terms array<int>").groupBy("part").applyInArrow(learn, "bias double, weight array<double>, vector array<double>").first())
        return Model(got["bias"], term, np.array(got["weight"]), np.array(got["vector"]).reshape(len(term), factors))
    finally:
        held.unpersist()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, tkey, score."""
    def run(batches):
        for piece in chunks(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("tkey"), pa.array(model.scores(*terms(piece.column("text"))))], ["doc_id", "tkey", "score"])
    return rows_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, tkey long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without those that score ``threshold`` or more, all columns as they were."""
    def run(batches):
        for piece in chunks(batches, text_col):
            yield piece.filter(pa.array(model.scores(*terms(piece.column(text_col))) < threshold))
    return docs.mapInArrow(run, docs.schema)
