"""Document fingerprints: MinHash signatures over five-word shingles, and likeness between them.

A fingerprint is ``PERMUTATIONS`` minima of universal hash permutations (multiply-shift, in numpy
over the whole chunk of texts at once), written as hex. Signature bands are joined in Spark to
propose pairs, and Jaccard is verified on the full shingle sets (``similar_pairs``).

Every document is also compared with the document next to it in descending id order, and with an
edited text: its last half replaced by the next document's beginning. Texts are shuffled once,
into ranges of ids cut at measured quantiles; the first document of each range also goes to the
range above it, so that each range knows the document after its last. No range grows with
the table: the number of ranges does.

Defined cases: NULL text is empty; a text with fewer than five words is one shingle of all its
words; texts without words have the fingerprint of nothing, all ones, and are alike; equal ids are
ordered by a hash of their text, NULL ids come last; the only row is next to itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from planlens.llm.common import U64, Scratch, chunks, components, lists, longs, mix, rows_of, runs
from planlens.llm.near_dedup import BLOCK, PERCENT, SHINGLE, deciders, digests, shingles, signatures

PERMUTATIONS = 64
BANDS = 16
PICKS = 2  # buckets in which a set meets the others of a block before the rest is decided
RANGE_BYTES = 32 << 20
NOTHING = 0xFFFFFFFF
_RNG = np.random.default_rng(4)
FACTORS = (_RNG.integers(1 << 63, size=PERMUTATIONS, dtype=U64) << U64(1)) | U64(1)
OFFSETS = _RNG.integers(1 << 63, size=PERMUTATIONS, dtype=U64)


def fingerprints(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The signatures of whole texts, one row each."""
    hashes, first = shingles(texts, size)
    out = np.full((len(first) - 1, PERMUTATIONS), NOTHING, np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for k in range(PERMUTATIONS):
            out[some, k] = np.minimum.reduceat(hashes * FACTORS[k] + OFFSETS[k] >> U64(32), first[some])
    return out


def _hex(signatures: np.ndarray) -> list[str]:
    whole = signatures.astype(">u4").tobytes().hex()
    return [whole[i:i + 8 * PERMUTATIONS] for i in range(0, len(whole), 8 * PERMUTATIONS)]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order (range, lent, descending id): each with the fingerprints of itself, its edited text and its next row."""
    def emit(rows):
        own = [r[3] for r in rows[:-1]]
        after = [r[3] for r in rows[1:]]
        edited = []
        for a, b in zip(own, after):
            half = len(a) // 2
            edited.append(a[:len(a) - half] + b[:half])
        prints = fingerprints(pa.array([r[3] for r in rows], pa.large_string()))
        of_edited = fingerprints(pa.array(edited, pa.large_string()))
        lent = [i for i, r in enumerate(rows[:-1]) if not r[1]]
        a, b, c = prints[:-1][lent], of_edited[lent], prints[1:][lent]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][2] for i in lent], pa.int64()), pa.array([len(own[i]) for i in lent], pa.int64()),
             pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in lent], pa.string()), pa.array(_hex(a), pa.string()), pa.array(_hex(b), pa.string()),
             pa.array((a == b).mean(1)), pa.array((a == c).mean(1))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    held: list[tuple] = []  # the rows of a range whose next row is not yet seen: (range, lent, doc_id, text)
    for part in chunks(batches, limit=1 << 20):
        for row in zip(*(part.column(c).to_pylist() for c in ("range", "lent", "doc_id", "text"))):
            if held and held[-1][0] != row[0]:
                if len(held) > 1:
                    yield emit(held)
                held = []
            if held and held[-1][1] and row[1]:
                continue  # equal ids at the head of the range below: the first of them is the next row
            held.append(row)
        if len(held) > 1:
            yield emit(held)
            held = held[-1:]


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = rows_of(docs, id_col, text_col)
    rows, size = base.agg(F.count("doc_id"), F.sum(F.octet_length("text"))).first()
    n = max(1, -(-(size or 0) // range_bytes))
    # NULL ids come after the smallest id: they are the range -1, below all others.
    cuts: list[int] = []
    if rows and n > 1:
        shares = [i / n for i in range(1, n)]
        cuts = sorted(set(base.agg(F.percentile_approx("doc_id", shares, 10000)).first()[0]))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), -1, np.int32)
        out[known] = np.searchsorted(np.array(cuts, np.int64), ids[known].to_numpy().astype(np.int64), side="left")
        return pd.Series(out)

    ranged = base.withColumn("range", range_of("doc_id"))
    # The head of a range (its largest id, NULL in the range -1) is also lent to the next range above, the topmost head to the lowest.
    # Its rows are those with the smallest text key, for equal ids are ordered by that.
    first = F.max(F.struct("doc_id", F.expr("~tkey").alias("k"))).alias("first")
    heads = {r["range"]: (r["first"]["doc_id"], ~r["first"]["k"]) for r in
             base.select("doc_id", "tkey").withColumn("range", range_of("doc_id")).groupBy("range").agg(first).collect()}
    order = sorted(heads, reverse=True)
    to = {r: order[i - 1] for i, r in enumerate(order)}  # the range whose last row comes before the head of r

    @F.pandas_udf("int")
    def lent_to(ids: pd.Series, keys: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([to[r] if heads[r] == (None if r == -1 else int(i), k) else None for i, k, r in zip(ids, keys, ranges)], dtype="Int32")

    lent = ranged.withColumn("_to", lent_to("doc_id", "tkey", "range"))
    places = F.array_compact(F.array(F.struct(F.col("range"), F.lit(False).alias("lent")), F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("range"), F.lit(True).alias("lent")))))
    placed = lent.withColumn("p", F.explode(places)).select("p.range", "p.lent", "doc_id", "tkey", "text")
    # The range is the partition: hashing it would put several ranges into one task and none into others.
    spread = placed.repartitionById(n + 1, F.col("range") + 1).sortWithinPartitions("range", "lent", F.col("doc_id").desc_nulls_last(), "tkey").drop("tkey")
    return spread.mapInArrow(_neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                          "near_edited double, near_next double")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set's digest and a hash of each signature band, for the texts with words."""
    for part in chunks(batches):
        hashes, first = shingles(part.column("text"), SHINGLE)
        some = np.diff(first) > 0
        rows = signatures(hashes, first, FACTORS, OFFSETS)[some].reshape(-1, BANDS, PERMUTATIONS // BANDS).astype(U64)
        bands = np.zeros(rows.shape[:2], U64) + np.arange(1, BANDS + 1, dtype=U64)
        for k in range(rows.shape[2]):
            bands = mix(bands ^ rows[:, :, k]) + U64(k)
        part = part.select(["doc_id", "tkey"]).filter(pa.array(some))
        yield pa.RecordBatch.from_arrays([*part.columns, longs(digests(hashes, first)[0][some]), lists(bands.ravel().view(np.int64), np.arange(0, bands.size + 1, BANDS))],
                                         ["doc_id", "tkey", "id", "bands"])


def _forests(percent: int):
    """Links (a, b) that join what is alike within each block (cluster, block): a spanning forest, fewer links than rows.

    Rows come sorted by block. A block that several slices of text share is judged slice by slice: this round only
    makes classes larger, and what it leaves apart is decided afterwards.
    """
    def joined(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each set one that is like it and joins it to the first of its class; itself for that first one."""
        n, sizes = len(first) - 1, np.diff(first)
        owner, order = np.repeat(np.arange(n), sizes), np.argsort(hashes, kind="stable")
        lo, hi = (np.searchsorted(hashes[order], hashes, side) for side in ("left", "right"))
        common = np.bincount(np.repeat(owner, hi - lo) * n + owner[order][runs(lo, hi - lo)], minlength=n * n).reshape(n, n)
        like = (common > 0) & (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common))
        parent, seen = np.arange(n), np.zeros(n, bool)
        for i in range(n):
            reached = [] if seen[i] else [i]
            seen[i] = True
            while reached:
                x = reached.pop()
                new = np.flatnonzero(like[x] & ~seen)
                seen[new], parent[new] = True, x
                reached.extend(new)
        return parent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=1 << 18):
            where = np.stack([part.column(c).to_numpy() for c in ("cluster", "block")], 1)
            ids, (hashes, first) = part.column("id").to_numpy(), shingles(part.column("text"), SHINGLE)
            cut = np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(1)))
            for lo, hi in zip(cut, np.append(cut[1:], len(ids))):
                if hi - lo > 1:
                    parent = joined(hashes[first[lo]:first[hi]], first[lo:hi + 1] - first[lo])
                    far = np.flatnonzero(parent != np.arange(hi - lo))
                    yield pa.record_batch({"a": pa.array(ids[lo + far]), "b": pa.array(ids[lo + parent[far]])})
    return run


def similar_pairs(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) with a > b between documents whose shingle sets have Jaccard ``percent`` / 100.

    Any two such documents whose signatures meet in a band are joined by the links, directly or over
    others; all pairs of a group of copies would grow with its square. Documents with equal sets are
    one from the start, linked with their smallest id. Classes then grow in three rounds, each on the
    full sets: every set with the smallest set it shares most bands with; every set with the others of
    one block in ``PICKS`` of its buckets, which gives a spanning forest per block; and what buckets
    still hold several classes, every document of one class against those of all others (see
    near_dedup). Texts of documents without a partner in any bucket travel once. Texts without words
    pair with nothing; rows without id are left out.
    """
    base = rows_of(docs, id_col, text_col).where("doc_id is not null")
    keep, scratch = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    members = keep.store(base.mapInArrow(_signed, "doc_id long, tkey long, id long, bands array<long>"))
    sets = keep.store(members.groupBy("id").agg(F.min(F.struct("doc_id", "tkey")).alias("k"), F.first("bands").alias("bands")).select("id", "k.*", "bands"))
    spread = sets.select(F.explode("bands").alias("cluster"), "id")
    heads = spread.groupBy("cluster").agg(F.min("id").alias("head"), F.max("id").alias("_last")).where("head < _last").drop("_last")
    rows = scratch.store(spread.join(heads, "cluster"))
    speaker = sets.select("id", "doc_id", "tkey").join(rows.select("id").distinct(), "id")
    whole = scratch.store(base.join(speaker.drop("id"), ["doc_id", "tkey"], "left_semi"), "zstd")
    confirmed, decided = deciders(whole, speaker, scratch, SHINGLE, percent)

    near = (rows.where("id <> head").groupBy("id", "head").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("id").agg(F.min(F.struct(-F.col("n"), F.col("head"))).alias("k")).select(F.col("id").alias("a"), F.col("k.head").alias("b")))
    edges = confirmed(scratch.store(near))

    def mixed(roots: DataFrame) -> DataFrame:
        """The rows (cluster, id, label) of the buckets with several classes; buckets that bring the same documents together count once."""
        labelled = scratch.store(rows.join(roots, "id", "left").select("cluster", "id", F.coalesce("root", "id").alias("label")))
        held = [F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
        several = labelled.groupBy("cluster").agg(*held, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        once = several.groupBy("n", "first", "x", "y").agg(F.min("cluster").alias("cluster"))
        return scratch.store(labelled.join(once.select("cluster", "n"), "cluster"))

    open_ = mixed(components(edges, scratch))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "cluster"))  # a set has BANDS rows at most
    placed = (open_.withColumn("rank", rank).where(F.col("rank") <= PICKS)
              .select("cluster", F.pmod(F.xxhash64("id", "cluster"), F.ceil(F.col("n") / BLOCK)).alias("block"), "id"))
    texts = whole.join(speaker, ["doc_id", "tkey"]).dropDuplicates(["id"]).select("id", "text")
    forests = (placed.join(texts, "id").repartition("cluster", "block").sortWithinPartitions("cluster", "block", "id").mapInArrow(_forests(percent), "a long, b long"))
    edges = scratch.store(edges.unionByName(forests))
    more = decided(mixed(components(edges, scratch)).drop("n"))
    named = lambda c: sets.select(F.col("id").alias(c), F.col("doc_id").alias(f"{c}_doc"))
    between = edges.unionByName(more).distinct().join(named("a"), "a").join(named("b"), "b").select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))
    copies = members.join(sets.select("id", F.col("doc_id").alias("b")), "id").select(F.col("doc_id").alias("a"), "b")
    links = between.unionByName(copies).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = Scratch(docs.sparkSession).store(links)
    scratch.close()
    keep.close()
    return found


def similar_groups(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of the documents that similar_pairs links; component_id is the smallest id reachable."""
    links, scratch = similar_pairs(docs, percent, id_col, text_col), Scratch(docs.sparkSession)
    found = Scratch(docs.sparkSession).store(components(links, scratch).select(F.col("id").alias("doc_id"), F.col("root").alias("component_id")))
    scratch.close()
    return found
