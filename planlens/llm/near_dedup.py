"""MinHash near-duplicates by a chosen-path set similarity join.

A document is its set of distinct word shingles, embedded as ``SIGNATURE`` minwise values.
Documents are branched recursively: a node's path chooses which minwise positions to branch on,
and documents with the same value there go to the same child. Nodes with few pairs left to decide
are compared exhaustively; larger ones branch again on other positions. ``TREES`` independent
trees, each of ``BRANCHES`` positions at its root, bring the recall to the target: a pair at
Jaccard 0.8 agrees in a position with probability 0.8, so it is parted at all nine root positions
with probability 0.2^9 (5e-7).

Big groups of copies are not paired with each other:

* documents with equal sets are one node from the start;
* in every node each document is first verified with one neighbour only, the smallest document it
  shares most nodes with. What that links is one class, and pairs inside a class need no more
  work: a node's size is the number of its pairs *between* classes;
* what a node's comparison leaves undecided is not a list of pairs but clusters: documents joined
  by signatures that agree at ``KEEP`` of the positions (for a pair at 0.8 and 64 positions that is
  4.5 standard deviations below what is expected). Nodes still large at ``DEPTH`` are clusters as
  they are.

Clusters are decided on the full sets, in blocks of about ``BLOCK`` documents. The largest class
of a cluster only receives: every other document visits its blocks, and the later ones of its own
kind. A task holds one block and streams the visitors, so no pair is a row unless it is a link.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; an empty
or NULL text has no shingle and links with nothing, not even another empty one; a document
without links is its own component; ids that are NULL or repeat are kept, one output row per
input row (NULL ids are told apart by their text and shown as NULL).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planlens.llm.common import FIRST, LOWER, SECOND, SPACE, U64, Scratch, chunks, components, longs, mix, rows_of, runs, text_bytes, word_spans

SHINGLE, PERCENT = 5, 80
SIGNATURE = 64
TREES, BRANCHES, DEEPER = 3, 3, 2
PAIRS = 300  # pairs between classes up to which a node is compared exhaustively
DEPTH = 4
BLOCK = 128  # documents a task compares others with
KEEP = 37  # agreeing positions of 64, of which a pair at 0.8 has 51 +- 3.2
_RNG = np.random.default_rng(6)
FACTORS = (_RNG.integers(1 << 63, size=SIGNATURE, dtype=U64) << U64(1)) | U64(1)
OFFSETS = _RNG.integers(1 << 63, size=SIGNATURE, dtype=U64)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, one after the other, and each text's first one."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, SPACE)
    words = FIRST.words(data, starts, ends)
    n = np.diff(rows)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    begin = runs(rows[:-1], count)
    row = np.repeat(np.arange(len(n)), count)
    hashes = SECOND.spans(words, begin, np.minimum(begin + size, rows[row + 1]))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(n) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray, factors: np.ndarray = FACTORS, offsets: np.ndarray = OFFSETS) -> np.ndarray:
    """32-bit minwise values, one row per text, by multiply-shift permutations; texts without shingles get zeros."""
    out = np.zeros((len(first) - 1, len(factors)), np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        at = first[some]
        for k in range(len(factors)):
            out[some, k] = np.minimum.reduceat(hashes * factors[k] + offsets[k] >> U64(32), at)
    return out


def digests(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 128-bit digest of every set, in two rows: sums of mixed hashes."""
    both = np.zeros((2, len(first) - 1), U64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        both[0, some] = mix(np.add.reduceat(mix(hashes), first[some]))
        both[1, some] = mix(np.add.reduceat(mix(hashes ^ U64(0x9E3779B97F4A7C15)), first[some]))
    return both


def _embed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            hashes, first = shingles(part.column("text"), size)
            n, sig, both = np.diff(first), signatures(hashes, first), digests(hashes, first)
            values = [pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, SIGNATURE, dtype=np.int32)), pa.array(sig.ravel().view(np.int32)))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tkey"), pa.array(n.astype(np.int64)), longs(both[0]), longs(both[1]), *values],
                                             ["doc_id", "tkey", "n_shingles", "s1", "s2", "sig"])
    return run


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ok = np.zeros(part.num_rows, bool)
            for lo in range(0, part.num_rows, 64):
                piece = part.slice(lo, 64)
                sets = [(h, f) for h, f in (shingles(piece.column(c), size) for c in ("ta", "tb"))]
                for i in range(piece.num_rows):
                    a, b = (h[f[i]:f[i + 1]] for h, f in sets)
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    ok[lo + i] = common > 0 and 100 * common >= percent * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok))
    return run


def _compare(keep: int):
    """Clusters of each node, as edges (a, b) from every row to its cluster's smallest: rows of different
    classes whose signatures agree enough. Rows come sorted by node; a node's rows are few (see PAIRS)."""
    def edges(node, ids, label, sig):
        root = np.arange(len(node))
        pairs = []
        for step in range(1, len(node)):
            i = np.flatnonzero(node[step:] == node[:-step])
            if not len(i):
                break
            i = i[label[i] != label[i + step]]
            for lo in range(0, len(i), 1 << 16):
                j = i[lo:lo + (1 << 16)]
                j = j[(sig[j] == sig[j + step]).sum(1) >= keep]
                pairs.append(np.stack([j, j + step]))
        a, b = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)
        while len(a):  # the smallest row each row is connected with
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
        far = np.flatnonzero(root != np.arange(len(root)))
        return ids[far], ids[root[far]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(c).to_numpy() for c in ("node", "id", "label")]
            part.append(batch.column("sig").flatten().to_numpy().reshape(-1, SIGNATURE))
            if held is not None:
                part = [np.concatenate([x, y]) for x, y in zip(held, part)]
            last = int(np.flatnonzero(part[0] != part[0][-1])[-1]) + 1 if part[0][0] != part[0][-1] else 0
            held = [x[last:] for x in part]
            if last:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in edges(*(x[:last] for x in part))], ["a", "b"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in edges(*held)], ["a", "b"])
    return run


def _meet(size: int, percent: int):
    """Links (a, b) inside the blocks: residents come first, each with all before it, then visitors with all residents.

    A row is linked with one document of each other class at most; more would join nothing new.
    """
    def linked(found, have, new):
        """Compare ``new`` rows (sets, first, ids, labels) with the ``have`` ones."""
        hashes, first, ids, labels = new
        old, owner, old_ids, old_labels, old_n = have
        n, sizes = len(old_ids), np.diff(first)
        row = np.repeat(np.arange(len(ids)), sizes)
        lo, hi = np.searchsorted(old, hashes, "left"), np.searchsorted(old, hashes, "right")
        common = np.bincount(np.repeat(row, hi - lo) * n + owner[runs(lo, hi - lo)], minlength=len(ids) * n).reshape(len(ids), n)
        good = (common > 0) & (100 * common >= percent * (sizes[:, None] + old_n[None, :] - common)) & (labels[:, None] != old_labels[None, :])
        x, y = np.nonzero(good)
        _, once = np.unique(np.stack([x, old_labels[y]], 1), axis=0, return_index=True) if len(x) else (None, np.zeros(0, np.int64))
        found.append((ids[x[once]], old_ids[y[once]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, have = None, None
        for part in chunks(batches, limit=1 << 18):
            where = np.stack([part.column(c).to_numpy() for c in ("cluster", "block")], 1)
            ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
            visitor = part.column("visitor").to_numpy(zero_copy_only=False)
            hashes, first = shingles(part.column("text"), size)
            cut = np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(1) | (visitor[1:] != visitor[:-1])))
            found: list = []
            for lo, hi in zip(cut, np.append(cut[1:], len(ids))):
                if key is None or tuple(where[lo]) != key:
                    key, have = tuple(where[lo]), (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                new = (hashes[first[lo]:first[hi]], first[lo:hi + 1] - first[lo], ids[lo:hi], labels[lo:hi])
                if len(have[2]):
                    linked(found, have, new)
                if not visitor[lo]:
                    owner = np.repeat(np.arange(hi - lo), np.diff(new[1]))
                    order = np.argsort(new[0], kind="stable")
                    own = (new[0][order], owner[order], new[2], new[3], np.diff(new[1]))
                    linked(found, own, new)
                    both, who = np.concatenate([have[0], new[0]]), np.concatenate([have[1], owner + len(have[2])])
                    order = np.argsort(both, kind="stable")
                    have = (both[order], who[order], *(np.concatenate([x, y]) for x, y in zip(have[2:], own[2:])))
            a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    return run


def deciders(docs: DataFrame, speaker: DataFrame, scratch: Scratch, size: int, percent: int, seed: int = 0):
    """Two functions that judge sets by their texts: ``confirmed`` pairs and ``decided`` clusters.

    ``speaker`` (id, doc_id, tkey) names the row of ``docs`` whose text stands for the set, -1 for a NULL doc_id.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "tkey", "text")

    def with_texts(wanted: DataFrame) -> DataFrame:
        """(id, text) of the wanted ids; no other text travels on from the join."""
        return texts.join(wanted.distinct().join(speaker, "id"), ["doc_id", "tkey"]).dropDuplicates(["id"]).select("id", "text")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that hold on their full sets."""
        whole = scratch.store(with_texts(pairs.select(F.col("a").alias("id")).union(pairs.select("b"))))
        a, b = whole.select(F.col("id").alias("a"), F.col("text").alias("ta")), whole.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        good = scratch.store(pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(_confirm(size, percent), "a long, b long"))
        scratch.drop(whole)
        return good

    def decided(clusters: DataFrame) -> DataFrame:
        """The links between classes inside the clusters (cluster, id, label)."""
        per = clusters.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
        per = (per.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("classes"))
               .where("classes > 1").select("cluster", "n", F.col("most.n").alias("g"), F.col("most.label").alias("main")))
        placed = clusters.join(scratch.store(per), "cluster")
        n_g, n_r = F.ceil(F.col("g") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("g")) / BLOCK).cast("int")
        spread = F.xxhash64("id", F.lit(seed + 2))
        one, receives = F.col("n") <= BLOCK, F.col("label") == F.col("main")
        own = F.when(one, F.lit(0)).when(receives, F.pmod(spread, n_g).cast("int")).otherwise(n_g + F.pmod(spread, n_r).cast("int"))
        placed = placed.withColumns({"own": own, "g": n_g, "all": n_g + n_r})
        blocks = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda b: (b < F.col("g")) | (b > F.col("own")))
        visits = F.when(one | receives, F.array().cast("array<int>")).otherwise(blocks)
        at = F.concat(F.array(F.struct(F.col("own").alias("block"), F.lit(False).alias("visitor"))), F.transform(visits, lambda b: F.struct(b.alias("block"), F.lit(True).alias("visitor"))))
        rows = scratch.store(placed.select("cluster", "id", "label", F.explode(at).alias("at")).select("cluster", "id", "label", "at.*"))
        whole = scratch.store(with_texts(rows.select("id")))
        return (rows.join(whole, "id").repartition("cluster", "block").sortWithinPartitions("cluster", "block", "visitor", "id")
                .mapInArrow(_meet(size, percent), "a long, b long"))

    return confirmed, decided


def links(docs: DataFrame, scratch: Scratch, size: int = SHINGLE, percent: int = PERCENT, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, roots): every row's set (doc_id, tkey, n_shingles, id), where ``id`` names the set and is the
    smallest doc_id with it, and the component root of every set that is linked with another."""
    members = scratch.store(docs.mapInArrow(_embed(size), "doc_id long, tkey long, n_shingles long, s1 long, s2 long, sig array<int>"))
    # Rows without id get one from their set; it is above all real ones, and shown as NULL again.
    own = F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("s1", "s2", "tkey"), 2).bitwiseOR(F.lit(1 << 62)))
    sets = scratch.store(members.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(own).alias("id"), F.first("sig").alias("sig")))
    ids = sets.select("s1", "s2", "id")
    speaker = (members.join(ids, ["s1", "s2"]).where(own == F.col("id"))
               .groupBy("id").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "tkey")).alias("k")).select("id", "k.*"))

    confirmed, decided = deciders(docs, speaker, scratch, size, percent, seed)

    def branched(rows: DataFrame, first: bool) -> DataFrame:
        """The children of every row: positions chosen by the path, documents sent on by their value there."""
        if first:
            at = F.array(*[F.lit(int(p)) for p in np.random.default_rng(seed + 1).permutation(SIGNATURE)[:TREES * BRANCHES]])
        else:  # two positions at every other node, one at the rest: 1.5 on average, so that pairs far below the threshold die out
            at = F.transform(F.slice(F.array(*[F.lit(i) for i in range(DEEPER)]), 1, (1 + F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(DEEPER))).cast("int")),
                             lambda j: F.pmod(F.xxhash64("node", j, F.lit(seed + 1)), F.lit(SIGNATURE)).cast("int"))
        node = F.transform(at, lambda p: F.xxhash64(F.col("node"), p, F.element_at("sig", p + 1)))
        return rows.withColumn("node", F.explode(F.array_distinct(node)))

    start = sets.select("id", F.lit(0).cast("long").alias("node"), "sig")
    spread = branched(start, True).select("node", "id")
    heads = spread.groupBy("node").agg(F.min("id").alias("head"), F.max("id").alias("_last")).where("head < _last").drop("_last")
    rows = scratch.store(spread.join(heads, "node"))
    near = (rows.where("id <> head").groupBy("id", "head").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {BRANCHES - 1}")
            .groupBy("id").agg(F.min(F.struct(-F.col("n"), F.col("head"))).alias("k"))
            .select(F.col("id").alias("a"), F.col("k.head").alias("b")))
    edges = confirmed(scratch.store(near))
    roots = components(edges, scratch)

    level, found = rows.select("node", "id"), None
    for depth in range(1, DEPTH + 1):
        labelled = scratch.store(level.join(roots, "id", "left").select("node", "id", F.coalesce("root", "id").alias("label")))
        per = labelled.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
        open_ = (per.groupBy("node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
                 .select("node", ((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs")).where("pairs > 0"))
        open_ = scratch.store(labelled.join(open_, "node"))
        small = open_.where(F.col("pairs") <= PAIRS).join(sets.select("id", "sig"), "id").select("node", "id", "label", "sig")
        got = small.repartition("node").sortWithinPartitions("node", "id").mapInArrow(_compare(KEEP), "a long, b long")
        large = open_.where(F.col("pairs") > PAIRS).select("node", "id", "label")
        more = not large.isEmpty()
        if more and depth == DEPTH:
            heads = large.groupBy("node").agg(F.min("id").alias("b"))
            got = got.unionByName(large.join(heads, "node").where("id <> b").select(F.col("id").alias("a"), "b"))
        got = scratch.store(got.distinct())
        found = got if found is None else found.unionByName(got)
        if not more or depth == DEPTH:
            break
        level = branched(large.select("node", "id").join(sets.select("id", "sig"), "id"), False).select("node", "id")
    clusters = components(found.distinct(), scratch)
    labelled = clusters.join(roots, clusters["id"] == roots["id"], "left").select(
        clusters["root"].alias("cluster"), clusters["id"], F.coalesce(roots["root"], clusters["id"]).alias("label"))
    more_edges = scratch.store(decided(scratch.store(labelled)).distinct())
    if not more_edges.isEmpty():
        roots = components(edges.unionByName(more_edges), scratch)
    keys = members.join(ids, ["s1", "s2"], "left").select("doc_id", "tkey", "n_shingles", own.alias("own"), F.when(F.col("n_shingles") > 0, F.col("id")).alias("id"))
    return keys, roots


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, tkey, n_shingles, component_id (the smallest doc_id reachable), kept."""
    scratch = Scratch(docs.sparkSession)
    keys, roots = links(rows_of(docs, id_col, text_col), scratch, size, percent)
    out = keys.join(roots, "id", "left").withColumn("_c", F.coalesce("root", "id", "own"))
    return out.select("doc_id", "tkey", "n_shingles", F.when(F.col("_c") < (1 << 62), F.col("_c")).alias("component_id"), (F.col("own") == F.col("_c")).alias("kept"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group left, all columns as they were.

    The kept one is the smallest id. A row that repeats another (same id and text) goes too.
    """
    scratch = Scratch(docs.sparkSession)
    judged = near_duplicates(docs, size, percent, id_col, text_col)
    stay = scratch.store(judged.where("kept").groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("_times")))
    same = F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("x.doc_id")) & (F.xxhash64(F.coalesce(F.col(f"d.{text_col}").cast("string"), F.lit(""))) == F.col("x.tkey"))
    if stay.where("_times > 1").isEmpty():
        return docs.alias("d").join(stay.alias("x"), same, "left_semi")
    once = docs.alias("d").join(stay.where("_times = 1").alias("x"), same, "left_semi")
    again = docs.alias("d").join(stay.where("_times > 1").alias("x"), same, "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(again)
