"""What the text operators share: keys of rows, whole texts as numpy words, scratch tables, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planlens.session import ensure_checkpoint_dir

U64 = np.uint64
CHUNK_BYTES = 1 << 20  # text bytes an Arrow function works on at once, some 60 MB of numpy arrays; a longer text is a chunk of its own
MASK = (1 << 64) - 1


def text_key(text: str = "text") -> Column:
    """A second key beside the id, so that rows with equal or NULL ids but other texts stay apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tkey, text): all an operator reads, whatever else the table holds. NULL text becomes empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))


# ---------------------------------------------------------------- scratch

class Scratch:
    """Tables written into the shared folder that ``spark.checkpoint.dir`` names, and read back.

    A written table cuts the lineage, survives lost executors, and carries its true size, so
    that Spark decides on broadcasts by measurement. ``drop`` removes one no longer needed.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/planlens-{uuid.uuid4().hex}"
        self.made = 0

    def path(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made}"

    def store(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        path = self.path()
        df.write.parquet(path, compression=codec)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Remove all tables; what was computed from them must be stored elsewhere by now."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- texts in Arrow batches

def give_back() -> None:
    """Return freed memory to the machine: a worker lives on between tasks, and what it keeps adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices of at most ``limit`` text bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, lo = np.cumsum(sizes), 0
        while lo < batch.num_rows:
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row starts and ends in them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def _table(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in spans:
        out[lo:hi + 1] = True
    return out


SPACE = _table((0x20, 0x20), (0x09, 0x0D))  # what stands between words [^\x20\x09-\x0D]+
NOT_WORD = _table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))  # ... between words of letters, digits and non-ASCII
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes, and the first word of each row (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~between[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    word = inside[1:-1]
    starts = np.flatnonzero(word & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(word & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- hashes

def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finalizer of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Rolling:
    """Polynomial (Rabin-Karp) hashes modulo 2^64 of any span of a sequence, from prefix sums.

    The odd base has an inverse, so a span's sum is shifted back by its start and depends on
    the span's content alone.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62)) * 4 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.bytes = rng.integers(1 << 64, size=256, dtype=U64)
        self.salt = U64(rng.integers(1 << 62) * 2 + 1)  # so that spans of one value differ between hashers
        self.powers = self.back = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n + n // 4, 1 << 16)
            for name, base in (("powers", self.base), ("back", self.inverse)):
                steps = np.full(n, base & MASK, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        total = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.powers[:len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.back[starts] + (ends - starts).astype(U64) * self.salt)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.spans(self.bytes[data], starts, ends)

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """The hash of every window of ``size`` neighbours; windows over a row's end are the caller's to leave out."""
        starts = np.arange(max(0, len(hashes) - size + 1))
        return self.spans(hashes, starts, starts + size)


FIRST, SECOND = Rolling(1), Rolling(2)


def runs(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers lo, lo+1, ... (count of them) of every row, one row after the other."""
    count = np.maximum(count, 0)
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - count), count)


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


# ---------------------------------------------------------------- components

def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root): the smallest id reachable over ``edges(a, b)``, for ids that have an edge.

    Every node points at its smallest neighbour; pointers are followed until they stand still;
    edges between the trees are kept, in terms of their roots, for the next round. A round
    halves the trees that still have edges, so rounds grow with the logarithm of their number.
    Nothing but counts reaches the driver; each step is a table in the shared folder.
    """
    live = scratch.store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = None
    while True:
        if live.isEmpty():
            break
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = scratch.store(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
                             .select("id", F.least("id", "near").alias("root")))
        while True:
            up = tree.where("id <> root").select(F.col("id").alias("root"), F.col("root").alias("higher"))
            step = scratch.store(tree.join(up, "root", "left").select("id", F.coalesce("higher", "root").alias("root"),
                                                                      F.col("higher").isNotNull().alias("moved")))
            moved = not step.where("moved").isEmpty()
            scratch.drop(tree)
            tree = step
            if not moved:
                break
        tree = _slim(tree)
        if known is None:
            merged = tree
        else:
            over = tree.select(F.col("id").alias("root"), F.col("root").alias("higher"))
            merged = scratch.store(known.join(over, "root", "left").select("id", F.coalesce("higher", "root").alias("root")))
        a, b = tree.select(F.col("id").alias("a"), F.col("root").alias("ra")), tree.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        rest = scratch.store(live.join(a, "a").join(b, "b").where("ra <> rb")
                             .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        scratch.drop(live)
        known, live = merged, rest
    return known if known is not None else live.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _slim(tree: DataFrame) -> DataFrame:
    out = tree.select("id", "root")
    out._scratch = tree._scratch
    return out
