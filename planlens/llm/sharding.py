"""Sharding by a two-pass external shuffle.

Pass one scatters the rows into buckets that fit a task's memory, by a seeded hash; pass two puts
each bucket into one task, orders it by content, and permutes it with a seeded Fisher-Yates
shuffle. The shuffled buckets, one after the other, are the shuffled table; shard k of n holds its
rows from k*N/n to (k+1)*N/n, so shard sizes differ by one row at most (the law ``rows``).

The number of buckets follows from the measured bytes. Only the row count of each bucket reaches
the driver (one number per ``BUCKET_BYTES`` of text). A rerun gives the same shards: bucket,
order and permutation depend on the rows and the seed alone.

Defined cases: NULL text counts as empty; NULL and repeated ids are spread by their text; rows
repeated exactly are interchangeable, share a bucket, and get slots of their own.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from planlens.llm.common import give_back

LAW = "rows"
BUCKET_BYTES = 4 << 20
ROW_BYTES = 16  # what a row counts beside its text


def row_bytes(text_col: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + ROW_BYTES


def _shuffle(seed: int, before: dict[int, int], total: int, shards: int, id_col: str, text_col: str):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("_bucket")[0].as_py()
        table = table.take(pc.sort_indices(table, [(id_col, "ascending"), ("_tkey", "ascending")]))
        order = np.random.default_rng([seed, bucket]).permutation(table.num_rows)  # Fisher-Yates
        at = before[bucket] + np.arange(table.num_rows)  # the row's place in the whole shuffled table
        starts = [-(-k * total // shards) for k in range(shards)]
        shard = np.array([bisect_right(starts, int(p)) - 1 for p in at], np.int32)
        slot = at - np.array(starts)[shard]
        out = table.drop_columns(["_bucket", "_tkey"]).take(pa.array(order))
        del table
        give_back()
        return out.append_column("shard", pa.array(shard)).append_column("slot", pa.array(slot.astype(np.int64)))
    return run


def shuffled_shards(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``docs`` with its columns and shard, slot (columns of those names are replaced)."""
    docs = docs.drop("shard", "slot", "_bucket", "_tkey")
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    size = docs.agg(F.sum(row_bytes(text_col))).first()[0] or 0
    n = max(1, -(-size // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), key), F.lit(n)).cast("int")
    counts = {r["b"]: r["n"] for r in docs.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for b in sorted(counts):
        before[b], total = total, total + counts[b]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", shard int, slot long"
    scattered = docs.withColumns({"_bucket": bucket, "_tkey": key})
    return scattered.groupBy("_bucket").applyInArrow(_shuffle(seed, before, total, shards, id_col, text_col), schema)


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 17, **options) -> None:
    """The shards as Parquet, one folder each, rows in slot order within a file."""
    out = shuffled_shards(docs, shards, seed, **options)
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
