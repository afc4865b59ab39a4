"""Sinks for finished reviews."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from planlens.session import cut_lineage


def write_review(df: DataFrame, path: str, fmt: str = "parquet", buckets: int = 64,
                 by_set: bool = False, mode: str = "append") -> None:
    """Write register rows so that one set is read back from few files.

    By default sets are spread over a fixed number of folders: one folder per set does not
    scale to millions of sets. ``by_set`` asks for a folder per set where sets are few.
    """
    if by_set:
        df.write.mode(mode).format(fmt).partitionBy("set_id").save(path)
        return
    bucketed = df.withColumn("set_bucket", F.pmod(F.xxhash64("set_id"), F.lit(buckets)).cast("int"))
    # rows of one folder spread over several tasks by content, so a hot set is split as well
    bucketed = bucketed.repartition("set_bucket", F.pmod(F.xxhash64(*df.columns[:4]), F.lit(8)))
    bucketed.write.mode(mode).format(fmt).partitionBy("set_bucket").save(path)


def write_reports(outputs: dict[str, DataFrame], path: str, job: str) -> None:
    """Write several frames so that readers see all of them or none.

    Each frame goes to a folder of this attempt; one manifest file, written last, commits them together. A job run again
    commits a new attempt that replaces the former for readers, and an attempt that died leaves rows nobody reads. A frame of one
    name has the same columns in every job.
    """
    spark, attempt = next(iter(outputs.values())).sparkSession, f"a{uuid.uuid4().hex}"
    for name, df in outputs.items():
        df.write.parquet(f"{path}/reports/{name}/attempt={attempt}")
    row = spark.createDataFrame([(job, time.time_ns())], "job string, at bigint").coalesce(1)
    row.write.parquet(f"{path}/manifests/attempt={attempt}")


def read_reports(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The frames of every job's last committed attempt, with ``job``; all show the same commits, those made before the call."""
    made = spark.read.parquet(f"{path}/manifests")
    last = cut_lineage(made.groupBy("job").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt")))
    return {name: spark.read.parquet(f"{path}/reports/{name}").join(last, "attempt").drop("attempt") for name in names}
