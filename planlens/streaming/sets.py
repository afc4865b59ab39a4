"""Sets whose pages arrive over time: a set is reviewed once it is complete, and again if more of it arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from planlens.session import cut_lineage
from planlens.sources.sinks import read_reports, write_reports


def closing_sets(marks: DataFrame, done: DataFrame, quiet: str) -> DataFrame:
    """set_id of the sets to review now.

    ``marks``: set_id, batch, last (timestamp), ended, one row per set and batch; ``done``: set_id, batch of earlier reviews. A set is
    complete when an end mark has come or nothing of it for ``quiet`` (an interval) before the newest row of all; a set
    reviewed already is reviewed again only if rows came after that. NULL times never close a set.
    """
    sets = marks.groupBy("set_id").agg(F.max("last").alias("last"), F.coalesce(F.bool_or("ended"), F.lit(False)).alias("ended"), F.max("batch").alias("touched"))
    newest = marks.agg(F.max("last").alias("t")).first()["t"]  # one value
    seen = done.groupBy("set_id").agg(F.max("batch").alias("reviewed"))
    still = F.lit(False) if newest is None else F.coalesce(F.col("last") <= F.lit(newest) - F.expr(f"INTERVAL {quiet}"), F.lit(False))
    out = sets.join(seen, "set_id", "left").where((F.col("ended") | still) & (F.col("reviewed").isNull() | (F.col("touched") > F.col("reviewed"))))
    return out.select("set_id")


def review_sets(arrivals: DataFrame, review: Callable[[DataFrame], dict[str, DataFrame]], path: str, quiet: str = "1 day") -> StreamingQuery:
    """Review each set of a stream when it is complete and commit its reports together under ``path``.

    ``arrivals``: set_id, at (timestamp), ended (boolean) and the columns ``review`` reads; rows with a NULL set_id are left
    out. ``review`` is the batch function from rows of whole sets to named frames that carry set_id. Rows are
    kept once, by batch; per set and batch one mark is kept, and only marks are read again in every batch. A batch replaces its own
    rows and marks and commits by one manifest, so a batch run again changes nothing.
    """
    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.where("set_id is not null").write.mode("overwrite").parquet(f"{path}/rows/stream_batch={n}")
        mine = spark.read.schema(batch.schema).parquet(f"{path}/rows/stream_batch={n}")
        mine.groupBy("set_id").agg(F.max("at").alias("last"), F.bool_or("ended").alias("ended")).write.mode("overwrite").parquet(f"{path}/marks/batch={n}")
        marks = spark.read.parquet(f"{path}/marks").where(F.col("batch") <= n)
        if n:
            done = read_reports(spark, path, ["sets"])["sets"].select("set_id", F.col("job").cast("int").alias("batch")).where(F.col("batch") < n)
        else:
            done = marks.select("set_id", "batch").where("false")
        closing = cut_lineage(closing_sets(marks, done, quiet))
        rows = spark.read.parquet(f"{path}/rows").where(F.col("stream_batch") <= n).drop("stream_batch").join(closing, "set_id", "left_semi")
        write_reports(review(rows) | {"sets": closing}, path, f"{n:09d}")
    return (arrivals.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())


def set_reports(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The frames of each set's last review."""
    got = read_reports(spark, path, ["sets", *names])
    last = cut_lineage(got["sets"].groupBy("set_id").agg(F.max("job").alias("job")))
    return {name: got[name].join(last, ["set_id", "job"]).drop("job") for name in names}


def waiting_sets(spark: SparkSession, path: str) -> DataFrame:
    """set_id of the sets with rows that no review has read yet: open ones, and reviewed ones of which more arrived."""
    touched = spark.read.parquet(f"{path}/marks").groupBy("set_id").agg(F.max("batch").alias("touched"))
    seen = read_reports(spark, path, ["sets"])["sets"].groupBy("set_id").agg(F.max(F.col("job").cast("int")).alias("reviewed"))
    return touched.join(seen, "set_id", "left").where("reviewed is null or touched > reviewed").select("set_id")
