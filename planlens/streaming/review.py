"""New sets flow through the same batch functions as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def review_stream(arrivals: DataFrame, review: Callable[[DataFrame], DataFrame], path: str) -> StreamingQuery:
    """Review each micro-batch of arriving sets and add its rows to ``path``.

    ``review`` is the batch function. A batch writes only its own folder and replaces it whole,
    so a batch run again after a failure leaves one copy. A set must arrive within one batch, as
    a finished upload does.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        review(batch).write.mode("overwrite").parquet(f"{path}/reviews/batch_id={batch_id}")
    return (arrivals.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/state")
            .trigger(availableNow=True).start())


def reviewed(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/reviews")
