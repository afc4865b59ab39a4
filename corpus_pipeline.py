"""A training corpus from raw documents: toxic ones go, one of each group of near copies stays, contaminated ones
go, sources are mixed to their weights, and the rest is shuffled into shards.

Every stage takes (spark, docs, sf_dir) and returns a frame; it is written and reread before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planlens.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from planlens.llm.common import Scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shuffled_shards(docs)


STAGES = [("toxicity", without_toxic), ("near_dedup", without_near_copies), ("decontamination", without_benchmark), ("mixing", mixed_sources), ("sharding", into_shards)]
ORACLE_SQL = None  # learned scores, minwise hashes and seeded draws: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        docs = scratch.store(out)
