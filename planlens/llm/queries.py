"""The registered queries of the text operators: each applies its operator to a whole table and derives digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planlens.llm import (chat, collocations, decontaminate, fill_in_middle, fingerprints, html_text, line_dedup, mixing, near_dedup, sharding,
                          substring_dedup, toxicity, warc)
from planlens.llm.common import Scratch
from planlens.llm.oracle import ORACLE  # noqa: F401


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sha(text: Column | str) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, folder, "documents"), with_text=False)


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shuffled_shards(_table(spark, folder, "documents").select("doc_id", "text"), shards=40)
    return out.select("doc_id", sharding.row_bytes().alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
                      F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.drop_frequent_lines(_table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", _sha("kept_text").alias("kept_sha256"))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    groups = fingerprints.similar_groups(docs)
    return fingerprints.fingerprint_neighbours(docs).join(groups, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = near_dedup.near_duplicates(_table(spark, folder, "documents"), size=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"), Scratch(spark).path())


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    # The planted conversation is made of rows of the session's own, not of the table.
    planted = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(chat.format_conversations(rows.unionByName(planted.select(*[F.col(c).cast(t).alias(c) for c, t in rows.dtypes]))))


def read_back(formatted: DataFrame) -> DataFrame:
    read = chat.read_loss(chat.expand(formatted, keep=True))
    out = read.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), "loss")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _sha(said).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                      _sha("loss").alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    out = fill_in_middle.transform(_table(spark, folder, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha("output").alias("output_sha256"),
                      _sha(fill_in_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_substring_dedup, op2_sharding, op3_line_dedup, op4_fingerprints, op5_decontamination, op6_near_dedup, op7_warc, op8_chat, op9_toxicity,
    op10_mixing, op11_html_text, op12_collocations, op13_fill_in_middle, pipeline)}
