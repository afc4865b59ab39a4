"""Why rules stood down: classes, what would unlock them, and root causes per set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planlens.functions import vocabulary as V

# ---- fixed values: reason patterns in order, first match wins -------------------------------
REASONS = [
    ("rule raised", "error"), ("withdrawn by the (ai )?result review", "withdrawn"),
    ("switched off in the review options", "option"),
    ("not carried in this build'?s corpus", "corpus"), ("has no single gross factor", "corpus"),
    ("no asce 7 edition is recorded", "corpus"), ("no asce 7 adoption recorded", "corpus"),
    ("carries no effective date", "corpus"), ("no cad layer matching", "geometry"),
    ("carries no line geometry", "geometry"), ("scale unresolved", "geometry"),
    ("neither the drawings nor the declaration state this", "absent"),
    ("not stated on the drawings and not answered", "absent"),
    (r"does not name a table 1004\.5 function", "absent"), ("applies only to", "not_applicable"),
    ("nothing to compare", "not_applicable"), ("not extracted", "extraction"),
    ("no parseable", "extraction"), ("no code datum", "extraction"),
    ("schedule extracted|schedule found", "extraction"),
    ("no load calculation table found", "extraction"), ("no outside-air column", "extraction"),
    ("not found (in|on)", "extraction"), ("row not found", "extraction"),
    ("no area to apply", "extraction"), ("reporting floor", "extraction"),
    ("field not reconciled", "extraction"), ("no sheets to identify", "extraction"),
]
PROPOSABLE = ["extraction", "geometry", "corpus", "withdrawn", "error", "unknown"]


def reason_kind(reason: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    return F.coalesce(*[F.when(t.rlike(p), F.lit(k)) for p, k in REASONS], F.lit("unknown"))


def classify(abstentions: DataFrame, profile: DataFrame) -> DataFrame:
    """Kind of every abstention. ``profile``: set_id, region_pages ARRAY<INT>, converted BOOLEAN.

    What nobody states becomes an extraction gap where the set has picture regions nobody read.
    """
    p = profile.select("set_id", (F.size("region_pages") > 0).alias("_pics"), "converted")
    unread = F.coalesce(F.col("_pics") & ~F.coalesce("converted", F.lit(False)), F.lit(False))
    kind = reason_kind(F.col("reason"))
    return (abstentions.join(p, "set_id", "left")
            .withColumn("kind", F.when((kind == "absent") & unread, "extraction").otherwise(kind))
            .withColumn("proposable", F.col("kind").isin(PROPOSABLE)).drop("_pics", "converted"))


def unlocked_by(questions: DataFrame) -> DataFrame:
    """(rule_id, fields): the questions whose answer would let a rule run."""
    rows = questions.select("ord", "field", F.explode("unlocks").alias("rule_id"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "field"))), lambda x: x["field"])
    return rows.groupBy("rule_id").agg(listed.alias("fields"))  # at most the fifteen questions


def diagnose(classified: DataFrame, profile: DataFrame) -> DataFrame:
    """Root causes that would account for several abstentions of a set at once.

    ``profile``: set_id, region_pages, raster_pages ARRAY<INT>, converted, cad_layers,
    measured_off. Pages come out 1-based.
    """
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    counts = classified.groupBy("set_id").agg(n("extraction"), n("geometry"), n("corpus"), n("error"))
    f = profile.join(counts, "set_id", "left").fillna(
        0, ["n_extraction", "n_geometry", "n_corpus", "n_error"])
    unread = ~F.coalesce("converted", F.lit(False))
    pages = lambda c: F.transform(F.array_sort(F.array_distinct(c)), lambda p: p + 1)
    none = F.array().cast("array<int>")

    def cause(when: Column, key: str, count: Column, sheets: Column, rerun: bool) -> Column:
        return F.when(when, F.struct(F.lit(key).alias("cause"), count.cast("bigint").alias("n"),
                                     sheets.alias("sheets"), F.lit(rerun).alias("rerun")))
    rows = F.array_compact(F.array(
        cause((F.size("region_pages") > 0) & unread & (F.col("n_extraction") >= V.STARVED_FLOOR),
              "pasted_code_table", F.col("n_extraction"), pages(F.col("region_pages")), True),
        cause((F.size("raster_pages") > 0) & unread, "scanned_sheets",
              F.size(F.array_distinct("raster_pages")), pages(F.col("raster_pages")), True),
        cause((F.col("n_geometry") > 0) & ~F.coalesce("measured_off", F.lit(False)), "no_layers",
              F.col("n_geometry"), none, False),
        cause(F.col("n_corpus") > 0, "corpus_gap", F.col("n_corpus"), none, False),
        cause(F.col("n_error") > 0, "rule_error", F.col("n_error"), none, False)))
    return f.select("set_id", F.explode(rows).alias("d")).select("set_id", "d.*")


def prefill_verdict(reason: Column, unread_regions: Column) -> Column:
    """The feedback verdict an abstention argues for; NULL where it argues for none."""
    k = reason_kind(reason)
    return (F.when((k == "absent") & unread_regions, "data_in_image").when(k == "extraction", "data_on_sheet")
            .when(k == "geometry", "layer_named_differently").when(k == "corpus", "corpus_missing")
            .when(k == "error", "rule_failed"))
