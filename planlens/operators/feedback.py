"""Reviewer feedback: checking, routing, queues and the exported markup pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from planlens.functions import vocabulary as V

LADDER = ["confirmation", "auto_tunable", "needs_component", "escalate"]

# ---- fixed values: the taxonomy ----------------------------------------------------------
# subject, aspect, must be answered, verdict, remedy, knob, delta
TAXONOMY = [
    ("finding", "conclusion", False, "correct", "good", None, None),
    ("finding", "conclusion", False, "false_positive", "tunable", "severity_shift", "-1"),
    ("finding", "conclusion", False, "not_applicable", "tunable", "scope_occupancy", "exclude"),
    ("finding", "conclusion", False, "right_wrong_reason", "judgement", None, None),
    ("finding", "conclusion", False, "duplicate", "component", None, None),
    ("finding", "severity", False, "right", "good", None, None),
    ("finding", "severity", False, "overstated", "tunable", "severity_shift", "-1"),
    ("finding", "severity", False, "understated", "tunable", "severity_shift", "1"),
    ("finding", "severity", False, "not_a_finding", "tunable", "enabled", "false"),
    ("finding", "citation", False, "right", "good", None, None),
    ("finding", "citation", False, "wrong_section", "judgement", None, None),
    ("finding", "citation", False, "wrong_edition", "judgement", None, None),
    ("finding", "citation", False, "exception_missed", "judgement", None, None),
    ("finding", "citation", False, "no_citation", "judgement", None, None),
    ("finding", "evidence", False, "right", "good", None, None),
    ("finding", "evidence", False, "misread_value", "component", None, None),
    ("finding", "evidence", False, "misread_table", "component", None, None),
    ("finding", "evidence", False, "wrong_scale", "component", None, None),
    ("finding", "evidence", False, "superseded", "component", None, None),
    ("finding", "location", False, "right", "good", None, None),
    ("finding", "location", False, "wrong_anchor", "component", None, None),
    ("finding", "location", False, "wrong_sheet", "component", None, None),
    ("finding", "clarity", False, "clear", "good", None, None),
    ("finding", "clarity", False, "ambiguous", "judgement", None, None),
    ("finding", "clarity", False, "no_action", "judgement", None, None),
    ("finding", "clarity", False, "too_technical", "judgement", None, None),
    ("coverage", "gap", True, "missed_violation", "component", None, None),
    ("coverage", "gap", True, "missed_check", "component", None, None),
    ("coverage", "gap", True, "avoidable_abstention", "component", None, None),
    ("coverage", "gap", True, "sheet_not_reviewed", "component", None, None),
    ("abstention", "standdown", True, "correctly_abstained", "good", None, None),
    ("abstention", "standdown", True, "data_on_sheet", "component", None, None),
    ("abstention", "standdown", True, "data_in_image", "component", None, None),
    ("abstention", "standdown", True, "layer_named_differently", "component", None, None),
    ("abstention", "standdown", True, "corpus_missing", "judgement", None, None),
    ("abstention", "standdown", True, "rule_failed", "component", None, None),
    ("abstention", "standdown", True, "should_not_apply", "tunable", "scope_occupancy", "exclude"),
    ("sweep", "sweep", True, "agrees", "good", None, None),
    ("sweep", "sweep", True, "missed_items", "component", None, None),
    ("sweep", "sweep", True, "wrong_items", "judgement", None, None),
    ("sweep", "sweep", True, "mixed", "judgement", None, None),
    ("sweep", "sweep", True, "unreadable_set", "component", None, None),
]
NEEDS_REGION = ["highlight", "box", "cloud", "strikeout"]
NEEDS_PATH = ["arrow", "freehand"]
SUBJECTS = sorted({t[0] for t in TAXONOMY})


def taxonomy(spark: SparkSession) -> DataFrame:
    """(subject, aspect, required, verdict, remedy, knob, delta)."""
    return spark.createDataFrame(TAXONOMY, "subject string, aspect string, required boolean, "
                                           "verdict string, remedy string, knob string, delta string")


def validate_feedback(feedback: DataFrame, tax: DataFrame) -> DataFrame:
    """Problems as rows: unknown subject, unknown aspect, unknown verdict, missing required."""
    known = F.col("subject").isin(SUBJECTS)
    bad_subject = feedback.where(~known).select("id", F.col("subject").alias("item"),
                                                F.lit("unknown subject").alias("problem"))
    given = feedback.where(known).select("id", "subject", F.explode("answers").alias("aspect", "verdict"))
    aspects = F.broadcast(tax.select("subject", "aspect", "required").distinct())
    verdicts = F.broadcast(tax.select("subject", "aspect", "verdict", F.lit(True).alias("_v")))
    checked = (given.join(aspects, ["subject", "aspect"], "left")
               .join(verdicts, ["subject", "aspect", "verdict"], "left"))
    bad = checked.where("_v is null").select(
        "id", F.when(F.col("required").isNull(), F.col("aspect")).otherwise(F.col("verdict")).alias("item"),
        F.when(F.col("required").isNull(), "unknown aspect").otherwise("unknown verdict").alias("problem"))
    must = aspects.where("required")
    missing = (feedback.join(must, "subject").where(~F.array_contains(F.map_keys("answers"), F.col("aspect")))
               .select("id", F.col("aspect").alias("item"), F.lit("must be answered").alias("problem")))
    return bad_subject.unionByName(bad).unionByName(missing)


def markup_complaints(markups: DataFrame) -> DataFrame:
    """Markups whose geometry cannot mean anything for their kind."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    flat = (z("x0") == z("x1")) | (z("y0") == z("y1"))
    short = F.size(F.coalesce("points", F.array().cast("array<array<double>>"))) < 2
    why = (F.when(F.col("kind").isin(NEEDS_PATH) & short, "needs at least two points")
           .when(F.col("kind").isin(NEEDS_REGION) & flat, "marks a region with no area"))
    return markups.withColumn("complaint", why).where("complaint is not null")


def triage(feedback: DataFrame, tax: DataFrame, profile_rules: DataFrame) -> DataFrame:
    """Where each submission has to be fixed, with the signals that decided it.

    ``feedback``: id, rule_id, subject, answers, comment, occupancy_group. A written comment
    nobody has read escalates; nothing ever moves down the ladder.
    """
    verdicts = F.broadcast(tax.select("aspect", "verdict", "remedy", "knob", "delta"))
    cal = profile_rules.select(
        "rule_id", F.col("severity_shift").alias("now_shift"), F.col("enabled").alias("now_enabled"),
        F.col("scope_occupancy").alias("now_scope"), "confirmations", F.lit(True).alias("_has"))
    a = (feedback.select("id", "rule_id", "occupancy_group", F.explode("answers").alias("aspect", "verdict"))
         .join(verdicts, ["aspect", "verdict"]).join(cal, "rule_id", "left"))
    defect = F.col("remedy") != "good"
    tunable = defect & (F.col("remedy") == "tunable")
    wish = F.coalesce("now_shift", F.lit(0)) + F.col("delta").try_cast("int")
    held = F.greatest(F.lit(-V.MAX_SHIFT), F.least(F.lit(V.MAX_SHIFT), wish))
    is_shift, is_scope = F.col("knob") == "severity_shift", F.col("knob") == "scope_occupancy"
    no_group = F.coalesce("occupancy_group", F.lit("")) == ""
    scope = F.coalesce("now_scope", F.array().cast("array<string>"))
    grown = F.array_sort(F.array_union(scope, F.array("occupancy_group")))
    resettled = F.coalesce(
        F.when(is_shift, (F.col("now_shift") != 0) & (F.col("now_shift") != held))
        .when(is_scope & ~no_group, (F.size(scope) > 0) & (grown != F.array_sort(scope)))
        .when(F.col("knob") == "enabled", F.lit(False)), F.lit(False))
    flag = lambda c: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))
    per = a.groupBy("id").agg(
        flag(defect).alias("defect"), F.count_if(F.col("remedy") == "good").alias("praise"),
        flag(F.col("remedy") == "judgement").alias("judgement"),
        flag((F.col("remedy") == "judgement") & (F.col("aspect") == "citation")).alias("citation"),
        flag(F.col("remedy") == "component").alias("component"),
        flag(tunable & F.col("knob").isNull()).alias("no_lever"),
        flag(tunable & is_shift & (wish != held)).alias("out_of_bounds"),
        flag(tunable & is_scope & no_group).alias("no_occupancy"),
        flag(tunable & F.col("_has") & (F.col("confirmations") >= V.CONTESTED_AT)).alias("contested"),
        flag(tunable & F.col("_has") & resettled).alias("recalibrates"))
    f = feedback.select("id", "rule_id", "comment").join(per, "id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    commented = F.trim(F.coalesce("comment", F.lit(""))) != ""
    routed_j, routed_c = no("judgement"), no("component") & ~no("judgement")
    lever = no("defect") & ~no("judgement") & ~no("component")
    soft = lever & (no("no_lever") | no("out_of_bounds") | no("no_occupancy"))
    settled = lever & ~soft & (F.coalesce("rule_id", F.lit("")) != "") & (no("contested") | no("recalibrates"))
    rank = F.greatest(
        F.when(routed_j | soft | settled, 3).when(routed_c, 2).when(lever, 1).otherwise(0),
        F.when(commented, 3).otherwise(0))
    confirmed = ~no("defect") & (F.coalesce("praise", F.lit(0)) > 0) & (F.coalesce("rule_id", F.lit("")) != "")
    names = [("confirmed", confirmed), ("empty", ~no("defect") & ~confirmed), ("judgement", routed_j),
             ("citation", routed_j & no("citation")), ("component", routed_c), ("tunable", lever),
             ("no_lever", lever & no("no_lever")), ("out_of_bounds", lever & no("out_of_bounds")),
             ("no_occupancy", lever & no("no_occupancy")), ("contested", settled & no("contested")),
             ("recalibrates", settled & no("recalibrates")), ("has_comment", commented),
             ("unread_comment", commented)]
    signals = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in names])))
    disposition = F.element_at(F.array(*[F.lit(x) for x in LADDER]), rank + 1)
    return f.select("id", disposition.alias("disposition"), signals.alias("signals"))


def proposed_changes(feedback: DataFrame, tax: DataFrame, triaged: DataFrame, profile_rules: DataFrame
                     ) -> DataFrame:
    """The lever changes tunable submissions argue for, as absolute settings."""
    tun = triaged.where("disposition = 'auto_tunable'").select("id")
    verdicts = F.broadcast(tax.where("remedy = 'tunable'").select("aspect", "verdict", "knob", "delta"))
    a = (feedback.join(tun, "id", "left_semi")
         .select("id", "rule_id", "occupancy_group", F.explode("answers").alias("aspect", "verdict"))
         .join(verdicts, ["aspect", "verdict"])
         .join(profile_rules.select("rule_id", "severity_shift", "scope_occupancy"), "rule_id", "left"))
    shift = F.greatest(F.lit(-2), F.least(F.lit(2), F.coalesce("severity_shift", F.lit(0))
                                          + F.col("delta").try_cast("int")))
    scope = F.array_sort(F.array_union(F.coalesce("scope_occupancy", F.array().cast("array<string>")),
                                       F.array("occupancy_group")))
    value = (F.when(F.col("knob") == "severity_shift", shift.cast("string"))
             .when(F.col("knob") == "scope_occupancy", F.array_join(scope, "|")).otherwise(F.col("delta")))
    return a.select("id", "rule_id", "knob", value.alias("value"))


def feedback_queue(feedback: DataFrame, state: str | None = None, disposition: str | None = None,
                   limit: int | None = None) -> DataFrame:
    """The owner's queue, newest first: all of it, or a top-k of which only ``limit`` rows ever leave the tasks."""
    f = feedback
    if state:
        f = f.where(F.col("state") == state)
    if disposition:
        f = f.where(F.col("disposition") == disposition)
    ordered = f.orderBy(F.desc("created_at"), F.asc("id"))
    return ordered if limit is None else ordered.limit(limit)


def own_feedback(feedback: DataFrame, set_id=None, uid=None, limit: int | None = None) -> DataFrame:
    """Everyone's own feedback on each set, ``n`` from 1 in the order it was given: all of it, or the first ``limit``
    per reviewer and set; of one set or one reviewer where they are named."""
    f = feedback.where("set_id is not null and uid is not null")
    for column, value in (("set_id", set_id), ("uid", uid)):
        if value is not None:
            f = f.where(F.col(column) == value)
    out = f.withColumn("n", F.row_number().over(W.partitionBy("set_id", "uid").orderBy("created_at", "id")))
    return out if limit is None else out.where(F.col("n") <= limit)


def open_count(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count_if(F.col("state") == "new").alias("n_open"))


def digest(feedback: DataFrame, per_group: int = 20) -> DataFrame:
    """Waiting feedback by disposition: group size and the first twenty of each.

    The first twenty come from a bounded window per disposition; Spark prunes each task to its
    own first twenty before the shuffle.
    """
    waiting = feedback.where("state = 'new'")
    w = W.partitionBy("disposition").orderBy(F.asc("created_at"), F.asc("id"))
    top = waiting.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_group)
    size = waiting.groupBy("disposition").agg(F.count(F.lit(1)).alias("group_size"))
    return top.join(size, "disposition").select("disposition", "group_size", "n", "id", "created_at")


def markup_order(markups: DataFrame) -> DataFrame:
    """A pass in reading order: ``ord`` per set by page, then top to bottom, left to right."""
    from planlens.operators.helpers import numbered
    return numbered(markups, ["set_id"], ["page"], ["y0", "x0", "id"])


def markup_totals(markups: DataFrame) -> DataFrame:
    """Per set: annotations by kind, how many carry a comment, how many sheets."""
    kinds = markups.groupBy("set_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds
