"""Versioned calibration: bounded levers applied to a finished register, never inventing one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from planlens.functions import vocabulary as V
from planlens.operators.helpers import attach, full_outer, name_of, numbered, rank_of

# ---- fixed values: the levers. name; kind; default; low; high ------------------------------
KNOBS = [("enabled", "bool", "true", None, None), ("severity_shift", "int", "0", -2.0, 2.0),
         ("severity_cap", "severity", None, None, None), ("severity_floor", "severity", None, None, None),
         ("scope_occupancy", "strings", "", None, None), ("scope_basis", "strings", "", None, None),
         ("drop_verified", "bool", "false", None, None), ("weight", "float", "1.0", 0.1, 5.0)]
KNOB_NAMES = [k[0] for k in KNOBS]


def knobs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        KNOBS, "knob string, kind string, default_value string, low double, high double")


def shift_severity(severity: Column, steps: Column, floor: Column, cap: Column) -> Column:
    """Move along the ramp, saturating, then hold between floor and cap.

    Verified and measured rows are not on the ramp and never move.
    """
    at = rank_of(severity, V.RAMP)
    moved = F.greatest(F.lit(0), F.least(F.lit(3), at - F.coalesce(steps, F.lit(0))))
    capped = F.greatest(moved, F.when(cap.isin(V.RAMP), rank_of(cap, V.RAMP)).otherwise(0))
    floored = F.least(capped, F.when(floor.isin(V.RAMP), rank_of(floor, V.RAMP)).otherwise(3))
    return F.when(at == 9, severity).otherwise(name_of(floored, V.RAMP))


def apply_profile(findings: DataFrame, profile_rules: DataFrame) -> DataFrame:
    """Every finding with what the profile does to it.

    ``findings`` carries ``occupancy_group`` of its set. Adds ``knob`` (the lever that acted, or
    NULL), ``before`` and ``after``, ``disposition`` kept/suppressed, and ``weight``. The kept
    rows, the adjustments and the abstentions are projections of this one frame. A profile has
    one row per rule; whether it is small enough to broadcast is left to its measured size.
    """
    cal = profile_rules.select(
        "rule_id", "enabled", "severity_shift", "severity_cap", "severity_floor", "scope_occupancy",
        "scope_basis", "drop_verified", F.col("weight").alias("cal_weight"),
        *[c for c in ("profile_id", "version") if c in profile_rules.columns])
    f = findings.join(cal, "rule_id", "left")
    grp = F.coalesce("occupancy_group", F.lit(""))
    inside = lambda arr, v: F.coalesce(F.array_contains(arr, v), F.lit(False))
    suppressed = (F.when(~F.coalesce("enabled", F.lit(True)), "enabled")
                  .when((grp != "") & inside(F.col("scope_occupancy"), grp), "scope_occupancy")
                  .when(inside(F.col("scope_basis"), F.col("basis")), "scope_basis")
                  .when(F.coalesce("drop_verified", F.lit(False)) & (F.col("severity") == "VERIFIED"),
                        "drop_verified"))
    after = shift_severity(F.col("severity"), F.col("severity_shift"), F.col("severity_floor"),
                           F.col("severity_cap"))
    out = f.withColumn("_s", suppressed).withColumn("_after", after)
    return (out.withColumn("disposition", F.when(F.col("_s").isNotNull(), "suppressed").otherwise("kept"))
            .withColumn("knob", F.coalesce("_s", F.when(F.col("_after") != F.col("severity"), "severity_shift")))
            .withColumn("before", F.col("severity"))
            .withColumn("after", F.when(F.col("_s").isNotNull(), "suppressed").otherwise(F.col("_after")))
            .withColumn("severity", F.when(F.col("_s").isNotNull(), F.col("severity")).otherwise(F.col("_after")))
            .withColumn("weight", F.coalesce("cal_weight", F.lit(1.0)))
            .drop("_s", "_after", "cal_weight", "enabled", "severity_shift", "severity_cap",
                  "severity_floor", "scope_occupancy", "scope_basis", "drop_verified"))


def kept(applied: DataFrame) -> DataFrame:
    return applied.where("disposition = 'kept'")


def adjustments(applied: DataFrame) -> DataFrame:
    return applied.where("knob is not null").select("set_id", "fid", "rule_id", "knob", "before", "after")


def silenced(applied: DataFrame) -> DataFrame:
    """An abstention per rule a profile switched off or scoped out of a set."""
    return (applied.where("disposition = 'suppressed' and knob in ('enabled', 'scope_occupancy')")
            .groupBy("set_id", "rule_id").agg(F.max("knob").alias("detail"))
            .withColumn("reason", F.lit("suppressed by calibration")))


def calibrated_order(kept_rows: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """``ord`` per set: severity (measured before verified), heavier first, page, fid, reading.

    Weight orders within a severity, never across one.
    """
    f = (kept_rows.withColumn("_rank", rank_of(F.col("severity"), V.CALIBRATED_ORDER))
         .withColumn("_w", -F.col("weight")))
    return numbered(f, ["set_id"], ["_rank", "_w", "page"], ["fid", "scenario", *(ties or [])]).drop(
        "_rank", "_w")


def clamp_knobs(changes: DataFrame, knob_dim: DataFrame) -> DataFrame:
    """Change values held inside each lever's bounds. ``changes``: rule_id, knob, value (text;
    several strings joined by '|'). A value a lever cannot read becomes its default."""
    c = changes.join(F.broadcast(knob_dim), "knob", "left")
    n = F.col("value").try_cast("double")
    held = F.greatest(F.col("low"), F.least(F.col("high"), n))
    parts = F.filter(F.array_sort(F.array_distinct(F.split("value", r"\|"))), lambda x: x != "")
    flag = F.lower(F.trim("value"))
    value = (F.when(F.col("kind").isNull() | F.col("value").isNull(), F.col("default_value"))
             .when(F.col("kind") == "bool", F.when(flag.isin("true", "1", "yes"), "true").when(
                 flag.isin("false", "0", "no", ""), "false").otherwise(F.col("default_value")))
             .when(F.col("kind") == "int", F.coalesce(
                 F.when(n == F.floor(n), held.cast("int").cast("string")), F.col("default_value")))
             .when(F.col("kind") == "float", F.coalesce(held.cast("string"), F.col("default_value")))
             .when(F.col("kind") == "severity", F.when(F.col("value").isin(V.RAMP), F.col("value"))
                   .otherwise(F.col("default_value")))
             .otherwise(F.array_join(parts, "|")))
    return c.withColumn("clamped", value).select(*changes.columns, "kind", "clamped")


def long_profile(profile_rules: DataFrame) -> DataFrame:
    """(rule_id, knob, value): one row per lever, values as text."""
    def text(k: str, kind: str) -> Column:
        return F.array_join(F.array_sort(k), "|") if kind == "strings" else F.col(k).cast("string")
    entries = F.array(*[F.struct(F.lit(k).alias("knob"), text(k, kind).alias("value"))
                        for k, kind, *_ in KNOBS])
    return profile_rules.select("rule_id", F.explode(entries).alias("e")).select("rule_id", "e.*")


def next_version(profile_rules: DataFrame, changes: DataFrame, knob_dim: DataFrame) -> DataFrame:
    """Version n + 1: the last change of each (rule, knob) wins, confirmations add.

    ``changes``: ordinal, rule_id, knob, value. The old version is not touched; the result is
    appended beside it.
    """
    level = clamp_knobs(changes.where(F.col("knob").isin(KNOB_NAMES)), knob_dim)
    last = (level.groupBy("rule_id", "knob")
            .agg(F.max_by("clamped", "ordinal").alias("value"), F.lit(1).alias("set")))
    wide = last.groupBy("rule_id").pivot("knob", KNOB_NAMES).agg(
        F.first(F.struct("value", "set")))
    confirm = (changes.where("knob = 'confirmations'").groupBy("rule_id")
               .agg(F.sum(F.coalesce(F.col("value").try_cast("int"), F.lit(0))).alias("_c")))
    new = wide.select("rule_id", *[F.col(k).alias(f"_{k}") for k in KNOB_NAMES])
    both = full_outer(full_outer(profile_rules, new, ["rule_id"]), confirm, ["rule_id"])

    def merged(k: str, kind: str, default: str | None) -> Column:
        to = {"bool": "boolean", "int": "int", "float": "double", "severity": "string"}
        text = F.col(f"_{k}.value")
        if kind == "strings":
            new_v = F.filter(F.split(text, r"\|"), lambda x: x != "")
            base = F.coalesce(k, F.array().cast("array<string>"))
        else:
            new_v, base = text.cast(to[kind]), F.coalesce(k, F.lit(default).cast(to[kind]))
        return F.when(F.col(f"_{k}.set").isNotNull(), new_v).otherwise(base).alias(k)

    version = profile_rules.agg(F.max("version").alias("_v"), F.first("profile_id").alias("_p"))
    out = attach(both, version)  # one row: the version being left behind
    return out.select(
        F.col("_p").alias("profile_id"), (F.col("_v") + 1).alias("version"), "rule_id",
        *[merged(k, kind, d) for k, kind, d, *_ in KNOBS],
        F.greatest(F.lit(0), F.coalesce("confirmations", F.lit(0)) + F.coalesce("_c", F.lit(0)))
        .cast("int").alias("confirmations"))


def active_profile(versions: DataFrame) -> DataFrame:
    """The rows of the newest global version."""
    top = versions.where("scope = 'global'").agg(F.max("version").alias("version"))
    return versions.where("scope = 'global'").join(F.broadcast(top), "version", "left_semi")


def candidate_profile(versions: DataFrame, uids: DataFrame) -> DataFrame:
    """Each user's candidate rows: their own newest, else a seed of the active profile."""
    own = versions.where("scope = 'candidate'")
    newest = own.groupBy("owner_uid").agg(F.max("version").alias("version"))
    mine = own.join(newest, ["owner_uid", "version"]).join(
        uids.select(F.col("uid").alias("owner_uid")), "owner_uid", "left_semi")
    without = uids.join(own.select(F.col("owner_uid").alias("uid")), "uid", "left_anti")
    active = active_profile(versions).drop("owner_uid", "scope")
    # one profile (bounded by the rules that exist) seeded per user without a candidate
    seeded = attach(without.select(F.col("uid").alias("owner_uid"), F.lit("candidate").alias("scope")), active)
    return mine.unionByName(seeded.select(*mine.columns))


def version_list(versions: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest ``limit`` versions (None: all) and how many rules each one holds."""
    out = (versions.where("scope = 'global'").groupBy("version")
            .agg(F.count(F.lit(1)).alias("n_rules")).orderBy(F.desc("version")))
    return out if limit is None else out.limit(limit)


def diff_profiles(before: DataFrame, after: DataFrame, knob_dim: DataFrame) -> DataFrame:
    """Levers that differ between two versions; a rule missing on one side has its defaults."""
    a = long_profile(before).withColumnRenamed("value", "before")
    b = long_profile(after).withColumnRenamed("value", "after")
    both = full_outer(a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True)), ["rule_id", "knob"])
    d = both.join(F.broadcast(knob_dim.select("knob", "default_value")), "knob")
    was = F.when(F.col("_a"), F.col("before")).otherwise(F.col("default_value"))
    now = F.when(F.col("_b"), F.col("after")).otherwise(F.col("default_value"))
    return (d.select("rule_id", "knob", was.alias("before"), now.alias("after"))
            .where("not (before <=> after)"))
