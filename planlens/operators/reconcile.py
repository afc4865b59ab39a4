"""Declared answers beside drawn facts.

``declared`` and ``drawn`` are long: set_id, field, value_num, value_str, value_bool (drawn also
carries its source, page and note). NULL values are unanswered, never a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planlens.functions import text as T, vocabulary as V
from planlens.functions.normalise import canonical
from planlens.operators.facts import answers_agree
from planlens.operators.helpers import full_outer
from planlens.sources.catalog import DECLARED_FIELDS



def long_declarations(wide: DataFrame) -> DataFrame:
    """The wide declaration row as one row per answered question."""
    def entry(c: str) -> Column:
        t = dict(wide.dtypes)[c]
        return F.struct(
            F.lit(c).alias("field"),
            (F.col(c).cast("double") if t not in ("string", "boolean") else F.lit(None).cast("double"))
            .alias("value_num"),
            (F.col(c) if t == "string" else F.lit(None).cast("string")).alias("value_str"),
            (F.col(c) if t == "boolean" else F.lit(None).cast("boolean")).alias("value_bool"))
    answered = [c for c in DECLARED_FIELDS if c in wide.columns]
    rows = wide.select("set_id", F.explode(F.array(*map(entry, answered))).alias("d"))
    return rows.select("set_id", "d.*").where(
        "value_num is not null or value_str is not null or value_bool is not null")


def validate_declarations(raw: DataFrame, questions: DataFrame) -> DataFrame:
    """Problems of raw answers: set_id, field, kind_in (string/number/boolean), text.

    One row per problem; an answer that is sound gives none.
    """
    q = F.broadcast(questions.select("field", "kind", "choices"))
    n = F.col("text").try_cast("double")
    problem = (
        F.when(F.col("kind").isNull(), "not a declaration field")
        .when(F.col("text").isNull(), None)
        .when((F.col("kind") == "enum") & ((F.col("kind_in") != "string")
                                           | ~F.array_contains("choices", F.col("text"))),
              "not one of the choices")
        .when((F.col("kind") == "bool") & (F.col("kind_in") != "boolean"), "expected true or false")
        .when(F.col("kind").isin("number", "integer") & ((F.col("kind_in") != "number") | n.isNull()),
              "expected a number")
        .when((F.col("kind") == "integer") & (n != F.floor(n)), "expected a whole number")
        .when(F.col("kind").isin("number", "integer") & (n < 0), "expected a positive number")
        .when((F.col("kind") == "text") & (F.col("kind_in") != "string"), "expected text")
        .when((F.col("kind") == "text") & (F.length("text") > 200), "longer than 200 characters"))
    return (raw.join(q, "field", "left").withColumn("problem", problem)
            .where("problem is not null").select("set_id", "field", "text", "problem"))


def merge_answers(previous: DataFrame, new: DataFrame) -> DataFrame:
    """New non-null answers over previous ones; a previous answer is never lost."""
    cols = [c for c in previous.columns if c != "set_id"]
    old = previous.select("set_id", *[F.col(c).alias(f"_old_{c}") for c in cols])
    both = full_outer(old, new, ["set_id"])
    return both.select("set_id", *[F.coalesce(c, f"_old_{c}").alias(c) for c in cols])


def drawn_values(resolved: DataFrame, attrs: DataFrame, swept: DataFrame) -> DataFrame:
    """What the drawings say per question: resolved fact, else structured value, else text sweep.

    Every input: set_id, field, value_num, value_str, value_bool, source, page, note.
    """
    cols = ["set_id", "field", "value_num", "value_str", "value_bool", "source", "page", "note"]
    parts = [df.select(*cols, F.lit(i).alias("_p"))
             for i, df in enumerate((resolved, attrs, swept))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(
        "value_num is not null or value_str is not null or value_bool is not null")
    best = F.min_by(F.struct(*cols[2:]), F.struct("_p", "page")).alias("d")
    return every.groupBy("set_id", "field").agg(best).select("set_id", "field", "d.*")


def apply_implication(drawn: DataFrame) -> DataFrame:
    """Citing the separated-occupancies table implies a mixed building, over a stated NO."""
    cited = drawn.where((F.col("field") == "separation_method") & (F.col("value_str") == "separated"))
    stated = drawn.where("field = 'mixed_occupancy'").select(
        "set_id", F.col("value_bool").alias("_said"))
    note = F.concat(F.coalesce("source", F.lit("")), F.lit(" cites Table 508.4"),
                    F.when(~F.col("_said"), "; its summary row says not mixed").otherwise(""))
    implied = cited.join(stated, "set_id", "left").select(
        "set_id", F.lit("mixed_occupancy").alias("field"), F.lit(None).cast("double").alias("value_num"),
        F.lit(None).cast("string").alias("value_str"), F.lit(True).alias("value_bool"), "source", "page",
        note.alias("note"))
    rest = drawn.join(implied.select("set_id", "field"), ["set_id", "field"], "left_anti")
    return rest.unionByName(implied)


def reconcile(declared: DataFrame, drawn: DataFrame, questions: DataFrame,
              sets: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """Every (set, question) in one of five states, with both values in canonical form.

    ``sets`` lists every set, so a question neither side answers shows as UNKNOWN; without it
    only questions some side answers are listed. ``material`` says whether the set holds a conflict
    that opens a second reading. ``fields`` are the questions wanted as rows (None: all); all of them
    decide what is material. What a side says of a set is gathered before it moves, so one row a set
    and side is exchanged, and later steps by set move nothing again.
    """
    extra = [c for c in ("source", "page", "note") if c in drawn.columns]

    of = F.broadcast(questions.select("field", (F.size("unlocks") > 0).alias("opens"), "tol_abs", "tol_rel"))

    def side(df: DataFrame, tag: str) -> DataFrame:
        c = canonical(F.col("field"), F.col("value_num"), F.col("value_str"), F.col("value_bool"))
        return df.join(of, "field").select("set_id", F.struct(
            "field", F.lit(tag).alias("side"), c["c_num"].alias("num"), c["c_str"].alias("str"), "opens", "tol_abs", "tol_rel",
            *[(F.col(x) if tag == "w" else F.lit(None)).cast(drawn.schema[x].dataType).alias(x) for x in extra]).alias("said"))
    every = side(declared, "d").unionByName(side(drawn, "w"))
    one = every.schema["said"].dataType
    if sets is not None:
        every = every.where("set_id is not null").unionByName(sets.select("set_id", F.lit(None).cast(one).alias("said")))
    met = every.groupBy("set_id").agg(F.collect_list("said").alias("said"), F.max(F.col("said").isNull()).alias("_listed"))
    if sets is not None:
        met = met.where("_listed")
    by = lambda tag: F.filter("said", lambda x: (x["side"] == tag) & (x["num"].isNotNull() | x["str"].isNotNull()))
    met = T.staged(met.select("set_id", by("d").alias("d"), by("w").alias("w")), in_d=F.transform("d", lambda x: x["field"]), in_w=F.transform("w", lambda x: x["field"]))

    def row(d: Column | None, w: Column | None, field: Column) -> Column:
        at = lambda x, k: F.lit(None).cast(one[k].dataType) if x is None else x[k]
        both = d is not None and w is not None
        conflict = ~F.coalesce(answers_agree(field, d["num"], d["str"], w["num"], w["str"], d["tol_abs"], d["tol_rel"]), F.lit(False)) if both else F.lit(False)
        state = F.when(conflict, "CONFLICT").otherwise("CORROBORATED") if both else F.lit("DECLARED_ONLY" if d is not None else "DRAWN_ONLY" if w is not None else "UNKNOWN")
        return F.struct(field.alias("field"), at(d, "num").alias("declared_num"), at(d, "str").alias("declared_str"), at(w, "num").alias("drawn_num"),
                        at(w, "str").alias("drawn_str"), *[at(w, x).alias(x) for x in extra], state.alias("state"), (conflict & d["opens"] if both else conflict).alias("_opens"))
    # a question's rows: of what either side says of it, a value or two, each beside each
    beside = lambda d: F.when(F.array_contains("in_w", d["field"]), F.transform(F.filter("w", lambda w: w["field"] == d["field"]), lambda w: row(d, w, d["field"]))).otherwise(
        F.array(row(d, None, d["field"])))
    drawn_only = F.transform(F.filter("w", lambda w: ~F.array_contains("in_d", w["field"])), lambda w: row(None, w, w["field"]))
    rows = [F.flatten(F.transform("d", beside)), drawn_only]
    if sets is not None:
        rows.append(F.transform(F.array_except(F.array_except(F.array(*map(F.lit, DECLARED_FIELDS)), "in_d"), "in_w"), lambda f: row(None, None, f)))
    out = T.staged(met, rows=F.concat(*rows))
    wanted = F.col("rows")
    if sets is not None:
        wanted = F.filter(wanted, lambda x: x["field"].isin(DECLARED_FIELDS))
    if fields is not None:
        wanted = F.filter(wanted, lambda x: x["field"].isin(fields))
    out = out.select("set_id", F.exists("rows", lambda x: x["_opens"]).alias("material"), F.inline(wanted)).drop("_opens")
    return out.join(F.broadcast(questions.select("field", "ord", "label", "unlocks", "tol_abs", "tol_rel")), "field")


def scenarios(reconciled: DataFrame, keep_silent: bool = False) -> DataFrame:
    """The rows every rule reads: one reading of each set, two where a material conflict exists.

    Never a product: one reading in which every drawn value wins, one in which every declared
    value wins.
    """
    names = F.when(F.col("material"), F.array(F.lit("as_drawn"), F.lit("as_declared"))).otherwise(
        F.array(F.lit("as_drawn")))
    out = reconciled.withColumn("scenario", F.explode(names)).drop("material")
    use_declared = (F.col("state") == "DECLARED_ONLY") | (
        (F.col("state") == "CONFLICT") & (F.col("scenario") == "as_declared"))
    pick = lambda k: F.when(use_declared, F.col(f"declared_{k}")).otherwise(F.col(f"drawn_{k}"))
    return (out.withColumn("num", pick("num")).withColumn("str", pick("str"))
            .withColumn("basis", basis_of_state(F.col("state")))
            .withColumn("drawn_page", F.col("page") if "page" in out.columns else F.lit(None).cast("int"))
            .withColumn("page", F.when(~use_declared, F.col("page")) if "page" in out.columns
                        else F.lit(None).cast("int"))
            .where(F.lit(keep_silent) | F.col("num").isNotNull() | F.col("str").isNotNull()))


def basis_of_state(state: Column) -> Column:
    return (F.when(state == "CORROBORATED", "both").when(state == "DECLARED_ONLY", "declaration")
            .otherwise("drawings"))


def weakest_basis(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The weakest basis among the facts a finding rests on, per key."""
    b = F.col("basis")
    return rows.groupBy(*keys).agg(
        F.when(F.bool_or(b == "declaration"), "declaration")
        .when(F.bool_and(b == "both"), "both").otherwise("drawings").alias("basis"))


def general(num: Column) -> Column:
    """A number in at most six significant digits, without trailing zeros."""
    t = F.format_string("%.6g", num)
    return F.when(t.contains("."), F.regexp_replace(t, r"\.?0*(?=e|$)", "")).otherwise(t)


def form_value(kind: Column, choices: Column, num: Column, txt: Column, flag: Column) -> Column:
    """A value as the string its form control holds; NULL when it cannot be offered honestly."""
    t = F.nullif(F.trim(F.coalesce(txt, num.cast("string"))), F.lit(""))
    whole = F.when(num == F.floor(num), num.cast("bigint").cast("string"))
    return (F.when(kind == "bool", F.when(flag | (txt == "true"), "true").when(
        (~flag) | (txt == "false"), "false"))
        .when(kind == "enum", F.when((F.size(choices) == 0) | F.array_contains(choices, t), t))
        .when(kind == "integer", F.bround(num, 0).cast("bigint").cast("string"))
        .when(kind == "number", F.coalesce(whole, general(num)))
        .otherwise(t))


def prefill(drawn: DataFrame, questions: DataFrame) -> DataFrame:
    """Drawn values offered back in the strings their form controls hold."""
    q = F.broadcast(questions.select("field", "ord", "kind", "choices"))
    value = form_value(F.col("kind"), F.col("choices"), F.col("value_num"), F.col("value_str"),
                       F.col("value_bool"))
    return (drawn.join(q, "field").withColumn("value", value).where("value is not null")
            .select("set_id", "field", "ord", "value", "source", "page"))


def shown(num: Column, txt: Column) -> Column:
    """A value as a report prints it: 15,376 or 26.33, yes/no as Yes/No."""
    word = F.when(txt == "true", "Yes").when(txt == "false", "No").otherwise(txt)
    return F.coalesce(F.when(num == F.floor(num), F.format_number(num, 0)), F.format_number(num, 2), word)


def declaration_report(reconciled: DataFrame) -> DataFrame:
    """Per set with any answer: answered count and the fifteen questions side by side."""
    row = F.struct("ord", "field", "state",
                   shown(F.col("declared_num"), F.col("declared_str")).alias("declared"),
                   shown(F.col("drawn_num"), F.col("drawn_str")).alias("drawn"))
    answered = F.col("declared_num").isNotNull() | F.col("declared_str").isNotNull()
    # collects the fixed fifteen questions of a set, never more
    return (reconciled.groupBy("set_id")
            .agg(F.count_if(answered).alias("answered"), F.count(F.lit(1)).alias("total_fields"),
                 F.array_sort(F.collect_list(row)).alias("fields")).where("answered > 0"))
