"""From many claims per fact to one value with its rivals.

``claims`` columns: set_id, field, role, value_type, value_num, value_str, value_bool, raw, page,
sheet, method, label, score, source ARRAY<STRING>, seq (a stable ingest ordinal).

A fact is one (set_id, field, role). Claims are grouped by walking them in (score high to low,
page, ingest) order: a claim joins the first group whose first value agrees with its own. That
walk only ever compares values, and equal values always land together, so it is decided for the
distinct values of a fact, and the claims join their group afterwards. Facts that answer no
declared question can have as many groups as values; those of many values are decided in rounds over
the pairs of values that agree (``led_values``). Facts that answer one have few groups and are folded,
and so are facts of few values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from planlens.functions import vocabulary as V
from planlens.functions.normalise import canonical
from planlens.operators.helpers import connected_components
from planlens.session import cut_lineage, kept
from planlens.sources.catalog import CATALOG, TOLERANCES

FACT = ["set_id", "field", "role"]
VALUE = ["value_type", "value_num", "value_str", "value_bool"]

#: a fact of at most this many distinct values is folded, which decides as the rounds do without joining pairs
FOLDED = 64

#: catalog field -> the declared question it answers
QUESTION_FOR = {c["field"]: c["question"] for c in CATALOG if c["question"]}


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """The same page, reader, value, words and source is one claim; the first is kept."""
    keys = [*FACT, *VALUE, "page", "method", "raw", "source"]
    rest = [c for c in claims.columns if c not in keys]
    first = F.min(F.struct("seq", *[c for c in rest if c != "seq"])).alias("_first")
    return claims.groupBy(*keys).agg(first).select(
        *keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*claims.columns)


def value_text(c: str = "") -> Column:
    """A value as it is written out, the measure of how specific it is."""
    return F.coalesce(F.col(f"{c}value_str"), F.col(f"{c}value_num").cast("string"),
                      F.initcap(F.col(f"{c}value_bool").cast("string")))


def _comparable(field: Column) -> list[Column]:
    """What agreement is decided on, worked out once per distinct value."""
    q = F.coalesce(*[F.when(field == f, F.lit(k)) for f, k in QUESTION_FOR.items()], F.lit(""))
    c = canonical(q, F.col("value_num"), F.col("value_str"), F.col("value_bool"))
    tol_abs = F.coalesce(*[F.when(q == k, F.lit(a)) for k, (a, _) in TOLERANCES.items()])
    tol_rel = F.coalesce(*[F.when(q == k, F.lit(r)) for k, (_, r) in TOLERANCES.items()])
    tokens = F.regexp_extract_all(F.upper(F.col("value_str")),
                                  F.lit(r"([A-Z0-9]+(?:[-./][A-Z0-9]+)*)"), 1)
    written = F.when(F.size(tokens) > 0,
                     F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")))
    return [q.alias("q"), c["c_num"].alias("c_num"), c["c_str"].alias("c_str"),
            tol_abs.alias("tol_abs"), tol_rel.alias("tol_rel"),
            F.upper(F.trim(value_text())).alias("txt"), written.alias("written"),
            F.col("value_num").alias("num")]


def sprinkler_agree(a: Column, b: Column) -> Column:
    pa, pb = a.isin(V.SPRINKLER_PRESENT), b.isin(V.SPRINKLER_PRESENT)
    return (pa == pb) & ((a == "YES") | (b == "YES") | (a == b))


def answers_agree(q: Column, an: Column, as_: Column, bn: Column, bs: Column,
                  tol_abs: Column, tol_rel: Column) -> Column:
    """Do two canonical answers to one question say the same thing?

    A missing half agrees: there is nothing to disagree about.
    """
    gap = F.abs(an - bn)
    limit = F.greatest(tol_abs, tol_rel * F.greatest(F.abs(an), F.abs(bn)))
    numbers = F.when(tol_abs.isNull(), an == bn).otherwise(gap <= limit)
    dash = F.lit("-")
    group = ((as_ == bs) | F.startswith(as_, F.concat(bs, dash))
             | F.startswith(bs, F.concat(as_, dash)))
    text = (F.when(q == "sprinkler_system", sprinkler_agree(as_, bs))
            .when(q == "occupancy_group", group).otherwise(as_ == bs))
    return (F.when(an.isNotNull() & bn.isNotNull(), numbers)
            .when(as_.isNotNull() & bs.isNotNull(), text).otherwise(True))


def values_agree(a: Column, b: Column) -> Column:
    """Agreement of two ``_comparable`` structs of one fact."""
    wa, wb = a["written"], b["written"]
    written_out = F.coalesce(F.contains(wa, wb) | F.contains(wb, wa), F.lit(False))
    declared = answers_agree(a["q"], a["c_num"], a["c_str"], b["c_num"], b["c_str"],
                             a["tol_abs"], a["tol_rel"])
    both_specific = F.contains(a["txt"], F.lit("-")) & F.contains(b["txt"], F.lit("-")) \
        & a["num"].isNull() & b["num"].isNull()
    specific = F.when(both_specific, a["txt"] == b["txt"]).otherwise(True)
    close = F.abs(a["num"] - b["num"]) <= F.greatest(
        F.lit(0.01), F.lit(0.005) * F.greatest(F.abs(a["num"]), F.abs(b["num"])))
    plain = F.when(a["num"].isNotNull() & b["num"].isNotNull(), close).otherwise(
        a["txt"] == b["txt"])
    return F.coalesce(written_out | F.when(a["q"] != "", declared & specific).otherwise(plain),
                      F.lit(False))


def _edges(values: DataFrame) -> DataFrame:
    """(fact, lo, hi): the pairs of values of one fact that agree, by their order, for facts that answer no question.

    Values that agree share a key: their text; a step of a scale on which close numbers are at most
    one step apart; or a run of words, all of one and a part of the other. A value brings its own
    runs only of the lengths that some value of its fact has, as hashes, so keys grow with words.
    """
    num, words = F.col("v.num"), F.filter(F.split(F.coalesce("v.written", F.lit("")), " "), lambda x: x != "")
    item = values.withColumn("words", words).withColumn("n", F.size("words"))
    step = F.floor(F.signum(num) * F.when(F.abs(num) <= 2, F.abs(num) * 100).otherwise(200 + F.log(F.abs(num) / 2) / 0.00502) / 1.01)
    nearby = F.when(num.isNotNull(), F.array(step - 1, step, step + 1))
    text, number, run = (F.lit(k) for k in ("text", "number", "run"))

    def keyed(kind: Column, key: Column) -> Column:
        return F.struct(kind.alias("kind"), key.cast("long").alias("key"))

    own = item.select(*FACT, F.explode(F.array_compact(F.array(
        keyed(text, F.xxhash64("v.txt")), F.when(num.isNotNull(), keyed(number, step)),
        F.when(F.col("n") > 0, keyed(run, F.xxhash64("words")))))).alias("k"), F.col("v").alias("a"))
    one = item.select(*FACT, F.explode(F.concat(F.array(keyed(text, F.xxhash64("v.txt"))), F.coalesce(F.transform(nearby, lambda x: keyed(number, x)), F.array()))).alias("k"),
                      F.col("v").alias("b"))
    lengths = item.where("n > 0").groupBy(*FACT).agg(F.collect_set("n").alias("lengths"))  # at most the words of the longest value
    part = F.flatten(F.transform(F.filter("lengths", lambda m: m <= F.col("n")), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: F.xxhash64(F.slice("words", i, m)))))
    runs = item.where("n > 0").join(lengths, FACT).select(*FACT, F.explode(F.array_distinct(part)).alias("key"), F.col("v").alias("b"))
    one = one.unionByName(runs.select(*FACT, keyed(run, F.col("key")).alias("k"), "b"))
    a, b = F.col("a.first"), F.col("b.first")
    met = own.join(one, [*FACT, "k"]).where((a != b) & values_agree(F.col("a"), F.col("b")))
    return met.select(*FACT, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def led_values(values: DataFrame) -> DataFrame:
    """The walk without a walk: ``opened`` of each value is the first value that leads a group and agrees with it.

    A value leads when no earlier value that leads agrees with it. All values whose earlier
    neighbours are decided are decided at once, round by round, each round a join over the pairs
    that agree; the rounds are as many as the longest chain of values that hang on each other. No
    fact is collected into one row, so one with all the values spreads over the tasks.
    """
    edges = cut_lineage(_edges(values))
    live = cut_lineage(edges.select(*FACT, F.col("lo").alias("first")).union(edges.select(*FACT, F.col("hi").alias("first"))).distinct())
    leads = None
    while not live.isEmpty():
        lo, hi = live.select(*FACT, F.col("first").alias("lo")), live.select(*FACT, F.col("first").alias("hi"))
        held = edges.join(lo, [*FACT, "lo"], "left_semi").select(*FACT, F.col("hi").alias("first"))
        new = cut_lineage(live.join(held, [*FACT, "first"], "left_anti"))
        leads = new if leads is None else cut_lineage(leads.union(new))
        joined = edges.join(new.withColumnRenamed("first", "lo"), [*FACT, "lo"], "left_semi").select(*FACT, F.col("hi").alias("first"))
        live = cut_lineage(live.join(new, [*FACT, "first"], "left_anti").join(joined, [*FACT, "first"], "left_anti"))
    if leads is None:
        return values.select(*FACT, *[F.col(f"v.{c}").alias(c) for c in VALUE], F.col("v.first").alias("opened"))
    under = (edges.join(leads.withColumnRenamed("first", "lo"), [*FACT, "lo"], "left_semi").groupBy(*FACT, F.col("hi").alias("first"))
             .agg(F.min("lo").alias("opened")).join(leads, [*FACT, "first"], "left_anti"))
    return (values.withColumn("first", F.col("v.first")).join(under, [*FACT, "first"], "left")
            .select(*FACT, *[F.col(f"v.{c}").alias(c) for c in VALUE], F.coalesce("opened", "first").alias("opened")))


def walked_values(values: DataFrame) -> DataFrame:
    """The walk as one fold over a fact's distinct values: for facts of few values and those that answer a question, whose groups are few."""
    w = W.partitionBy(*FACT, "v.value_type").orderBy("v.value_num")
    num, before = F.col("v.value_num"), F.lag("v.value_num").over(w)
    # numbers farther apart than any tolerance (50 plus two percent) fall in chains of their own
    apart = num - before > F.greatest(F.lit(50.0), F.lit(0.02) * F.greatest(F.abs(num), F.abs(before)))
    chain = F.sum(F.when(apart, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    # where no question is asked, a number may also agree with a text written like it
    split = values.withColumn("chain", F.when((F.col("v.value_type") == "num") & (F.col("v.q") != ""), chain).otherwise(0))
    walked = split.groupBy(*FACT, "chain").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    leaders = F.aggregate(
        F.col("vs"), F.filter(F.col("vs"), lambda x: F.lit(False)),
        lambda acc, x: F.when(F.exists(acc, lambda g: values_agree(g, x)), acc)
        .otherwise(F.concat(acc, F.array(x))))
    return (walked.withColumn("gs", leaders)
            .select(*FACT, F.explode(F.transform(
                F.col("vs"), lambda x: F.struct(
                    *[x[c].alias(c) for c in VALUE],
                    F.element_at(F.filter(F.col("gs"), lambda g: values_agree(g, x)), 1)["first"]
                    .alias("opened")))).alias("p"))
            .select(*FACT, "p.*"))


def group_claims(claims: DataFrame) -> DataFrame:
    """Each claim with its group: ``group_no`` counts groups in the order they were opened."""
    live = claims.where("value_num is not null or value_str is not null or value_bool is not null")
    # the order key holds no NULL: the walk is over (-score, page, ingest)
    order = F.struct((-F.col("score")).alias("s"), F.col("page").alias("p"), F.col("seq").alias("n"))
    values = live.groupBy(*FACT, *VALUE).agg(F.min(order).alias("first"))
    values = values.select(*FACT, F.struct("first", *_comparable(F.col("field")), *VALUE).alias("v"))
    values = kept(values.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*FACT))))
    many = (F.col("v.q") == "") & (F.col("_n") > FOLDED)
    placed = led_values(values.where(many).drop("_n")).unionByName(walked_values(values.where(~many).drop("_n")))
    nulls = F.lit("\u0000")
    key = F.concat_ws("|", F.col("value_type"), F.coalesce(F.col("value_num").cast("string"), nulls),
                      F.coalesce("value_str", nulls), F.coalesce(F.col("value_bool").cast("string"), nulls))
    numbered = placed.withColumn(
        "group_no", F.dense_rank().over(W.partitionBy(*FACT).orderBy("opened"))).withColumn("_k", key)
    return (live.withColumn("_k", key)
            .join(numbered.select(*FACT, "_k", "group_no"), [*FACT, "_k"]).drop("_k"))


def group_stats(grouped: DataFrame) -> DataFrame:
    """One row per group with everything the ranking and the confidence need."""
    spec = F.length(value_text())
    best = F.struct(spec.alias("len"), F.col("score").alias("s"), (-F.col("page")).alias("p"),
                    (-F.col("seq")).alias("n"))
    head = F.struct((-F.col("score")).alias("s"), (-spec).alias("len"), F.col("page").alias("p"),
                    F.col("seq").alias("n"))
    shown = F.struct(*VALUE)
    lead = F.struct("raw", "page", "sheet", "label", "method", "source", *VALUE)
    # pages, sheets and readers of a set are few; three distinct counts would move every claim three times
    distinct = lambda c: F.size(F.collect_set(c)).cast("bigint")
    return grouped.groupBy(*FACT, "group_no").agg(
        F.max("score").alias("max_score"),
        distinct("page").alias("n_pages"),
        F.count(F.lit(1)).alias("n_claims"),
        F.max(F.coalesce(F.upper(F.substring("sheet", 1, 1)) == "G", F.lit(False))).alias("general"),
        F.min("page").alias("min_page"), distinct("sheet").alias("n_sheets"),
        distinct("method").alias("n_methods"),
        F.max_by(shown, best).alias("value"),
        F.min_by(lead, head).alias("lead"))


def resolve(grouped: DataFrame) -> DataFrame:
    """Groups of every fact in rank order; rank 1 is the answer."""
    w = W.partitionBy(*FACT).orderBy(
        F.desc("max_score"), F.desc("n_pages"), F.desc("n_claims"), F.desc("general"),
        F.asc("min_page"), F.asc("group_no"))
    return group_stats(grouped).withColumn("rank", F.row_number().over(w))


def confidence(ranked: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """HIGH when the winning group rests on two independent readings, else MEDIUM.

    Without source entities a reading is a (page, reader); with them, ``clusters`` says how
    many separate readings a group holds (``reading_clusters``).
    """
    spans = (F.col("n_pages") > 1) | (F.col("n_methods") > 1)
    out = ranked
    if clusters is not None:
        out = out.join(clusters, [*FACT, "group_no"], "left")
        spans = spans & (F.coalesce("n_clusters", F.lit(2)) > 1)
    out = out.withColumn("confidence", F.when(spans, "high").otherwise("medium"))
    return out.drop("n_clusters") if clusters is not None else out


def reading_clusters(grouped: DataFrame) -> DataFrame:
    """Claims of a group that share an entity are one reading; how many readings remain.

    A group of one claim, or of claims that name the same entities, is one reading as it stands; only
    the others are taken apart into components.
    """
    plain = F.array(F.concat_ws("|", F.col("page").cast("string"), "method"))
    has = F.size(F.coalesce("source", F.array().cast("array<string>"))) > 0
    tokens = grouped.select(*FACT, "group_no", F.when(has, F.col("source")).otherwise(plain)
                            .alias("tokens"))
    keys = [*FACT, "group_no"]
    tokens = tokens.withColumn("tokens", F.array_sort(F.array_distinct("tokens")))
    ends = tokens.groupBy(*keys).agg(F.min("tokens").alias("lo"), F.max("tokens").alias("hi"))
    alone = ends.where("lo = hi").select(*keys, F.lit(1).cast("bigint").alias("n_clusters"))
    tokens = kept(tokens.join(ends.where("lo <> hi").select(*keys), keys, "left_semi").distinct())
    nodes = tokens.select(*keys, F.explode("tokens").alias("id")).distinct()
    edges = tokens.where(F.size("tokens") > 1).select(
        *keys, F.element_at("tokens", 1).alias("a"), F.explode("tokens").alias("b"))
    found = connected_components(nodes, edges, keys)
    return alone.unionByName(found.groupBy(*keys).agg(F.count_distinct("label").alias("n_clusters")))


def rivals(ranked: DataFrame) -> DataFrame:
    """Losing groups strong enough to be a disagreement the set contains."""
    return ranked.where((F.col("rank") > 1) & (F.col("max_score") >= V.RIVAL_SCORE))


def conflicts(ranked: DataFrame) -> DataFrame:
    """Facts with at least one rival."""
    return rivals(ranked).groupBy(*FACT).agg(F.count(F.lit(1)).alias("n_rivals"))


def stating_sheets(grouped: DataFrame, ranked: DataFrame) -> DataFrame:
    """Sheets of the winning group, told apart: those that state the value again, and those
    that only show the leading claim's own drawing entity again."""
    won = ranked.where("rank = 1").select(
        *FACT, "group_no", F.col("lead.sheet").alias("home"), F.col("lead.source").alias("mine"))
    mine = F.coalesce("mine", F.array().cast("array<string>"))
    same = F.coalesce(F.arrays_overlap("source", mine), F.lit(False))
    per = (grouped.join(won, [*FACT, "group_no"])
           .groupBy(*FACT, "sheet", "home").agg(F.bool_and(same).alias("only_shown")))
    return per.withColumn("stating", (F.col("sheet") == F.col("home")) | ~F.col("only_shown"))


def resolved_facts(claims: DataFrame, with_sources: bool = False) -> DataFrame:
    """Claims to one row per fact: value, leading claim, confidence and number of rivals."""
    grouped = group_claims(dedupe_claims(claims))
    ranked = resolve(grouped)
    clusters = reading_clusters(grouped) if with_sources else None
    graded = confidence(ranked, clusters)
    strong = F.when((F.col("rank") > 1) & (F.col("max_score") >= V.RIVAL_SCORE), 1).otherwise(0)
    n_rivals = F.sum(strong).over(W.partitionBy(*FACT))
    stating = stating_sheets(grouped, ranked).groupBy(*FACT).agg(F.count_if("stating").alias("n_stating"))
    return (graded.withColumn("n_rivals", n_rivals).where("rank = 1").join(stating, FACT)
            .select(*FACT, "value.*", "confidence", "n_rivals", "n_pages", "n_sheets", "n_stating", "n_claims", "n_methods",
                    "max_score", "lead"))


def fact_summary(resolved: DataFrame, fields: list[str]) -> DataFrame:
    """One wide row per set: the written-out value of each listed field (role folded in)."""
    name = F.when(F.col("role") == "", F.col("field")).otherwise(F.concat_ws(":", "field", "role"))
    shown = resolved.select("set_id", name.alias("name"), value_text().alias("value"))
    return shown.groupBy("set_id").pivot("name", fields).agg(F.first("value", ignorenulls=True))
