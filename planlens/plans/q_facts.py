"""Registered queries: claims, facts and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlens.functions import vocabulary as V
from planlens.operators import facts as FX, reconcile as R, sweep as SW
from planlens.plans.adapters import adapter, with_views
from planlens.plans.registry import query, table
from planlens.sources.catalog import questions


def claims(spark, d):
    return adapter(spark, d, "a_claims").withColumn("source", F.array().cast("array<string>"))


@query("clm_dedupe", with_views("a_claims") + """
SELECT DISTINCT set_id, field, value_num, raw, page, method FROM a_claims""")
def clm_dedupe(spark, d):
    return FX.dedupe_claims(claims(spark, d)).select("set_id", "field", "value_num", "raw", "page", "method")


_GROUPS = with_views("a_claims") + """,
opened AS (
  SELECT set_id, field, value_num, max(score) AS max_score, count(DISTINCT page) AS n_pages,
         count(*) AS n_claims, max(CASE WHEN sheet LIKE 'G%' THEN 1 ELSE 0 END) AS general,
         min(page) AS min_page, count(DISTINCT method) AS n_methods,
         min(ROW(-score, page, seq)) AS first
  FROM a_claims GROUP BY set_id, field, value_num),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY set_id, field ORDER BY first) AS group_no
  FROM opened),
resolved AS (
  SELECT *, row_number() OVER (PARTITION BY set_id, field ORDER BY max_score DESC, n_pages DESC,
         n_claims DESC, general DESC, min_page, group_no) AS rank FROM ranked)
"""


@query("fct_group", _GROUPS + """
SELECT set_id, field, value_num, CAST(group_no AS INTEGER) AS group_no, n_claims FROM ranked""")
def fct_group(spark, d):
    g = FX.group_claims(claims(spark, d))
    return g.groupBy("set_id", "field", "value_num", "group_no").agg(F.count(F.lit(1)).alias("n_claims"))


@query("fct_group_tolerance")
def fct_group_tolerance(spark, d):
    """Grouping with a tolerance that is not transitive: line amounts as areas of one part."""
    c = (adapter(spark, d, "lineitem").select(
        F.col("l_partkey").alias("set_id"), F.lit("total_area_sf").alias("field"), F.lit("").alias("role"),
        F.lit("num").alias("value_type"), F.col("l_extendedprice").alias("value_num"),
        F.lit(None).cast("string").alias("value_str"), F.lit(None).cast("boolean").alias("value_bool"),
        F.round(1 - F.col("l_discount"), 2).alias("score"), F.col("l_linenumber").alias("page"),
        F.col("l_orderkey").alias("seq")))
    g = FX.group_claims(c)
    return g.groupBy("set_id", "group_no").agg(F.count(F.lit(1)).alias("n_claims"),
                                               F.min("value_num").alias("lo"), F.max("value_num").alias("hi"))


@query("fct_resolve", _GROUPS + """
SELECT set_id, field, value_num, max_score, n_pages, n_claims FROM resolved WHERE rank = 1""")
def fct_resolve(spark, d):
    r = FX.resolve(FX.group_claims(claims(spark, d)))
    return r.where("rank = 1").select("set_id", "field", "value.value_num", "max_score", "n_pages", "n_claims")


@query("fct_rivals", _GROUPS + """
SELECT set_id, field, value_num, max_score, CAST(rank AS INTEGER) AS rank FROM resolved
WHERE rank > 1 AND max_score >= 0.9""")
def fct_rivals(spark, d):
    r = FX.rivals(FX.resolve(FX.group_claims(claims(spark, d))))
    return r.select("set_id", "field", "value.value_num", "max_score", "rank")


@query("fct_conflicts", _GROUPS + """
SELECT set_id, field, count(*) AS n_rivals FROM resolved WHERE rank > 1 AND max_score >= 0.9
GROUP BY set_id, field""")
def fct_conflicts(spark, d):
    r = FX.resolve(FX.group_claims(claims(spark, d)))
    return FX.conflicts(r).select("set_id", "field", "n_rivals")


@query("fct_independent", _GROUPS + """
SELECT set_id, field, value_num, CASE WHEN n_pages > 1 OR n_methods > 1 THEN 'high' ELSE 'medium' END
       AS confidence FROM resolved WHERE rank = 1""")
def fct_independent(spark, d):
    r = FX.confidence(FX.resolve(FX.group_claims(claims(spark, d)))).where("rank = 1")
    return r.select("set_id", "field", "value.value_num", "confidence")


def sourced(spark, d):
    """Claims whose drawing entity is the part: one part on two lines is one reading."""
    return adapter(spark, d, "a_claims").withColumn(
        "source", F.array(F.concat(F.lit("e"), "raw"), F.concat(F.lit("s"), (F.col("seq") % 100).cast("string"))))


@query("fct_independent_sources")
def fct_independent_sources(spark, d):
    g = FX.group_claims(sourced(spark, d))
    r = FX.confidence(FX.resolve(g), FX.reading_clusters(g)).where("rank = 1")
    return r.groupBy("field", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("fct_stating", _GROUPS + """,
won AS (SELECT c.set_id, c.field, c.sheet, c.raw, c.value_num,
               first_value(c.sheet) OVER w AS home, first_value(c.raw) OVER w AS mine
        FROM a_claims c JOIN resolved r ON r.set_id = c.set_id AND r.field = c.field
             AND r.value_num = c.value_num AND r.rank = 1
        WINDOW w AS (PARTITION BY c.set_id, c.field ORDER BY c.score DESC, c.page, c.seq))
SELECT set_id, field, sheet, sheet = home OR NOT bool_and(raw = mine) AS stating
FROM won GROUP BY set_id, field, sheet, home""")
def fct_stating(spark, d):
    c = adapter(spark, d, "a_claims").withColumn("source", F.array("raw"))
    g = FX.group_claims(c)
    return FX.stating_sheets(g, FX.resolve(g)).select("set_id", "field", "sheet", "stating")


@query("fct_summary", _GROUPS + """
SELECT set_id, max(CASE WHEN field = 'A' THEN CAST(value_num AS VARCHAR) END) AS "A",
       max(CASE WHEN field = 'N' THEN CAST(value_num AS VARCHAR) END) AS "N",
       max(CASE WHEN field = 'R' THEN CAST(value_num AS VARCHAR) END) AS "R"
FROM resolved WHERE rank = 1 GROUP BY set_id""")
def fct_summary(spark, d):
    return FX.fact_summary(FX.resolved_facts(claims(spark, d)), ["A", "N", "R"])


# ---- declared beside drawn -------------------------------------------------------------------

def long_side(df, *fields):
    """total/stories/zoning columns as (field, value_num, value_str, value_bool) rows."""
    none_n, none_s, none_b = (F.lit(None).cast(t) for t in ("double", "string", "boolean"))
    rows = F.array(
        F.struct(F.lit("total_area_sf").alias("field"), F.col("total").alias("value_num"),
                 none_s.alias("value_str"), none_b.alias("value_bool")),
        F.struct(F.lit("stories").alias("field"), F.col("stories").alias("value_num"),
                 none_s.alias("value_str"), none_b.alias("value_bool")),
        F.struct(F.lit("zoning").alias("field"), none_n.alias("value_num"),
                 F.col("zoning").alias("value_str"), none_b.alias("value_bool")))
    return df.select("set_id", *fields, F.explode(rows).alias("v")).select("set_id", *fields, "v.*")


def declared(spark, d):
    return long_side(adapter(spark, d, "a_declared").withColumn("stories", F.col("stories").cast("double")))


def drawn(spark, d):
    return long_side(adapter(spark, d, "a_drawn"), "page")


_STATES = with_views("a_declared", "a_drawn") + """,
dec AS (SELECT set_id, 'total_area_sf' AS field, total AS n, CAST(NULL AS VARCHAR) AS s FROM a_declared
        UNION ALL SELECT set_id, 'stories', CAST(stories AS DOUBLE), NULL FROM a_declared
        UNION ALL SELECT set_id, 'zoning', NULL, upper(zoning) FROM a_declared),
drw AS (SELECT set_id, 'total_area_sf' AS field, total AS n, CAST(NULL AS VARCHAR) AS s, page FROM a_drawn
        UNION ALL SELECT set_id, 'stories', stories, NULL, page FROM a_drawn
        UNION ALL SELECT set_id, 'zoning', NULL, upper(zoning), page FROM a_drawn),
rec AS (SELECT coalesce(a.set_id, b.set_id) AS set_id, coalesce(a.field, b.field) AS field,
               a.n AS dn, a.s AS ds, b.n AS wn, b.s AS ws, b.page,
               CASE WHEN a.set_id IS NOT NULL AND b.set_id IS NOT NULL THEN
                      CASE WHEN coalesce(a.field, b.field) = 'total_area_sf'
                             THEN CASE WHEN abs(a.n - b.n) <= greatest(50.0, 0.02 * greatest(abs(a.n), abs(b.n)))
                                       THEN 'CORROBORATED' ELSE 'CONFLICT' END
                           WHEN coalesce(a.field, b.field) = 'stories'
                             THEN CASE WHEN a.n = b.n THEN 'CORROBORATED' ELSE 'CONFLICT' END
                           ELSE CASE WHEN a.s = b.s THEN 'CORROBORATED' ELSE 'CONFLICT' END END
                    WHEN a.set_id IS NOT NULL THEN 'DECLARED_ONLY' ELSE 'DRAWN_ONLY' END AS state
        FROM dec a FULL OUTER JOIN drw b ON a.set_id = b.set_id AND a.field = b.field)
"""


def reconciled(spark, d):
    return R.reconcile(declared(spark, d), drawn(spark, d), questions(spark))


@query("rec_states", _STATES + """
SELECT set_id, field, state, dn AS declared_num, ds AS declared_str, wn AS drawn_num, ws AS drawn_str FROM rec""")
def rec_states(spark, d):
    return reconciled(spark, d).select("set_id", "field", "state", "declared_num", "declared_str", "drawn_num",
                                       "drawn_str")


@query("rec_scenarios", _STATES + """,
two AS (SELECT DISTINCT set_id FROM rec WHERE state = 'CONFLICT' AND field <> 'zoning'),
sc AS (SELECT r.*, s.scenario FROM rec r LEFT JOIN two USING (set_id)
       JOIN (VALUES ('as_drawn'), ('as_declared')) s(scenario)
         ON s.scenario = 'as_drawn' OR two.set_id IS NOT NULL)
SELECT set_id, field, scenario, state,
       CASE WHEN state = 'DECLARED_ONLY' OR (state = 'CONFLICT' AND scenario = 'as_declared') THEN dn ELSE wn END AS num,
       CASE WHEN state = 'DECLARED_ONLY' OR (state = 'CONFLICT' AND scenario = 'as_declared') THEN ds ELSE ws END AS str,
       CASE state WHEN 'CORROBORATED' THEN 'both' WHEN 'DECLARED_ONLY' THEN 'declaration' ELSE 'drawings' END AS basis
FROM sc""".replace("LEFT JOIN two USING (set_id)", "LEFT JOIN two ON two.set_id = r.set_id"))
def rec_scenarios(spark, d):
    return R.scenarios(reconciled(spark, d)).select("set_id", "field", "scenario", "state", "num", "str", "basis")


@query("rec_basis", _STATES + """
SELECT set_id, CASE WHEN bool_or(state = 'DECLARED_ONLY') THEN 'declaration'
                    WHEN bool_and(state = 'CORROBORATED') THEN 'both' ELSE 'drawings' END AS basis
FROM rec GROUP BY set_id""")
def rec_basis(spark, d):
    rows = reconciled(spark, d).withColumn("basis", R.basis_of_state(F.col("state")))
    return R.weakest_basis(rows, ["set_id"])


@query("rec_report", _STATES + """
SELECT set_id, count(*) FILTER (WHERE dn IS NOT NULL OR ds IS NOT NULL) AS answered,
       string_agg(field || '=' || state, ',' ORDER BY field) AS states
FROM rec GROUP BY set_id HAVING count(*) FILTER (WHERE dn IS NOT NULL OR ds IS NOT NULL) > 0""")
def rec_report(spark, d):
    rep = R.declaration_report(reconciled(spark, d))
    said = F.array_sort(F.transform("fields", lambda x: F.concat(x["field"], F.lit("="), x["state"])))
    return rep.select("set_id", "answered", F.array_join(said, ",").alias("states"))


@query("rec_prefill", with_views("a_drawn") + """
SELECT set_id, 'height_ft' AS field, format('{:g}', floor(total / 1000) + 0.25) AS value, page FROM a_drawn
UNION ALL SELECT set_id, 'stories', CAST(CAST(stories AS BIGINT) AS VARCHAR), page FROM a_drawn
UNION ALL SELECT set_id, 'zoning', zoning, page FROM a_drawn""")
def rec_prefill(spark, d):
    w = drawn(spark, d).withColumn("source", F.lit("sheet"))
    area = F.col("field") == "total_area_sf"
    w = (w.withColumn("value_num", F.when(area, F.floor(F.col("value_num") / 1000) + 0.25).otherwise(F.col("value_num")))
         .withColumn("field", F.when(area, "height_ft").otherwise(F.col("field"))))
    return R.prefill(w, questions(spark)).select("set_id", "field", "value", "page")


_RAW = """
raw AS (SELECT c_custkey AS set_id,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'stories' WHEN 'AUTOMOBILE' THEN 'height_ft'
                    WHEN 'MACHINERY' THEN 'risk_category' WHEN 'HOUSEHOLD' THEN 'zoning'
                    ELSE 'favourite_colour' END AS field,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN CASE c_nationkey % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'II'
                      WHEN 2 THEN 'III' WHEN 3 THEN 'IV' ELSE 'VII' END
                    WHEN c_mktsegment = 'BUILDING' THEN CAST(CASE WHEN c_nationkey % 2 = 0 THEN floor(c_acctbal / 1000)
                      ELSE c_acctbal END AS STRING)
                    ELSE CAST(c_acctbal AS STRING) END AS text,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'number' WHEN 'AUTOMOBILE' THEN 'number' ELSE 'string' END AS kind_in
        FROM {customer})"""


@query("rec_validate", "WITH " + _RAW.format(customer="customer") + """
SELECT set_id, field, problem FROM (
  SELECT set_id, field, CASE WHEN field = 'favourite_colour' THEN 'not a declaration field'
       WHEN field = 'risk_category' AND text NOT IN ('I', 'II', 'III', 'IV') THEN 'not one of the choices'
       WHEN field = 'stories' AND CAST(text AS DOUBLE) <> floor(CAST(text AS DOUBLE)) THEN 'expected a whole number'
       WHEN field IN ('stories', 'height_ft') AND CAST(text AS DOUBLE) < 0 THEN 'expected a positive number'
       END AS problem FROM raw) WHERE problem IS NOT NULL""")
def rec_validate(spark, d):
    raw = spark.sql("WITH " + _RAW + " SELECT * FROM raw", customer=table(spark, d, "customer"))
    return R.validate_declarations(raw, questions(spark)).select("set_id", "field", "problem")


@query("rec_merge_answers", """
WITH new AS (SELECT o_custkey AS set_id, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS area,
                    max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS zoning
             FROM orders GROUP BY o_custkey)
SELECT coalesce(c.c_custkey, n.set_id) AS set_id, coalesce(n.area, c.c_acctbal) AS building_area_sf,
       coalesce(n.zoning, c.c_mktsegment) AS zoning
FROM customer c FULL OUTER JOIN new n ON n.set_id = c.c_custkey""")
def rec_merge_answers(spark, d):
    prev = table(spark, d, "customer").select(
        F.col("c_custkey").alias("set_id"), F.col("c_acctbal").alias("building_area_sf"),
        F.col("c_mktsegment").alias("zoning"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("set_id")).agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("building_area_sf"),
        F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("zoning"))
    return R.merge_answers(prev, new)


@query("rec_drawn", """
WITH u AS (
  SELECT l_orderkey AS set_id, sum(l_quantity) AS v, 'lines' AS source, 0 AS p FROM lineitem
    WHERE l_returnflag = 'R' GROUP BY l_orderkey
  UNION ALL SELECT o_orderkey, o_totalprice, 'order', 1 FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, CAST(o_custkey AS DOUBLE), 'text', 2 FROM orders)
SELECT set_id, arg_min(v, p) AS value_num, arg_min(source, p) AS source FROM u GROUP BY set_id""")
def rec_drawn(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")

    def shape(df, key, value, source):
        return df.select(F.col(key).alias("set_id"), F.lit("total_area_sf").alias("field"),
                         value.alias("value_num"), F.lit(None).cast("string").alias("value_str"),
                         F.lit(None).cast("boolean").alias("value_bool"), F.lit(source).alias("source"),
                         F.lit(0).alias("page"), F.lit("").alias("note"))
    stated = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    parts = (shape(stated, "l_orderkey", F.col("q"), "lines"),
             shape(o.where("o_orderstatus = 'F'"), "o_orderkey", F.col("o_totalprice"), "order"),
             shape(o, "o_orderkey", F.col("o_custkey").cast("double"), "text"))
    return R.drawn_values(*parts).select("set_id", "value_num", "source")


@query("rec_implication", """
WITH sep AS (SELECT o_orderkey AS set_id, substr(o_orderpriority, 1, 1) IN ('1', '2') AS cited,
                    CASE o_orderstatus WHEN 'F' THEN FALSE WHEN 'O' THEN TRUE END AS said FROM orders)
SELECT set_id, CASE WHEN cited THEN TRUE ELSE said END AS mixed, cited AND said IS NOT NULL AND NOT said AS overridden
FROM sep WHERE cited OR said IS NOT NULL""")
def rec_implication(spark, d):
    o = table(spark, d, "orders")
    nd, ns, nb = (F.lit(None).cast(t) for t in ("double", "string", "boolean"))
    cited = F.substring("o_orderpriority", 1, 1).isin("1", "2")
    said = F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "O", True)

    def rows(field, num, txt, flag):
        return o.select(F.col("o_orderkey").alias("set_id"), F.lit(field).alias("field"), num.alias("value_num"),
                        txt.alias("value_str"), flag.alias("value_bool"), F.lit("G-1").alias("source"),
                        F.lit(0).alias("page"), F.lit("").alias("note"))
    long = rows("separation_method", nd, F.when(cited, "separated").otherwise("nonseparated"), nb).unionByName(
        rows("mixed_occupancy", nd, ns, said).where("value_bool is not null"))
    out = R.apply_implication(long).where("field = 'mixed_occupancy'")
    return out.select("set_id", F.col("value_bool").alias("mixed"),
                      F.contains("note", F.lit("says not mixed")).alias("overridden"))


# An order is a page of its customer's set; it prints its own values, in the wording its status and priority give.
SWEPT_TEXT = """concat_ws(chr(10), CASE o_orderstatus WHEN 'F' THEN concat('Building area: ', CAST(floor(o_totalprice) AS BIGINT), ' SF')
  WHEN 'O' THEN concat('SQUARE FOOTAGE PER FLOOR (MAXIMUM)', chr(10), CAST(floor(o_totalprice) AS BIGINT), chr(10), '92,000')
  ELSE concat('AREA PER STORY = ', CAST(floor(o_totalprice) AS BIGINT)) END,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN concat('NUMBER OF STORIES: ', substr(o_orderpriority, 1, 1)) WHEN '2' THEN concat('STORIES ', substr(o_orderpriority, 1, 1))
  ELSE concat('FSPK ', substr(o_orderpriority, 1, 1), ' Story') END,
 concat('ZONING: ', o_orderpriority, '   PLAT ', CAST(o_orderkey AS STRING)), concat('Jurisdiction = ', CAST(o_orderdate AS STRING)))"""


def _swept_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    arms = "\n UNION ALL ".join(
        f"SELECT set_id, page, sheet, '{field}' AS field, {rank} AS rank, coalesce({', '.join(f'''nullif(regexp_extract(text, {quote('(?i)' + pattern)}, {g}), '')''' for g in [*range(1, groups + 1), 0])}) AS stated FROM p"
        for rank, (field, _, pattern, groups) in enumerate(V.TEXT_SWEEP))
    text = SWEPT_TEXT.replace("STRING", "VARCHAR")
    return f"""
WITH p AS MATERIALIZED (SELECT o_custkey AS set_id, o_orderkey AS page, CASE o_orderstatus WHEN 'O' THEN 'G-1' ELSE 'A-1' END AS sheet, {text} AS text FROM orders),
 h AS ({arms}),
 first AS (SELECT * FROM h WHERE stated IS NOT NULL QUALIFY row_number() OVER (PARTITION BY set_id, rank ORDER BY sheet[1] <> 'G', page) = 1)
SELECT set_id, field, page, sheet AS source, stated, CASE WHEN field IN ('building_area_sf', 'stories') THEN CAST(replace(stated, ',', '') AS DOUBLE) END AS value_num
FROM first QUALIFY row_number() OVER (PARTITION BY set_id, field ORDER BY rank) = 1"""


@query("rec_text_sweep", _swept_sql())
def rec_text_sweep(spark, d):
    """Questions answered from the running text of each set's pages."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("page"), F.expr(SWEPT_TEXT).alias("text"), "o_orderstatus")
    sheets = o.select("set_id", "page", F.when(F.col("o_orderstatus") == "O", "G-1").otherwise("A-1").alias("code"))
    out = SW.swept_values(SW.sweep_hits(o.drop("o_orderstatus"), sheets))
    return out.select("set_id", "field", "page", "source", "stated", "value_num")
