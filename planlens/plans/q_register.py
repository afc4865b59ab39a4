"""Registered queries: the register, calibration, feedback and abstentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlens.functions import vocabulary as V
from planlens.operators import abstentions as AB, calibration as C, feedback as FB, register as RG
from planlens.plans.adapters import adapter, with_views
from planlens.plans.registry import query, table
from planlens.sources.catalog import questions

RANK = ("CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 "
        "WHEN 'VERIFIED' THEN 4 WHEN 'MEASURED' THEN 5 ELSE 9 END")
TIES = ["title", "price", "qty", "supp"]
ORDERED = with_views("a_findings") + f""",
ordered AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY {RANK}, page, fid, scenario, title,
                   price, qty, supp) AS ord FROM a_findings)
"""


def findings(spark, d):
    return adapter(spark, d, "a_findings")


@query("reg_merge_scenarios", with_views("a_readings") + """,
n AS (SELECT *, row_number() OVER (PARTITION BY set_id, rule_id, sheet, anchor, fid, scenario
                                   ORDER BY status, severity, page, title, basis) AS i FROM a_readings),
a AS (SELECT * FROM n WHERE scenario = 'as_drawn'), b AS (SELECT * FROM n WHERE scenario = 'as_declared'),
j AS (SELECT a.set_id AS aset, b.set_id AS bset, a.rule_id AS arule, b.rule_id AS brule, a.fid AS afid, b.fid AS bfid,
             a.status AS ast, b.status AS bst, a.severity AS asv, b.severity AS bsv, a.page AS apg, b.page AS bpg,
             a.title AS att, b.title AS btt, a.basis AS abs_, b.basis AS bbs,
             a.set_id IS NOT NULL AND b.set_id IS NOT NULL AND a.status = b.status AND a.severity = b.severity
             AND a.page = b.page AND a.title = b.title AND a.basis = b.basis AS same
      FROM a FULL OUTER JOIN b ON a.set_id = b.set_id AND a.rule_id = b.rule_id AND a.sheet = b.sheet
           AND a.anchor = b.anchor AND a.fid = b.fid AND a.i = b.i)
SELECT aset AS set_id, arule AS rule_id, afid AS fid, ast AS status, asv AS severity, apg AS page, att AS title,
       abs_ AS basis, CASE WHEN same THEN 'both' ELSE 'as_drawn' END AS scenario FROM j WHERE aset IS NOT NULL
UNION ALL
SELECT bset, brule, bfid, bst, bsv, bpg, btt, bbs, 'as_declared' FROM j WHERE bset IS NOT NULL AND (same IS NULL OR NOT same)""")
def reg_merge_scenarios(spark, d):
    out = RG.merge_scenarios(adapter(spark, d, "a_readings"))
    return out.select("set_id", "rule_id", "fid", "status", "severity", "page", "title", "basis", "scenario")


@query("reg_dedupe_abstentions", with_views("a_abstentions") + """
SELECT DISTINCT set_id, rule_id, reason, page, detail FROM a_abstentions""")
def reg_dedupe_abstentions(spark, d):
    return RG.dedupe_abstentions(adapter(spark, d, "a_abstentions"))


@query("reg_severity_floor", with_views("a_findings") + f"""
SELECT f.set_id, f.fid, f.severity, f.price FROM a_findings f JOIN orders o ON o.o_orderkey = f.set_id
WHERE CASE WHEN severity = 'VERIFIED' THEN o_orderpriority <> '5-LOW' WHEN severity = 'MEASURED' THEN o_orderstatus <> 'F'
      ELSE {RANK} <= CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END END""")
def reg_severity_floor(spark, d):
    first = F.substring("o_orderpriority", 1, 1)
    options = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("set_id"),
        F.when(first == "1", "CRITICAL").when(first == "2", "HIGH").when(first == "3", "MEDIUM").otherwise("LOW")
        .alias("min_severity"),
        (F.col("o_orderpriority") != "5-LOW").alias("include_verified"),
        (F.col("o_orderstatus") != "F").alias("include_measured"))
    return RG.severity_floor(findings(spark, d), options).select("set_id", "fid", "severity", "price")


@query("reg_order", ORDERED + "SELECT set_id, fid, severity, page, title, price, ord FROM ordered")
def reg_order(spark, d):
    o = RG.order_register(findings(spark, d), TIES)
    return o.select("set_id", "fid", "severity", "page", "title", "price", "ord")


KEYED = ORDERED + """,
based AS (SELECT *, CASE WHEN scenario = 'as_declared' THEN fid || '@as_declared' ELSE fid END AS base FROM ordered),
keyed AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '~' || CAST(row_number() OVER w AS VARCHAR) END AS key
          FROM based WINDOW w AS (PARTITION BY set_id, base ORDER BY ord))
"""


@query("reg_keys", KEYED + "SELECT set_id, key, ord, price FROM keyed")
def reg_keys(spark, d):
    return RG.finding_keys(RG.order_register(findings(spark, d), TIES)).select("set_id", "key", "ord", "price")


@query("reg_evidence", with_views("a_findings", "a_drawn") + """,
facts AS (SELECT set_id, 'total_area_sf' AS field, CAST(total AS VARCHAR) AS fact_value, page AS fact_page FROM a_drawn
          UNION ALL SELECT set_id, 'zoning', zoning, page FROM a_drawn),
rf AS (SELECT p_brand AS rule_id, 'total_area_sf' AS field, 0 AS fact_ord FROM part WHERE p_brand LIKE '%1' GROUP BY p_brand
       UNION ALL SELECT p_brand, 'zoning', 1 FROM part GROUP BY p_brand)
SELECT f.set_id, f.fid, f.price, rf.field, rf.fact_ord, facts.fact_value, facts.fact_page
FROM a_findings f JOIN rf USING (rule_id) JOIN facts ON facts.set_id = f.set_id AND facts.field = rf.field""")
def reg_evidence(spark, d):
    drawn = adapter(spark, d, "a_drawn")
    facts = drawn.select("set_id", F.explode(F.array(
        F.struct(F.lit("total_area_sf").alias("field"), F.col("total").cast("string").alias("value")),
        F.struct(F.lit("zoning").alias("field"), F.col("zoning").alias("value")))).alias("v"), "page").select(
        "set_id", "v.*", "page", F.lit("").alias("role"), F.lit("printed").alias("quote"), F.lit("S-1").alias("sheet"),
        F.lit("pair").alias("method"), F.lit("stated").alias("basis"), F.lit("high").alias("confidence"))
    brands = table(spark, d, "part").select(F.col("p_brand").alias("rule_id")).distinct()
    rf = brands.where("rule_id like '%1'").select("rule_id", F.lit(0).alias("ord"), F.lit("total_area_sf").alias("field"),
                                                  F.lit("").alias("role")).unionByName(
        brands.select("rule_id", F.lit(1).alias("ord"), F.lit("zoning").alias("field"), F.lit("").alias("role")))
    out = RG.evidence(findings(spark, d), facts, rf)
    return out.select("set_id", "fid", "price", "field", "fact_ord", "fact_value", "fact_page")


@query("reg_viewer_rect", """
WITH b AS (SELECT l_orderkey AS set_id, l_partkey AS part, CAST(l_linenumber AS DOUBLE) * 10 AS x0, l_quantity AS y0,
                  CAST(l_linenumber AS DOUBLE) * 10 + 25 AS x1, l_quantity + 12 AS y1, (l_suppkey % 4) * 90 AS r FROM lineitem)
SELECT set_id, part,
  CASE r WHEN 90 THEN 792 - y1 WHEN 180 THEN 1224 - x1 WHEN 270 THEN y0 ELSE x0 END AS vx0,
  CASE r WHEN 90 THEN x0 WHEN 180 THEN 792 - y1 WHEN 270 THEN 1224 - x1 ELSE y0 END AS vy0,
  CASE r WHEN 90 THEN 792 - y0 WHEN 180 THEN 1224 - x0 WHEN 270 THEN y1 ELSE x1 END AS vx1,
  CASE r WHEN 90 THEN x1 WHEN 180 THEN 792 - y0 WHEN 270 THEN 1224 - x0 ELSE y1 END AS vy1 FROM b""")
def reg_viewer_rect(spark, d):
    li = table(spark, d, "lineitem")
    b = li.select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("part"),
                  (F.col("l_linenumber") * 10.0).alias("x0"), F.col("l_quantity").alias("y0"),
                  (F.col("l_linenumber") * 10.0 + 25).alias("x1"), (F.col("l_quantity") + 12).alias("y1"),
                  F.lit(1224.0).alias("w"), F.lit(792.0).alias("h"), ((F.col("l_suppkey") % 4) * 90).alias("r"))
    return b.select("set_id", "part", *RG.viewer_rect("", "w", "h", "r"))


@query("reg_summary", with_views("a_findings") + """
SELECT set_id, count(*) AS findings_count,
       count(*) FILTER (WHERE severity = 'CRITICAL') AS n_critical, count(*) FILTER (WHERE severity = 'HIGH') AS n_high,
       count(*) FILTER (WHERE severity = 'MEDIUM') AS n_medium, count(*) FILTER (WHERE severity = 'LOW') AS n_low,
       count(*) FILTER (WHERE severity = 'VERIFIED') AS n_verified, count(*) FILTER (WHERE severity = 'MEASURED') AS n_measured,
       count(*) FILTER (WHERE status IN ('OPEN', 'CONFLICT')) AS n_open, count(*) FILTER (WHERE status = 'PASS') AS n_passed,
       count(*) FILTER (WHERE status = 'CONFLICT') AS n_conflicts
FROM a_findings GROUP BY set_id""")
def reg_summary(spark, d):
    return RG.summary(findings(spark, d))


@query("reg_sheet_rail", with_views("a_findings") + f""",
f AS (SELECT set_id, page, count(*) AS n, min({RANK}) AS w FROM a_findings WHERE status <> 'PASS' GROUP BY set_id, page),
p AS (SELECT DISTINCT l_orderkey AS set_id, l_linenumber AS page FROM lineitem),
m AS (SELECT l_orderkey AS set_id, l_linenumber AS page, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS c
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber)
SELECT p.set_id, p.page, coalesce(f.n, 0) AS n_open, coalesce(m.n, 0) AS n_marks, coalesce(m.c, 0) AS n_comments,
       CASE f.w WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' WHEN 4 THEN 'VERIFIED'
            WHEN 5 THEN 'MEASURED' ELSE '' END AS severity
FROM p LEFT JOIN f ON f.set_id = p.set_id AND f.page = p.page LEFT JOIN m ON m.set_id = p.set_id AND m.page = p.page""")
def reg_sheet_rail(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("page"),
                                            "l_returnflag", "l_linestatus")
    marks = li.where("l_returnflag = 'R'").select("set_id", "page", F.when(F.col("l_linestatus") == "O", "see")
                                                  .otherwise("").alias("comment"))
    return RG.sheet_rail(li.select("set_id", "page").distinct(), findings(spark, d), marks)


def edits(spark, d):
    """An edit per conversation turn against the finding its text length picks."""
    t = table(spark, d, "conversations")
    n = F.length("text")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs)).cast("int") + 1)
    return t.select(
        F.col("conv_id").alias("set_id"), F.concat(F.lit("F-"), (1 + n % 25).cast("string")).alias("key"),
        F.col("turn").cast("int").alias("pass"), n.cast("int").alias("ordinal"),
        pick("revise", "revise", "withdraw", "add").alias("op"), pick("", "OPEN", "PASS", "").alias("status"),
        pick("HIGH", "", "LOW", "VERIFIED", "CRITICAL").alias("severity"), pick("", "new title", "").alias("title"),
        pick("misread", "because", "").alias("reason"), F.col("text").alias("quote"),
        (n % 4 != 0).alias("quote_found"), (n % 7).cast("int").alias("page"))


def reviewed(spark, d):
    keyed = RG.finding_keys(RG.order_register(findings(spark, d), TIES))
    return RG.review_edits(keyed, edits(spark, d))


@query("reg_edits")
def reg_edits(spark, d):
    return reviewed(spark, d)[0].select("set_id", "key", "added", "was_status", "status", "was_severity", "severity", "held", "gone",
                                        F.size("rejected").alias("n_rejected"))


@query("reg_edits_added", """
WITH e AS (SELECT conv_id AS set_id, turn, text, length(text) AS n FROM conversations WHERE length(text) % 4 = 3),
a AS (SELECT *, CASE n % 5 WHEN 0 THEN 'HIGH' WHEN 2 THEN 'LOW' WHEN 4 THEN 'CRITICAL' END AS severity FROM e WHERE n % 3 = 1 AND trim(text) <> '')
SELECT set_id, printf('AI-%02d', row_number() OVER (PARTITION BY set_id ORDER BY turn, n)) AS key, 'OPEN' AS status, severity, 'new title' AS title,
       CAST(n % 7 AS INTEGER) AS page
FROM a WHERE severity IS NOT NULL""")
def reg_edits_added(spark, d):
    return RG.added_findings(edits(spark, d)).select("set_id", "key", "status", "severity", "title", "page")


@query("reg_edits_withdrawn")
def reg_edits_withdrawn(spark, d):
    return RG.withdrawal_abstentions(reviewed(spark, d)[0])


@query("reg_fingerprint")
def reg_fingerprint(spark, d):
    return RG.fingerprint(findings(spark, d), adapter(spark, d, "a_abstentions"))


@query("reg_plan_rereads", """
WITH req AS (SELECT DISTINCT l_orderkey AS set_id, l_linenumber AS page,
               CASE l_returnflag WHEN 'A' THEN 'height_ft' WHEN 'N' THEN 'stories' ELSE 'nothing' END AS field FROM lineitem),
tried AS (SELECT DISTINCT l_orderkey AS set_id, l_linenumber AS page,
               CASE l_returnflag WHEN 'A' THEN 'height_ft' WHEN 'N' THEN 'stories' ELSE 'nothing' END AS field
          FROM lineitem WHERE l_linestatus = 'F'),
ok AS (SELECT * FROM req WHERE field <> 'nothing' AND NOT EXISTS (SELECT 1 FROM tried t WHERE t.set_id = req.set_id
       AND t.page = req.page AND t.field = req.field)),
r AS (SELECT *, dense_rank() OVER (PARTITION BY set_id ORDER BY page) AS k FROM ok)
SELECT set_id, page, field FROM r WHERE k <= 8""")
def reg_plan_rereads(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("page"),
        F.when(F.col("l_returnflag") == "A", "height_ft").when(F.col("l_returnflag") == "N", "stories")
        .otherwise("nothing").alias("field"), "l_linestatus")
    from planlens.sources.catalog import catalog
    return RG.plan_rereads(li, li.select("set_id", "page").distinct(), li.where("l_linestatus = 'F'"), catalog(spark), V.MAX_REREAD_PAGES)


GRADED = with_views("a_findings", "a_abstentions") + """,
e AS (SELECT DISTINCT l_orderkey AS set_id, concat('E', CAST(l_suppkey % 30 AS VARCHAR)) AS entry,
             CASE l_suppkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'VERIFIED' ELSE 'MEDIUM' END AS severity FROM lineitem),
rm AS (SELECT DISTINCT concat('E', CAST(p_partkey % 27 AS VARCHAR)) AS entry, p_brand AS rule_id FROM part),
f AS (SELECT DISTINCT set_id, rule_id, status, severity FROM a_findings),
ab AS (SELECT set_id, rule_id, min(reason) AS reason FROM a_abstentions GROUP BY set_id, rule_id),
g AS (SELECT e.set_id, e.entry, e.severity, rm.rule_id, ab.reason,
        CASE WHEN f.status IS NULL THEN 0
             WHEN CASE WHEN f.severity IN ('VERIFIED', 'MEASURED') THEN 'PASS' ELSE f.status END
                  = CASE WHEN e.severity = 'VERIFIED' THEN 'PASS' ELSE 'OPEN' END
                  AND (f.severity = e.severity OR (f.severity IN ('VERIFIED', 'MEASURED') AND e.severity = 'VERIFIED')) THEN 2
             ELSE 1 END AS grade
      FROM e LEFT JOIN rm ON rm.entry = e.entry LEFT JOIN f ON f.set_id = e.set_id AND f.rule_id = rm.rule_id
           LEFT JOIN ab ON ab.set_id = e.set_id AND ab.rule_id = rm.rule_id),
rows_ AS (SELECT set_id, entry, severity, max(grade) AS grade, count(rule_id) AS rules, min(reason) AS reason FROM g
          GROUP BY set_id, entry, severity)
"""


def graded(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    s3 = F.col("l_suppkey") % 3
    expected = li.select(
        F.col("l_orderkey").alias("set_id"), F.concat(F.lit("E"), (F.col("l_suppkey") % 30).cast("string")).alias("entry"),
        F.when(s3 == 0, "HIGH").when(s3 == 1, "VERIFIED").otherwise("MEDIUM").alias("severity")).distinct()
    rule_map = p.select(F.concat(F.lit("E"), (F.col("p_partkey") % 27).cast("string")).alias("entry"),
                        F.col("p_brand").alias("rule_id")).distinct()
    return RG.scorecard(findings(spark, d), adapter(spark, d, "a_abstentions"), expected, rule_map)


@query("reg_scorecard", GRADED + """
SELECT set_id, entry, severity, CASE grade WHEN 0 THEN 'missed' WHEN 1 THEN 'partial' ELSE 'exact' END AS outcome,
       CASE WHEN grade > 0 THEN '' WHEN rules = 0 THEN 'no rule for this check' WHEN reason IS NOT NULL
            THEN 'abstained: ' || reason ELSE 'rule not registered' END AS note FROM rows_""")
def reg_scorecard(spark, d):
    return graded(spark, d)


@query("reg_scorecard_totals", GRADED + """
SELECT set_id, count(*) FILTER (WHERE severity <> 'VERIFIED') AS open_total,
       count(*) FILTER (WHERE severity <> 'VERIFIED' AND grade = 2) AS open_exact,
       count(*) FILTER (WHERE severity <> 'VERIFIED' AND grade = 1) AS open_partial,
       count(*) FILTER (WHERE severity = 'VERIFIED') AS verified_total,
       count(*) FILTER (WHERE severity = 'VERIFIED' AND grade = 2) AS verified_exact,
       count(*) FILTER (WHERE severity = 'VERIFIED' AND grade = 1) AS verified_partial FROM rows_ GROUP BY set_id""")
def reg_scorecard_totals(spark, d):
    return RG.scorecard_totals(graded(spark, d))


# ---- calibration ------------------------------------------------------------------------------

def listed(c):
    return F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))


def profile(spark, d, name="a_profile"):
    p = adapter(spark, d, name)
    return p.withColumn("scope_occupancy", listed("scope_occ")).withColumn("scope_basis", listed("scope_bas")).drop(
        "scope_occ", "scope_bas")


def applied(spark, d):
    f = findings(spark, d).join(adapter(spark, d, "a_set_group"), "set_id", "left")
    return C.apply_profile(f, profile(spark, d))


APPLIED = with_views("a_findings", "a_profile", "a_set_group") + f""",
r AS (SELECT f.*, g.occupancy_group AS grp, p.*, {RANK} AS rk,
        CASE p.severity_cap WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 0 END AS capr,
        CASE p.severity_floor WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 3 END AS flr
      FROM a_findings f LEFT JOIN a_set_group g ON g.set_id = f.set_id JOIN a_profile p ON p.rule_id = f.rule_id),
a AS (SELECT *, CASE WHEN NOT enabled THEN 'enabled' WHEN coalesce(grp, '') <> '' AND scope_occ = grp THEN 'scope_occupancy'
                     WHEN scope_bas = basis THEN 'scope_basis' WHEN drop_verified AND severity = 'VERIFIED' THEN 'drop_verified' END AS sup,
        CASE WHEN rk > 3 THEN severity ELSE ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][
             CAST(least(greatest(greatest(0, least(3, rk - severity_shift)), capr), flr) AS INTEGER) + 1] END AS moved FROM r)
"""


@query("cal_apply", APPLIED + """
SELECT set_id, fid, price, coalesce(sup, CASE WHEN moved <> severity THEN 'severity_shift' END) AS knob, severity AS before,
       CASE WHEN sup IS NOT NULL THEN 'suppressed' ELSE moved END AS after,
       CASE WHEN sup IS NOT NULL THEN 'suppressed' ELSE 'kept' END AS disposition FROM a""")
def cal_apply(spark, d):
    return applied(spark, d).select("set_id", "fid", "price", "knob", "before", "after", "disposition")


@query("cal_silenced", APPLIED + """
SELECT set_id, rule_id, max(sup) AS detail, 'suppressed by calibration' AS reason FROM a
WHERE sup IN ('enabled', 'scope_occupancy') GROUP BY set_id, rule_id""")
def cal_silenced(spark, d):
    return C.silenced(applied(spark, d))


@query("cal_shift", with_views("a_findings", "a_profile") + f""",
s AS (SELECT f.severity, {RANK} AS rk, p.severity_shift AS sh FROM a_findings f JOIN a_profile p ON p.rule_id = f.rule_id)
SELECT severity, CASE WHEN rk > 3 THEN severity ELSE ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][CAST(greatest(0, least(3, rk - sh)) AS INTEGER) + 1] END
       AS moved, count(*) AS n FROM s GROUP BY 1, 2""")
def cal_shift(spark, d):
    f = findings(spark, d).join(profile(spark, d).select("rule_id", "severity_shift"), "rule_id")
    none = F.lit(None).cast("string")
    moved = C.shift_severity(F.col("severity"), F.col("severity_shift"), none, none)
    return f.groupBy("severity", moved.alias("moved")).agg(F.count(F.lit(1)).alias("n"))


@query("cal_order", APPLIED + """
SELECT set_id, fid, moved AS severity, price, row_number() OVER (PARTITION BY set_id ORDER BY
         CASE moved WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'MEASURED' THEN 4 ELSE 5 END,
         weight DESC, page, fid, scenario, title, price, qty, supp) AS ord
FROM a WHERE sup IS NULL""")
def cal_order(spark, d):
    o = C.calibrated_order(C.kept(applied(spark, d)), TIES)
    return o.select("set_id", "fid", "severity", "price", "ord")


_CHANGES = """
SELECT o_orderkey AS ordinal, concat('Brand#', CAST(1 + o_custkey % 25 AS STRING)) AS rule_id,
       CASE o_orderstatus WHEN 'F' THEN 'severity_shift' WHEN 'O' THEN 'weight' ELSE
            CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'confirmations' WHEN '2' THEN 'severity_cap'
                 WHEN '3' THEN 'enabled' WHEN '4' THEN 'scope_basis' ELSE 'colour' END END AS knob,
       CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey % 9 - 4 AS STRING)
            WHEN 'O' THEN CAST(CAST(o_custkey % 70 AS DOUBLE) / 10 AS STRING) ELSE
            CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '1' WHEN '2' THEN
                 CASE o_custkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'VERIFIED' ELSE 'LOW' END
                 WHEN '3' THEN CASE o_custkey % 3 WHEN 0 THEN 'false' ELSE 'true' END
                 WHEN '4' THEN 'drawings|declaration|drawings' ELSE 'red' END END AS value
FROM {orders}"""

_CLAMP = """CASE knob WHEN 'severity_shift' THEN CAST(greatest(-2, least(2, CAST(value AS INTEGER))) AS VARCHAR)
       WHEN 'weight' THEN CAST(greatest(CAST(0.1 AS DOUBLE), least(CAST(5.0 AS DOUBLE), CAST(value AS DOUBLE))) AS VARCHAR)
       WHEN 'severity_cap' THEN CASE WHEN value IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN value END
       WHEN 'enabled' THEN value WHEN 'scope_basis' THEN 'declaration|drawings' END"""


def changes(spark, d):
    return spark.sql(_CHANGES, orders=table(spark, d, "orders"))


@query("cal_clamp", f"""WITH c AS ({_CHANGES.format(orders='orders')})
SELECT ordinal, rule_id, knob, value, TRY({_CLAMP}) AS clamped FROM c""")
def cal_clamp(spark, d):
    return C.clamp_knobs(changes(spark, d), C.knobs(spark)).select("ordinal", "rule_id", "knob", "value", "clamped")


@query("cal_versions", with_views("a_profile") + f""",
c AS ({_CHANGES.format(orders='orders')}),
k AS (SELECT rule_id, knob, arg_max({_CLAMP.replace("CASE WHEN value IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN value END", "CASE WHEN value IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN value ELSE '-' END")}, ordinal) AS v FROM c
      WHERE knob NOT IN ('confirmations', 'colour') GROUP BY rule_id, knob),
w AS (SELECT rule_id, max(CASE WHEN knob = 'severity_shift' THEN v END) AS sh, max(CASE WHEN knob = 'weight' THEN v END) AS wt,
             max(CASE WHEN knob = 'severity_cap' THEN v END) AS cp, max(CASE WHEN knob = 'enabled' THEN v END) AS en,
             max(CASE WHEN knob = 'scope_basis' THEN v END) AS sb FROM k GROUP BY rule_id),
cf AS (SELECT rule_id, count(*) AS n FROM c WHERE knob = 'confirmations' GROUP BY rule_id)
SELECT coalesce(p.rule_id, w.rule_id) AS rule_id, 2 AS version,
       coalesce(CAST(en AS BOOLEAN), p.enabled, TRUE) AS enabled, coalesce(CAST(sh AS INTEGER), p.severity_shift, 0) AS severity_shift,
       CASE WHEN cp = '-' THEN NULL WHEN cp IS NOT NULL THEN cp ELSE p.severity_cap END AS severity_cap, p.severity_floor,
       coalesce(sb, p.scope_bas, '') AS scope_basis, coalesce(CAST(wt AS DOUBLE), p.weight, 1.0) AS weight,
       CAST(coalesce(p.confirmations, 0) + coalesce(cf.n, 0) AS INTEGER) AS confirmations
FROM a_profile p FULL OUTER JOIN w ON w.rule_id = p.rule_id LEFT JOIN cf ON cf.rule_id = coalesce(p.rule_id, w.rule_id)""")
def cal_versions(spark, d):
    n = C.next_version(profile(spark, d), changes(spark, d), C.knobs(spark))
    return n.select("rule_id", "version", "enabled", "severity_shift", "severity_cap", "severity_floor",
                    F.array_join("scope_basis", "|").alias("scope_basis"), "weight", "confirmations")


def versions(spark, d):
    """Four global versions and one candidate, from the part sizes."""
    p = table(spark, d, "part")
    g = p.select(F.col("p_brand").alias("rule_id"), (F.col("p_size") % 30).alias("version"),
                 F.lit("global").alias("scope"), F.lit("").alias("owner_uid"), F.col("p_partkey").alias("weight"))
    c = p.where("p_type = 'ECONOMY'").select(
        F.col("p_brand").alias("rule_id"), (F.col("p_size") % 5).alias("version"), F.lit("candidate").alias("scope"),
        F.concat(F.lit("u"), (F.col("p_partkey") % 3).cast("string")).alias("owner_uid"), F.col("p_partkey").alias("weight"))
    return g.unionByName(c)


@query("cal_active", """
SELECT p_brand AS rule_id, p_size % 30 AS version, p_partkey AS weight FROM part
WHERE p_size % 30 = (SELECT max(p_size % 30) FROM part)""")
def cal_active(spark, d):
    return C.active_profile(versions(spark, d)).select("rule_id", "version", "weight")


@query("cal_candidate", """
WITH own AS (SELECT p_brand AS rule_id, p_size % 5 AS version, concat('u', CAST(p_partkey % 3 AS VARCHAR)) AS owner_uid,
                    p_partkey AS weight FROM part WHERE p_type = 'ECONOMY'),
top AS (SELECT owner_uid, max(version) AS version FROM own GROUP BY owner_uid),
u AS (SELECT DISTINCT concat('u', CAST(user_id % 5 AS VARCHAR)) AS uid FROM events)
SELECT own.owner_uid, own.rule_id, own.version, own.weight FROM own JOIN top USING (owner_uid, version) JOIN u ON u.uid = own.owner_uid
UNION ALL
SELECT u.uid, p_brand, p_size % 30, p_partkey FROM u, part
WHERE p_size % 30 = (SELECT max(p_size % 30) FROM part) AND u.uid NOT IN (SELECT owner_uid FROM own)""")
def cal_candidate(spark, d):
    uids = table(spark, d, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("uid")).distinct()
    return C.candidate_profile(versions(spark, d), uids).select("owner_uid", "rule_id", "version", "weight")


@query("cal_version_list", """
SELECT p_size % 30 AS version, count(*) AS n_rules FROM part GROUP BY 1 ORDER BY 1 DESC LIMIT 25""")
def cal_version_list(spark, d):
    return C.version_list(versions(spark, d), 25)


def _long(view):
    return " UNION ALL ".join(
        f"SELECT rule_id, '{k}' AS knob, {e} AS v FROM {view}" for k, e in [
            ("enabled", "CAST(enabled AS VARCHAR)"), ("severity_shift", "CAST(severity_shift AS VARCHAR)"),
            ("severity_cap", "severity_cap"), ("severity_floor", "severity_floor"),
            ("scope_occupancy", "coalesce(scope_occ, '')"), ("scope_basis", "coalesce(scope_bas, '')"),
            ("drop_verified", "CAST(drop_verified AS VARCHAR)"), ("weight", "CAST(weight AS VARCHAR)")])


@query("cal_diff", with_views("a_profile", "a_profile2") + f""",
a AS ({_long('a_profile')}), b AS ({_long('a_profile2')}),
df AS (SELECT * FROM (VALUES ('enabled', 'true'), ('severity_shift', '0'), ('severity_cap', NULL), ('severity_floor', NULL),
       ('scope_occupancy', ''), ('scope_basis', ''), ('drop_verified', 'false'), ('weight', '1.0')) t(knob, dv)),
j AS (SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(a.knob, b.knob) AS knob,
             CASE WHEN a.rule_id IS NULL THEN df.dv ELSE a.v END AS before, CASE WHEN b.rule_id IS NULL THEN df.dv ELSE b.v END AS after
      FROM a FULL OUTER JOIN b ON a.rule_id = b.rule_id AND a.knob = b.knob JOIN df ON df.knob = coalesce(a.knob, b.knob))
SELECT * FROM j WHERE before IS DISTINCT FROM after""")
def cal_diff(spark, d):
    return C.diff_profiles(profile(spark, d), profile(spark, d, "a_profile2"), C.knobs(spark))


# ---- feedback ---------------------------------------------------------------------------------

def feedback(spark, d):
    f = adapter(spark, d, "a_feedback")
    pairs = F.array_compact(F.array(*[
        F.when(F.col(f"a_{k}").isNotNull(), F.struct(F.lit(k).alias("k"), F.col(f"a_{k}").alias("v")))
        for k in ("conclusion", "severity", "citation", "colour")]))
    return f.withColumn("answers", F.map_from_entries(pairs))


@query("fb_validate", with_views("a_feedback") + """
SELECT id, subject AS item, 'unknown subject' AS problem FROM a_feedback WHERE subject = 'nonsense'
UNION ALL SELECT id, 'colour', 'unknown aspect' FROM a_feedback WHERE subject = 'finding' AND a_colour IS NOT NULL
UNION ALL SELECT id, a_conclusion, 'unknown verdict' FROM a_feedback WHERE subject = 'finding' AND a_conclusion = 'bogus'""")
def fb_validate(spark, d):
    return FB.validate_feedback(feedback(spark, d), FB.taxonomy(spark))


@query("fb_geometry", """
WITH m AS (SELECT vec_id * 16 + g AS id, CASE label % 6 WHEN 0 THEN 'arrow' WHEN 1 THEN 'box' WHEN 2 THEN 'cloud' WHEN 3 THEN 'note'
                  WHEN 4 THEN 'freehand' ELSE 'text' END AS kind, round(embedding[4 * g + 1] * 10) AS x0, round(embedding[4 * g + 2] * 10) AS y0,
                  round(embedding[4 * g + 3] * 10) AS x1, round(embedding[4 * g + 4] * 10) AS y1, label % 3 AS n FROM (SELECT *, unnest(range(16)) AS g FROM embeddings))
SELECT id, kind, CASE WHEN kind IN ('arrow', 'freehand') THEN 'needs at least two points' ELSE 'marks a region with no area' END AS complaint
FROM m WHERE (kind IN ('arrow', 'freehand') AND n < 2) OR (kind IN ('box', 'cloud') AND (x0 = x1 OR y0 = y1))""")
def fb_geometry(spark, d):
    return FB.markup_complaints(markups(spark, d)).select("id", "kind", "complaint")


def markups(spark, d):
    e = table(spark, d, "embeddings").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(15))))  # four numbers a box
    kind = F.element_at(F.array(*map(F.lit, ("arrow", "box", "cloud", "note", "freehand", "text"))),
                        (F.col("label") % 6).cast("int") + 1)
    at = lambda i: F.round(F.element_at("embedding", 4 * F.col("g") + i).cast("double") * 10)
    return e.select((F.col("vec_id") * 16 + F.col("g")).alias("id"), F.col("label").cast("bigint").alias("set_id"), kind.alias("kind"),
                    at(1).alias("x0"), at(2).alias("y0"), at(3).alias("x1"), at(4).alias("y1"),
                    F.expr("slice(array(array(0D, 0D), array(1D, 1D)), 1, label % 3)").alias("points"),
                    (F.col("vec_id") % 9).alias("page"))


FLAGS = with_views("a_feedback", "a_profile") + """,
v(aspect, verdict, remedy, knob, delta) AS (VALUES ('conclusion', 'correct', 'g', NULL, NULL), ('conclusion', 'false_positive', 't', 'severity_shift', -1),
  ('conclusion', 'not_applicable', 't', 'scope_occupancy', NULL), ('conclusion', 'right_wrong_reason', 'j', NULL, NULL),
  ('conclusion', 'duplicate', 'c', NULL, NULL), ('severity', 'right', 'g', NULL, NULL), ('severity', 'overstated', 't', 'severity_shift', -1),
  ('severity', 'understated', 't', 'severity_shift', 1), ('severity', 'not_a_finding', 't', 'enabled', NULL),
  ('citation', 'right', 'g', NULL, NULL), ('citation', 'wrong_section', 'j', NULL, NULL)),
ans AS (SELECT id, rule_id, occupancy_group, 'conclusion' AS aspect, a_conclusion AS verdict FROM a_feedback UNION ALL
        SELECT id, rule_id, occupancy_group, 'severity', a_severity FROM a_feedback UNION ALL
        SELECT id, rule_id, occupancy_group, 'citation', a_citation FROM a_feedback),
x AS (SELECT ans.id, v.*, occupancy_group AS grp, p.rule_id AS has, p.severity_shift AS sh, p.scope_occ AS so, p.confirmations AS cf,
             coalesce(p.severity_shift, 0) + v.delta AS wish FROM ans JOIN v ON v.aspect = ans.aspect AND v.verdict = ans.verdict
             LEFT JOIN a_profile p ON p.rule_id = ans.rule_id),
per AS (SELECT id, bool_or(remedy <> 'g') AS defect, count(*) FILTER (WHERE remedy = 'g') AS praise, bool_or(remedy = 'j') AS judgement,
          bool_or(remedy = 'c') AS component, bool_or(remedy = 't' AND knob = 'severity_shift' AND abs(wish) > 2) AS oob,
          bool_or(remedy = 't' AND knob = 'scope_occupancy' AND grp = '') AS noocc,
          bool_or(remedy = 't' AND has IS NOT NULL AND cf >= 3) AS contested,
          bool_or(remedy = 't' AND has IS NOT NULL AND CASE WHEN knob = 'severity_shift' THEN sh <> 0 AND sh <> greatest(-2, least(2, wish))
                  WHEN knob = 'scope_occupancy' THEN grp <> '' AND so IS NOT NULL AND so <> grp ELSE FALSE END) AS recal
        FROM x GROUP BY id),
f AS (SELECT a.id, a.comment, coalesce(defect, FALSE) AS defect, coalesce(judgement, FALSE) AS judgement, coalesce(component, FALSE) AS component,
             coalesce(oob, FALSE) AS oob, coalesce(noocc, FALSE) AS noocc, coalesce(contested, FALSE) AS contested, coalesce(recal, FALSE) AS recal
      FROM a_feedback a LEFT JOIN per ON per.id = a.id),
routed AS (SELECT id, CASE WHEN trim(comment) <> '' OR judgement OR (defect AND NOT component AND (oob OR noocc OR contested OR recal)) THEN 'escalate'
             WHEN component THEN 'needs_component' WHEN defect THEN 'auto_tunable' ELSE 'confirmation' END AS disposition FROM f)
"""


@query("fb_triage", FLAGS + "SELECT id, disposition FROM routed")
def fb_triage(spark, d):
    return FB.triage(feedback(spark, d), FB.taxonomy(spark), profile(spark, d)).select("id", "disposition")


@query("fb_changes", FLAGS + """
SELECT x.id, x.knob, CASE WHEN x.knob = 'severity_shift' THEN CAST(greatest(-2, least(2, wish)) AS VARCHAR)
       WHEN x.knob = 'scope_occupancy' THEN CASE WHEN so IS NULL OR so = grp THEN grp ELSE least(so, grp) || '|' || greatest(so, grp) END
       ELSE 'false' END AS value
FROM x JOIN routed USING (id) WHERE disposition = 'auto_tunable' AND remedy = 't'""")
def fb_changes(spark, d):
    f, t, p = feedback(spark, d), FB.taxonomy(spark), profile(spark, d)
    return FB.proposed_changes(f, t, FB.triage(f, t, p), p).select("id", "knob", "value")


def queue_rows(spark, d):
    f = feedback(spark, d)
    return f.join(FB.triage(f, FB.taxonomy(spark), profile(spark, d)), "id")


@query("fb_queue", FLAGS + """
SELECT id, disposition, created_at FROM routed JOIN a_feedback USING (id) WHERE state = 'new'
ORDER BY created_at DESC, id LIMIT 100""")
def fb_queue(spark, d):
    return FB.feedback_queue(queue_rows(spark, d), state="new", limit=100).select("id", "disposition", "created_at")


@query("fb_own", FLAGS + """
SELECT set_id, uid, id, state, CAST(row_number() OVER (PARTITION BY set_id, uid ORDER BY created_at, id) AS INTEGER) AS n
FROM a_feedback WHERE set_id IS NOT NULL AND uid IS NOT NULL""")
def fb_own(spark, d):
    return FB.own_feedback(feedback(spark, d)).select("set_id", "uid", "id", "state", "n")


@query("fb_open_count", with_views("a_feedback") + "SELECT count(*) FILTER (WHERE state = 'new') AS n_open FROM a_feedback")
def fb_open_count(spark, d):
    return FB.open_count(feedback(spark, d))


@query("fb_digest", FLAGS + """,
q AS (SELECT disposition, id, created_at, row_number() OVER (PARTITION BY disposition ORDER BY created_at, id) AS n,
             count(*) OVER (PARTITION BY disposition) AS group_size FROM routed JOIN a_feedback USING (id) WHERE state = 'new')
SELECT disposition, group_size, CAST(n AS INTEGER) AS n, id FROM q WHERE n <= 20""")
def fb_digest(spark, d):
    return FB.digest(queue_rows(spark, d), 20).select("disposition", "group_size", "n", "id")


@query("fb_markup_export", """
WITH m AS (SELECT vec_id * 16 + g AS id, CAST(label AS BIGINT) AS set_id, round(embedding[4 * g + 1] * 10) AS x0, round(embedding[4 * g + 2] * 10) AS y0, vec_id % 9 AS page
           FROM (SELECT *, unnest(range(16)) AS g FROM embeddings))
SELECT set_id, id, page, row_number() OVER (PARTITION BY set_id ORDER BY page, y0, x0, id) AS ord FROM m""")
def fb_markup_export(spark, d):
    return FB.markup_order(markups(spark, d)).select("set_id", "id", "page", "ord")


@query("fb_markup_counts", """
SELECT CAST(label AS BIGINT) AS set_id, CASE label % 6 WHEN 0 THEN 'arrow' WHEN 1 THEN 'box' WHEN 2 THEN 'cloud' WHEN 3 THEN 'note'
       WHEN 4 THEN 'freehand' ELSE 'text' END AS kind, 16 * count(*) AS n FROM embeddings GROUP BY 1, 2""")
def fb_markup_counts(spark, d):
    return FB.markup_totals(markups(spark, d))


# ---- abstentions ------------------------------------------------------------------------------

def set_profile(spark, d):
    o = table(spark, d, "orders")
    p1 = F.substring("o_orderpriority", 1, 1)
    empty = F.array().cast("array<int>")
    return o.select(
        F.col("o_orderkey").alias("set_id"),
        F.when(p1.isin("1", "2"), F.array(F.lit(3), F.lit(1))).otherwise(empty).alias("region_pages"),
        F.when(p1 == "3", F.array(F.lit(5))).otherwise(empty).alias("raster_pages"),
        (F.col("o_orderstatus") == "P").alias("converted"), F.lit(0).alias("cad_layers"),
        (F.col("o_orderstatus") == "F").alias("measured_off"))


CLASSED = with_views("a_abstentions") + """,
k AS (SELECT a.*, o.o_orderpriority AS pr, o.o_orderstatus AS st, CASE page WHEN 1 THEN 'extraction' WHEN 2 THEN
        CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') AND o_orderstatus <> 'P' THEN 'extraction' ELSE 'absent' END
        WHEN 3 THEN 'corpus' WHEN 4 THEN 'geometry' WHEN 5 THEN 'error' WHEN 6 THEN 'extraction' ELSE 'not_applicable' END AS kind
      FROM a_abstentions a JOIN orders o ON o.o_orderkey = a.set_id)
"""


def classed(spark, d):
    return AB.classify(adapter(spark, d, "a_abstentions"), set_profile(spark, d))


@query("abs_classify", CLASSED + """
SELECT set_id, rule_id, page, kind, kind NOT IN ('absent', 'not_applicable') AS proposable FROM k""")
def abs_classify(spark, d):
    return classed(spark, d).select("set_id", "rule_id", "page", "kind", "proposable")


@query("abs_unlocks", with_views("a_abstentions") + """
SELECT rule_id, count(*) AS waiting FROM a_abstentions GROUP BY rule_id""")
def abs_unlocks(spark, d):
    """Abstentions per rule with the questions that would unlock it (none for brand rules)."""
    per = adapter(spark, d, "a_abstentions").groupBy("rule_id").agg(F.count(F.lit(1)).alias("waiting"))
    return per.join(AB.unlocked_by(questions(spark)), "rule_id", "left").select("rule_id", "waiting")


@query("abs_diagnose", CLASSED + """,
c AS (SELECT set_id, count(*) FILTER (WHERE kind = 'extraction') AS e, count(*) FILTER (WHERE kind = 'geometry') AS g,
             count(*) FILTER (WHERE kind = 'corpus') AS cg, count(*) FILTER (WHERE kind = 'error') AS er FROM k GROUP BY set_id),
o AS (SELECT o_orderkey AS set_id, substr(o_orderpriority, 1, 1) AS p1, o_orderstatus AS st, coalesce(e, 0) AS e, coalesce(g, 0) AS g,
             coalesce(cg, 0) AS cg, coalesce(er, 0) AS er FROM orders LEFT JOIN c ON c.set_id = o_orderkey)
SELECT set_id, 'pasted_code_table' AS cause, e AS n, '2,4' AS sheets FROM o WHERE p1 IN ('1', '2') AND st <> 'P' AND e >= 3
UNION ALL SELECT set_id, 'scanned_sheets', 1, '6' FROM o WHERE p1 = '3' AND st <> 'P'
UNION ALL SELECT set_id, 'no_layers', g, '' FROM o WHERE g > 0 AND st <> 'F'
UNION ALL SELECT set_id, 'corpus_gap', cg, '' FROM o WHERE cg > 0
UNION ALL SELECT set_id, 'rule_error', er, '' FROM o WHERE er > 0""")
def abs_diagnose(spark, d):
    out = AB.diagnose(classed(spark, d), set_profile(spark, d))
    return out.select("set_id", "cause", "n", F.array_join("sheets", ",").alias("sheets"))


@query("abs_prefill", with_views("a_abstentions") + """
SELECT set_id, page, CASE page WHEN 1 THEN 'data_on_sheet' WHEN 2 THEN CASE WHEN detail = 'R' THEN 'data_in_image' END
       WHEN 3 THEN 'corpus_missing' WHEN 4 THEN 'layer_named_differently' WHEN 5 THEN 'rule_failed' WHEN 6 THEN 'data_on_sheet' END AS verdict
FROM a_abstentions""")
def abs_prefill(spark, d):
    a = adapter(spark, d, "a_abstentions")
    return a.select("set_id", "page", AB.prefill_verdict(F.col("reason"), F.col("detail") == "R").alias("verdict"))
