"""Registered queries: each declared question beside what is drawn, and the rules fed by air, load, fixture and measure rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlens.operators import reconcile as R, rules as RU
from planlens.plans.adapters import VIEWS, adapter, with_views
from planlens.plans.q_rules import CODE, building_rows, outcome_of
from planlens.plans.registry import query, table
from planlens.sources.catalog import questions


def _one_of(*values: str) -> str:
    return "CASE pmod(k, " + str(len(values)) + ") " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: question -> (rule, finding on conflict, finding on agreement, what a value is made of, the SQL of severity on conflict)
HIGH, FIXED = "'HIGH'", "'MEDIUM'"
NEAR = "CASE WHEN abs(dn - wn) <= 2 * {tol} THEN 'LOW' ELSE 'MEDIUM' END"
ASKED = {
    "occupancy_group": ("DECL.OCCUPANCY", "X-OCC", "V-OCC", ("str", _one_of("A-3", "B", "M", "S-1")), HIGH, None),
    "mixed_occupancy": ("DECL.MIXED_OCCUPANCY", "X-MIX", "V-MIX", ("bool", "pmod(k, 2) = 0"), HIGH, None),
    "construction_type": ("DECL.CONSTRUCTION_TYPE", "X-CON", "V-CON", ("str", _one_of("II-B", "III-B", "V-A", "V-B")), HIGH, None),
    "height_ft": ("DECL.HEIGHT", "X-HGT", "V-HGT", ("num", "20 + pmod(k, 97) / 4.0"), NEAR.format(tol="0.5"), 0.5),
    "sprinkler_system": ("DECL.SPRINKLER", "X-SPR", "V-SPR", ("str", _one_of("none", "nfpa13", "nfpa13r", "nfpa13d")), HIGH, None),
    "wind_speed_mph": ("DECL.WIND_SPEED", "X-WND", "V-WND", ("num", "110 + pmod(k, 97)"), NEAR.format(tol="1.0"), 1.0),
    "exposure_category": ("DECL.EXPOSURE", "X-EXP", "V-EXP", ("str", _one_of("B", "C", "D")), FIXED, None),
    "risk_category": ("DECL.RISK_CATEGORY", "X-RSK", "V-RSK", ("str", _one_of("I", "II", "III", "IV")), HIGH, None),
    "code_edition": ("DECL.CODE_EDITION", "X-EDN", "V-EDN", ("str", _one_of("fbc2020", "fbc2023", "fbc2026")), HIGH, None),
}


def _long(source: str, extra: str) -> str:
    """One row per question and set; the set's number k makes the value."""
    parts = []
    for i, (field, (_, _, _, (kind, value), _, _)) in enumerate(ASKED.items()):
        cast = {"num": "DOUBLE", "str": "STRING", "bool": "BOOLEAN"}
        cols = ", ".join(f"CAST({value if kind == k else 'NULL'} AS {t}) AS value_{k}" for k, t in cast.items())
        parts.append(f"SELECT set_id, '{field}' AS field, {cols}{extra} FROM ({source}) WHERE (set_id + {i}) % 7 <> {{skip}}")
    return " UNION ALL ".join(parts).replace("pmod(k,", "(k %").replace("{skip}", "3" if extra else "5")


# the SQL scans a table once per question; the queries take the same rows in one pass (``asked_rows``)
VIEWS["a_answers"] = _long("SELECT o_orderkey AS set_id, o_custkey AS k FROM {orders}", "")
VIEWS["a_stated"] = _long("""SELECT set_id, CASE WHEN s % 3 = 0 THEN o_custkey ELSE o_custkey + s % 5 END AS k, page
    FROM (SELECT l_orderkey AS set_id, sum(l_linenumber + l_suppkey) AS s, min(l_linenumber) AS page FROM {lineitem} GROUP BY l_orderkey)
    JOIN {orders} ON o_orderkey = set_id""", ", page")

BESIDE = with_views("a_answers", "a_stated") + """,
rec AS (SELECT coalesce(a.set_id, w.set_id) AS set_id, coalesce(a.field, w.field) AS field, a.value_num AS dn, w.value_num AS wn,
  CASE WHEN w.set_id IS NULL THEN 'DECLARED_ONLY' WHEN a.set_id IS NULL THEN 'DRAWN_ONLY'
       WHEN a.value_num IS NOT NULL THEN CASE WHEN abs(a.value_num - w.value_num) <= CASE a.field WHEN 'height_ft' THEN 0.5 ELSE 1.0 END THEN 'CORROBORATED' ELSE 'CONFLICT' END
       WHEN coalesce(a.value_str, a.value_bool::VARCHAR) = coalesce(w.value_str, w.value_bool::VARCHAR) THEN 'CORROBORATED' ELSE 'CONFLICT' END AS state
  FROM a_answers a FULL OUTER JOIN a_stated w ON a.set_id = w.set_id AND a.field = w.field),
two AS (SELECT DISTINCT set_id FROM rec WHERE state = 'CONFLICT'),
sc AS (SELECT o_orderkey AS set_id, s.scenario FROM orders LEFT JOIN two ON two.set_id = o_orderkey JOIN (VALUES ('as_drawn'), ('as_declared')) s(scenario)
       ON s.scenario = 'as_drawn' OR two.set_id IS NOT NULL)
"""


def asked_rows(sets, skip: int, *extra: str):
    """The rows of ``a_answers`` and ``a_stated`` in one pass over ``sets`` (set_id, k): a set's questions leave it side by side."""
    def entry(i, field, kind, value):
        row = F.struct(F.lit(field).alias("field"), *[F.expr(f"CAST({value if kind == k else 'NULL'} AS {t})").alias(f"value_{k}")
                                                      for k, t in (("num", "DOUBLE"), ("str", "STRING"), ("bool", "BOOLEAN"))])
        return F.when((F.col("set_id") + i) % 7 != skip, row)
    rows = F.array_compact(F.array(*[entry(i, field, *made) for i, (field, (_, _, _, made, _, _)) in enumerate(ASKED.items())]))
    return sets.select("set_id", *extra, F.inline(rows))


def answers(spark, d):
    return asked_rows(table(spark, d, "orders").select(F.col("o_orderkey").alias("set_id"), F.col("o_custkey").alias("k")), 5)


def stated(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("set_id")).agg(
        F.sum(F.col("l_linenumber") + F.col("l_suppkey")).alias("s"), F.min("l_linenumber").alias("page"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("set_id"), "o_custkey")
    k = F.when(F.col("s") % 3 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + F.col("s") % 5)
    return asked_rows(s.join(o, "set_id").select("set_id", k.alias("k"), "page"), 3, "page")


def both_sides(spark, d, fields=None) -> RU.Inputs:
    """Every set's answers beside what its drawings state, conflicts and second readings included."""
    w = stated(spark, d).withColumn("source", F.lit("S-1")).withColumn("note", F.lit(""))
    sets = table(spark, d, "orders").select(F.col("o_orderkey").alias("set_id"))
    return RU.Inputs(R.scenarios(R.reconcile(answers(spark, d), w, questions(spark), sets=sets, fields=fields), keep_silent=True))


def beside(rule: str):
    asked = [f for f, v in RU.DECLARED_RULES.items() if v[0] == rule]

    def run(spark, d):
        return RU.run_rules(both_sides(spark, d, asked), spark, [rule]).select("set_id", "scenario", "fid", "severity", "reason")
    return run


for _field, (_rule, _bad, _good, _, _severity, _) in ASKED.items():
    query("rule_" + _rule.lower().replace(".", "_"), BESIDE + f"""
SELECT sc.set_id, scenario, CASE state WHEN 'CONFLICT' THEN '{_bad}' WHEN 'CORROBORATED' THEN '{_good}' END AS fid,
  CASE state WHEN 'CONFLICT' THEN {_severity} WHEN 'CORROBORATED' THEN 'VERIFIED' END AS severity,
  CASE coalesce(state, '') WHEN 'DECLARED_ONLY' THEN 'answered, but there is nothing to compare: the drawings do not state it'
    WHEN 'DRAWN_ONLY' THEN 'stated, but there is nothing to compare: the declaration left it blank'
    WHEN '' THEN 'neither the drawings nor the declaration state this' END AS reason
FROM sc LEFT JOIN rec ON rec.set_id = sc.set_id AND rec.field = '{_field}'""")(beside(_rule))


# ---- air, panels, areas, fixtures, measures --------------------------------------------------------

ROWS = CODE + """,
li AS (SELECT l_orderkey AS set_id, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS oa, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS amps,
  count(*) FILTER (WHERE l_returnflag = 'N') AS v, count(*) AS n, sum(l_quantity) AS qty, sum(l_linenumber) AS lines, min(l_discount) AS disc FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS set_id, CASE WHEN o_custkey % 4 <> 1 THEN floor(o_totalprice / 2000) END AS cfm, CASE WHEN o_custkey % 5 <> 1 THEN 40.0 END AS rating,
  CASE WHEN o_custkey % 6 <> 1 THEN floor(o_totalprice / 1000) END AS stated, CASE WHEN o_custkey % 7 <> 1 THEN floor(o_totalprice / 1000) + o_custkey % 3 END AS tabulated FROM orders)
"""


def ruled(arms: str) -> str:
    return ROWS + f"""SELECT set_id, 'as_drawn' AS scenario, CASE WHEN r LIKE '!%' THEN substr(r, 2) END AS fid, CASE WHEN r NOT LIKE '!%' THEN r END AS reason
FROM (SELECT bld.set_id, CASE {arms} END AS r FROM bld JOIN o ON o.set_id = bld.set_id LEFT JOIN li ON li.set_id = bld.set_id
      LEFT JOIN first_ f ON f.set_id = bld.set_id AND f.section = '1017.2')"""


def row_tables(spark, d) -> RU.Inputs:
    """Order lines as schedule, ventilation, fixture and measure rows; the order's own numbers as block values."""
    wide, rows = building_rows(spark, d)
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    per = li.groupBy(F.col("l_orderkey").alias("set_id"), "l_returnflag").agg(F.sum("l_quantity").alias("v"), F.min("l_linenumber").alias("page"), F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("l_returnflag") == "R", "ROOF TOP UNIT SCHEDULE").when(F.col("l_returnflag") == "A", "ELECTRICAL LOAD CALCULATIONS").otherwise("OCCUPANT DENSITY")
    shown = F.format_string("%.1f", "v")
    schedules = per.select("set_id", name.alias("schedule"), "page", F.lit(1).alias("row_no"), F.when(F.col("l_returnflag") == "A", "TOTAL AMPERAGE").otherwise("X").alias("mark"),
                           F.create_map(F.lit("OUTSIDE AIR CFM"), shown).alias("cells"), F.array(F.lit("X"), shown).alias("vals"))
    # rooms: one person per thousand square feet and unit of density, five CFM each; the total is off in some sets
    rooms = li.where("l_returnflag = 'N'").select(
        F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("page"), F.lit("ROOM").alias("room"), F.lit(1000.0).alias("area_sf"), F.col("l_quantity").alias("density"),
        F.lit(5.0).alias("rp"), F.lit(0.0).alias("ra"), F.col("l_quantity").alias("persons"), (5 * F.col("l_quantity") + F.when(F.col("l_discount") > 0.05, 3).otherwise(0)).alias("total_cfm"),
        F.lit(False).alias("is_total"))
    cust = F.col("o_custkey")
    k = lambda n, v: F.when(cust % n != 1, v)
    attrs = wide.select("set_id", "occupant_load").join(o.select(
        F.col("o_orderkey").alias("set_id"), k(4, F.floor(F.col("o_totalprice") / 2000)).cast("double").alias("oa_required_cfm"), k(5, F.lit(40.0)).alias("panel_rating_a"),
        k(6, F.floor(F.col("o_totalprice") / 1000)).cast("double").alias("area_stated"), k(7, F.floor(F.col("o_totalprice") / 1000) + cust % 3).cast("double").alias("area_tabulated"),
        (cust % 2 == 0).alias("has_general_sheets"), (cust % 11 != 0).alias("include_measured")), "set_id")
    whole = li.groupBy(F.col("l_orderkey").alias("set_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.sum("l_linenumber").alias("lines"))
    runs = whole.select("set_id", F.lit(1).alias("g_page"), F.lit("A-1").alias("g_sheet"), (F.col("n") - 1).alias("g_segments"), (18 * F.col("qty")).alias("g_run_pt"),
                        F.when(F.col("lines") % 3 != 0, 18.0).alias("g_scale"), F.lit("spans several views").alias("g_why"))
    row = lambda part, kind, male, female=None: F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), F.lit(male).cast("double").alias("male"), F.lit(female).cast("double").alias("female"))
    ratio = [row("ratio", "wc", 125, 65), row("ratio", "lav", 200, 200), row("ratio", "drinking_fountain", 500, None)]
    counts = [row("load", "load", F.col("qty")), row("required", "wc", F.col("n")), row("provided", "wc", F.col("lines")), row("provided", "lav", F.col("lines")),
              row("provided", "drinking_fountain", F.lit(1)), row("provided", "service_sink", F.lit(1))]
    fixtures = whole.where("lines % 4 <> 0").select("set_id", F.lit(1).alias("page"), F.explode(F.array(*ratio, *counts)).alias("x")).select("set_id", "page", "x.*")
    return RU.Inputs(rows, attrs=attrs, schedules=schedules, ventilation=rooms, fixtures=fixtures, egress_runs=runs, code_data=adapter(spark, d, "a_code"))


query("rule_mech_outdoor_air_capacity", ruled("""WHEN cfm IS NULL THEN 'outdoor-air total not extracted' WHEN oa IS NULL THEN 'no rooftop unit schedule found'
  WHEN cfm - oa > 1 THEN '!C-01' ELSE '!V-OA'"""))(outcome_of("MECH.OUTDOOR_AIR_CAPACITY", row_tables))
query("rule_mech_outdoor_air_arithmetic", ruled("""WHEN coalesce(v, 0) = 0 THEN 'outdoor-air calculation rows not extracted'
  WHEN EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = bld.set_id AND x.l_returnflag = 'N' AND x.l_discount > 0.05)
    OR abs(cfm - (SELECT sum(5 * l_quantity) FROM lineitem x WHERE x.l_orderkey = bld.set_id AND x.l_returnflag = 'N')) > greatest(1.0, 0.5 * v) THEN '!M-OA' ELSE '!V-35'"""))(
    outcome_of("MECH.OUTDOOR_AIR_ARITHMETIC", row_tables))
query("rule_elec_panel_loading", ruled("""WHEN amps IS NULL THEN 'no load calculation table found' WHEN rating IS NULL THEN 'total amperage or panel rating not extracted'
  WHEN amps > rating THEN '!C-PL' ELSE '!V-30'"""))(outcome_of("ELEC.PANEL_LOADING", row_tables))
query("rule_xsheet_building_area", ruled("""WHEN coalesce(stated, building_area_sf) IS NULL OR tabulated IS NULL THEN CASE WHEN (SELECT o_custkey FROM orders WHERE o_orderkey = bld.set_id) % 2 = 0
     THEN 'building area not found on both general sheets'
     ELSE 'this submittal carries no general sheets, so neither area was read from one; declare the building area to have this checked' END
  WHEN abs(coalesce(stated, building_area_sf) - tabulated) > 1 THEN '!M-04' ELSE '!V-AR'"""))(outcome_of("XSHEET.BUILDING_AREA", row_tables))
NEED = "(ceil(qty / 2 / 125) + ceil(qty / 2 / 65))"
query("rule_plumb_fixture_count", ruled(f"""WHEN n IS NULL OR lines % 4 = 0 THEN 'plumbing fixture calculation not extracted' WHEN g <> 'A-3' THEN 'Table 2902.1 row not carried in this build''s corpus'
  WHEN lines < {NEED} OR lines < 2 * ceil(qty / 2 / 200) OR 1 < ceil(qty / 500) THEN '!P-01' WHEN n <> {NEED} THEN '!P-02' ELSE '!V-06'"""))(
    outcome_of("PLUMB.FIXTURE_COUNT", row_tables))
query("rule_measure_egress_extent", ruled("""WHEN (SELECT o_custkey FROM orders WHERE o_orderkey = bld.set_id) % 11 = 0 THEN 'geometric measurement was switched off in the review options'
  WHEN n IS NULL THEN 'no CAD layer matching ''egress path''' WHEN n = 1 THEN 'egress layer present but carries no line geometry' WHEN lines % 3 = 0 THEN 'scale unresolved'
  ELSE '!MEAS-1'"""))(outcome_of("MEASURE.EGRESS_EXTENT", row_tables))
