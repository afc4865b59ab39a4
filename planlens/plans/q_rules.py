"""Registered queries: the rules over every order as a declared building."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlens.operators import reconcile as R, rules as RU
from planlens.plans.adapters import adapter, lines, with_views
from planlens.plans.q_facts import _STATES, claims, declared, drawn
from planlens.plans.registry import query, table
from planlens.operators import facts as FX
from planlens.sources.catalog import questions


def building_rows(spark, d):
    """The scenario rows of every declared building; the drawings state nothing but totals."""
    wide = adapter(spark, d, "a_building")
    long = R.long_declarations(wide)
    w = drawn(spark, d).where("1 = 0").withColumn("source", F.lit("")).withColumn("note", F.lit(""))
    rec = R.reconcile(long, w, questions(spark), sets=wide.select("set_id"))
    return wide, R.scenarios(rec, keep_silent=True)


def code_inputs(spark, d):
    wide, rows = building_rows(spark, d)
    return RU.Inputs(rows, attrs=wide.select("set_id", "occupant_load", "as_of"), code_data=adapter(spark, d, "a_code"))


def outcome_of(rule_id, inputs=code_inputs):
    def run(spark, d):
        return RU.run_rules(inputs(spark, d), spark, [rule_id]).select("set_id", "scenario", "fid", "reason")
    return run


CODE = with_views("a_building", "a_code") + """,
first_ AS (SELECT set_id, section, arg_min(CAST(required AS DOUBLE), ord) AS req, arg_min(CAST(provided AS DOUBLE), ord) AS prov FROM a_code GROUP BY set_id, section),
bld AS (SELECT *, occupancy_group AS g, construction_type AS t, sprinkler_system <> 'none' AS sprk, sprinkler_system = 'nfpa13' AS cred,
          substr(occupancy_group, 1, 1) AS letter FROM a_building)
"""
ABSENT = RU.ABSENT


def egress(section, arms):
    return CODE + f"""SELECT b.set_id, 'as_drawn' AS scenario, CASE WHEN r LIKE '!%' THEN substr(r, 2) END AS fid,
      CASE WHEN r NOT LIKE '!%' THEN r END AS reason FROM (SELECT bld.set_id, CASE {arms} END AS r FROM bld LEFT JOIN first_ f
      ON f.set_id = bld.set_id AND f.section = '{section}') b"""


PATH = "CASE WHEN letter = 'B' AND sprk THEN 100 WHEN letter IN ('A', 'B', 'M', 'E') THEN 75 END"
TRAVEL = "CASE WHEN letter IN ('A', 'M') THEN CASE WHEN sprk THEN 250 ELSE 200 END WHEN letter = 'B' THEN CASE WHEN sprk THEN 300 ELSE 200 END END"

query("rule_egress_common_path", egress("1006.2.1", f"""
  WHEN req IS NULL THEN 'no code datum citing 1006.2.1 with a parseable required value' WHEN g IS NULL THEN '{ABSENT}'
  WHEN {PATH} IS NULL THEN 'Table 1006.2.1 row not carried in this build''s corpus' WHEN abs(req - {PATH}) > 0.5 THEN '!H-02' ELSE '!V-CP'"""))(
    outcome_of("EGRESS.COMMON_PATH"))
query("rule_egress_travel_distance", egress("1017.2", f"""
  WHEN req IS NULL THEN 'no parseable 1017.2 datum' WHEN g IS NULL THEN '{ABSENT}' WHEN {TRAVEL} IS NULL THEN 'Table 1017.2 row not carried in this build''s corpus'
  WHEN abs(req - {TRAVEL}) > 0.5 THEN '!H-TD' ELSE '!V-01'"""))(outcome_of("EGRESS.TRAVEL_DISTANCE"))
query("rule_egress_dead_end", egress("1020.5", f"""
  WHEN req IS NULL THEN 'no parseable 1020.5 datum' WHEN g IS NULL THEN '{ABSENT}'
  WHEN abs(req - CASE WHEN sprk AND letter IN ('B', 'M', 'S') THEN 50 ELSE 20 END) > 0.5 THEN '!M-DE' ELSE '!V-02'"""))(outcome_of("EGRESS.DEAD_END"))
query("rule_egress_corridor_width", egress("1020.3", f"""
  WHEN req IS NULL THEN 'no parseable 1020.3 datum' WHEN g IS NULL THEN '{ABSENT}' WHEN abs(req - 44) > 0.5 THEN '!M-CW' ELSE '!V-03'"""))(
    outcome_of("EGRESS.CORRIDOR_WIDTH"))
query("rule_egress_capacity_factor", egress("1005.3.2", """
  WHEN req IS NULL THEN 'no parseable 1005.3.2 datum' WHEN coalesce(occupant_load, 0) = 0 THEN 'occupant load not extracted'
  WHEN req / occupant_load < 0.2::DOUBLE - 0.005 THEN '!M-01' ELSE '!V-CF'"""))(outcome_of("EGRESS.CAPACITY_FACTOR"))
LOAD = "coalesce(nullif(occupant_load, 0), ceil(nullif(building_area_sf, 0) / CASE g WHEN 'B' THEN 150 WHEN 'M' THEN 60 WHEN 'S-1' THEN 300 END))"
query("rule_egress_exit_count", egress("1006.3.2", f"""
  WHEN {LOAD} IS NULL THEN 'occupant load not extracted' WHEN prov IS NULL THEN 'exit count row not found in a code data block'
  WHEN prov < CASE WHEN {LOAD} <= 500 THEN 2 WHEN {LOAD} <= 1000 THEN 3 ELSE 4 END THEN '!C-EX' ELSE '!V-04'"""))(outcome_of("EGRESS.EXIT_COUNT"))
query("rule_doors_clear_width_requirement", egress("1010.1.1", """
  WHEN req IS NULL THEN 'stated door clear-width requirement not extracted' WHEN req + 0.01 < 32 THEN '!H-DR' ELSE '!V-05'"""))(
    outcome_of("DOORS.CLEAR_WIDTH_REQUIREMENT"))


def plain(arms):
    return CODE + f"""SELECT set_id, 'as_drawn' AS scenario, CASE WHEN r LIKE '!%' THEN substr(r, 2) END AS fid, CASE WHEN r NOT LIKE '!%' THEN r END AS reason
      FROM (SELECT set_id, CASE {arms} END AS r FROM bld)"""


H = ("CASE t WHEN 'I-A' THEN 1e18 WHEN 'I-B' THEN 160 WHEN 'II-A' THEN 65 WHEN 'II-B' THEN 55 WHEN 'III-A' THEN 65 WHEN 'III-B' THEN 55 WHEN 'IV' THEN 65 "
     "WHEN 'V-A' THEN 50 ELSE 40 END + CASE WHEN cred THEN 20 ELSE 0 END")
query("rule_height_area_table_504_height", plain(f"""
  WHEN g IS NULL THEN '{ABSENT}' WHEN height_ft > {H} THEN '!H-504H' ELSE '!V-504H'"""))(outcome_of("HEIGHT_AREA.TABLE_504_HEIGHT"))
ST = """list_value(CASE g WHEN 'B' THEN [1000000, 11, 5, 3, 5, 3, 5, 3, 2] WHEN 'A-3' THEN [1000000, 11, 3, 2, 3, 2, 3, 2, 1]
  WHEN 'M' THEN [1000000, 11, 4, 2, 4, 2, 4, 3, 1] ELSE [1000000, 11, 4, 2, 3, 2, 4, 3, 1] END)[1][
  list_position(['I-A', 'I-B', 'II-A', 'II-B', 'III-A', 'III-B', 'IV', 'V-A', 'V-B'], t)] + CASE WHEN cred THEN 1 ELSE 0 END"""
query("rule_height_area_table_504_stories", plain(f"""
  WHEN g IS NULL THEN '{ABSENT}' WHEN stories > {ST} THEN '!H-504S' ELSE '!V-504S'"""))(outcome_of("HEIGHT_AREA.TABLE_504_STORIES"))
AR = """list_value(CASE g WHEN 'B' THEN [1e15, 1e15, 37500, 23000, 28500, 19000, 36000, 18000, 9000] WHEN 'A-3' THEN [1e15, 1e15, 15500, 9500, 14000, 9500, 15000, 11500, 6000]
  WHEN 'M' THEN [1e15, 1e15, 21500, 12500, 18500, 12500, 20500, 14000, 9000] ELSE [1e15, 48000, 26000, 17500, 26000, 17500, 25500, 14000, 9000] END)[1][
  list_position(['I-A', 'I-B', 'II-A', 'II-B', 'III-A', 'III-B', 'IV', 'V-A', 'V-B'], t)] * CASE WHEN NOT cred THEN 1 WHEN stories <= 1 THEN 4 ELSE 3 END"""
query("rule_height_area_table_506_area", plain(f"""
  WHEN g IS NULL THEN '{ABSENT}' WHEN building_area_sf > {AR} THEN '!H-506' ELSE '!V-506'"""))(outcome_of("HEIGHT_AREA.TABLE_506_AREA"))
query("rule_fire_table_601", plain("""WHEN 1 = 1 THEN '!V-601'"""))(outcome_of("FIRE.TABLE_601"))
query("rule_egress_occupant_load_computed", plain(f"""
  WHEN g IS NULL THEN '{ABSENT}' WHEN g = 'A-3' THEN 'Table 1004.5 has no single gross factor for this group'
  WHEN coalesce(nullif(building_area_sf, 0), -1) = -1 THEN 'no area to apply the factor to'
  WHEN abs(nullif(occupant_load, 0) - ceil(building_area_sf / CASE g WHEN 'B' THEN 150 WHEN 'M' THEN 60 ELSE 300 END))
     > greatest(1, 0.02::DOUBLE * ceil(building_area_sf / CASE g WHEN 'B' THEN 150 WHEN 'M' THEN 60 ELSE 300 END)) THEN '!H-OL' ELSE '!V-OL'"""))(
    outcome_of("EGRESS.OCCUPANT_LOAD_COMPUTED"))
query("rule_xsheet_risk_category", plain(f"""
  WHEN risk_category IS NULL OR {LOAD} IS NULL THEN 'risk category or occupant load not extracted'
  WHEN risk_category = 'III' AND {LOAD} <= 300 THEN '!M-03' ELSE '!V-RC'"""))(outcome_of("XSHEET.RISK_CATEGORY"))
IN_FORCE = """CASE WHEN as_of >= DATE '2026-12-31' THEN 2026 WHEN as_of >= DATE '2023-12-31' THEN 2023 WHEN as_of >= DATE '2020-12-31' THEN 2020
  WHEN as_of >= DATE '2017-12-31' THEN 2017 ELSE 0 END"""
CITED = "CAST(substr(code_edition, 4) AS INTEGER)"
query("rule_code_edition_current", plain(f"""
  WHEN code_edition IS NULL THEN '{ABSENT}' WHEN {IN_FORCE} > {CITED} THEN '!C-ED' ELSE '!V-ED'"""))(outcome_of("CODE.EDITION_CURRENT"))
query("rule_struct_wind_standard", plain(f"""
  WHEN code_edition IS NULL THEN '{ABSENT}' WHEN code_edition IN ('fbc2017', 'fbc2026') THEN 'no ASCE 7 edition is recorded for this code edition'
  WHEN {IN_FORCE} > {CITED} AND {IN_FORCE} = 2026 THEN 'the edition in force has no ASCE 7 adoption recorded'
  WHEN {IN_FORCE} > {CITED} THEN '!H-WIND' ELSE '!V-WIND'"""))(outcome_of("STRUCT.WIND_STANDARD"))


# ---- declared against drawn -----------------------------------------------------------------------

def compared(spark, d, fields=None):
    w = drawn(spark, d).withColumn("source", F.lit("S-1")).withColumn("note", F.lit(""))
    sets = adapter(spark, d, "a_declared").select("set_id")
    rec = R.reconcile(declared(spark, d), w, questions(spark), sets=sets, fields=fields)
    return RU.Inputs(R.scenarios(rec, keep_silent=True))


def decl(field, rule_fids, severity, silent="FALSE"):
    bad, good = rule_fids
    return _STATES + f""",
two AS (SELECT DISTINCT set_id FROM rec WHERE state = 'CONFLICT' AND field <> 'zoning'),
sc AS (SELECT r.*, s.scenario FROM rec r LEFT JOIN two ON two.set_id = r.set_id JOIN (VALUES ('as_drawn'), ('as_declared')) s(scenario)
       ON s.scenario = 'as_drawn' OR two.set_id IS NOT NULL WHERE r.field = '{field}')
SELECT set_id, scenario, CASE state WHEN 'CONFLICT' THEN '{bad}' WHEN 'CORROBORATED' THEN '{good}' END AS fid,
       CASE state WHEN 'CONFLICT' THEN {severity} WHEN 'CORROBORATED' THEN 'VERIFIED' END AS severity FROM sc"""


def decl_outcome(rule_id):
    asked = [f for f, v in RU.DECLARED_RULES.items() if v[0] == rule_id]

    def run(spark, d):
        return RU.run_rules(compared(spark, d, asked), spark, [rule_id]).select("set_id", "scenario", "fid", "severity")
    return run


query("rule_decl_stories", decl("stories", ("X-STY", "V-STY"), "'MEDIUM'"))(decl_outcome("DECL.STORIES"))
query("rule_decl_building_area", decl("total_area_sf", ("X-ART", "V-ART"),
      "CASE WHEN abs(dn - wn) <= 2 * greatest(50.0, 0.02 * greatest(abs(dn), abs(wn))) THEN 'LOW' ELSE 'MEDIUM' END"))(decl_outcome("DECL.BUILDING_AREA"))


# ---- rules that report per row ----------------------------------------------------------------------

def door_inputs(spark, d):
    _, rows = building_rows(spark, d)
    li = table(spark, d, "lineitem")
    doors = li.select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").cast("string").alias("number"),
                      F.when(F.col("l_returnflag") == "R", "B").otherwise("F").alias("style"), (24 + F.floor(F.col("l_quantity") / 3)).cast("double").alias("width_in"),
                      F.lit(84.0).alias("height_in"), F.lit(None).cast("double").alias("thickness_in"), F.lit("").alias("remarks"),
                      (F.col("l_linestatus") == "F").alias("is_existing"))
    return RU.Inputs(rows, doors=doors)


@query("rule_doors_clear_width", """
WITH d AS (SELECT l_orderkey AS set_id, l_returnflag AS rf, 24 + floor(l_quantity / 3) - 1.875 < 32 AS bad FROM lineitem WHERE l_linestatus <> 'F'),
s AS (SELECT DISTINCT l_orderkey AS set_id FROM lineitem), n AS (SELECT set_id, count(*) FILTER (WHERE bad) AS b, count(*) FILTER (WHERE NOT bad) AS ok FROM d GROUP BY set_id)
SELECT set_id, CASE WHEN rf = 'R' THEN 'M-03b' ELSE 'H-03' END AS fid, CAST(NULL AS VARCHAR) AS reason, count(*) AS n FROM d WHERE bad GROUP BY ALL
UNION ALL SELECT set_id, 'V-DW', NULL, 1 FROM n WHERE ok > 0
UNION ALL SELECT s.set_id, NULL, 'new door widths not extracted', 1 FROM s LEFT JOIN n ON n.set_id = s.set_id WHERE n.set_id IS NULL
UNION ALL SELECT o_orderkey, NULL, 'no door schedule extracted', 1 FROM orders WHERE o_orderkey NOT IN (SELECT set_id FROM s)""")
def rule_doors_clear_width(spark, d):
    out = RU.run_rules(door_inputs(spark, d), spark, ["DOORS.CLEAR_WIDTH"])
    return out.groupBy("set_id", "fid", "reason").agg(F.count(F.lit(1)).alias("n"))


def conflict_inputs(spark, d):
    _, rows = building_rows(spark, d)
    return RU.Inputs(rows, resolved=FX.resolved_facts(claims(spark, d)))


@query("rule_xsheet_stated_conflict")
def rule_xsheet_stated_conflict(spark, d):
    out = RU.run_rules(conflict_inputs(spark, d), spark, ["XSHEET.STATED_CONFLICT"])
    return out.select("set_id", "scenario", "fid", "page", "sheet", "reason")


def space_inputs(spark, d):
    _, rows = building_rows(spark, d)
    li = table(spark, d, "lineitem")
    n = (F.col("l_suppkey") % 5).cast("int")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), n + 1)
    sp = li.select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("page"), F.xxhash64(*li.columns).alias("ord"),
                   F.concat(F.lit("ROOM "), F.col("l_linenumber").cast("string")).alias("space"), pick("BUSINESS", "STORAGE", "LOUNGE", "RETAIL", "OFFICE").alias("use"),
                   F.col("l_quantity").alias("area_sf"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(pick(150.0, 300.0, 15.0, 60.0, 100.0)).alias("factor"),
                   F.lit("").alias("basis"), F.lit(1.0).alias("load"), F.when(F.col("l_linestatus") == "F", "FBC").otherwise("").alias("code"),
                   F.array().cast("array<string>").alias("context"))
    return RU.Inputs(rows, spaces=sp)


@query("rule_occ_classification_consistency", """
WITH x AS (SELECT l_orderkey AS set_id, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'zero' ELSE 'none' END
   WHEN l_suppkey % 5 = 2 THEN 'unnamed' WHEN l_suppkey % 5 = 4 THEN 'wrong' ELSE 'match' END AS kind FROM lineitem),
a AS (SELECT o_orderkey AS set_id, count(x.kind) AS n, count(*) FILTER (WHERE kind = 'match') AS m, count(*) FILTER (WHERE kind IN ('zero', 'wrong')) AS b,
   count(*) FILTER (WHERE kind = 'unnamed') AS u FROM orders LEFT JOIN x ON x.set_id = o_orderkey GROUP BY o_orderkey)
SELECT set_id, CASE kind WHEN 'zero' THEN 'L' ELSE 'H' END AS grp, CAST(NULL AS VARCHAR) AS reason, count(*) AS n FROM x WHERE kind IN ('zero', 'wrong') GROUP BY ALL
UNION ALL SELECT set_id, 'V', NULL, 1 FROM a WHERE m > 0
UNION ALL SELECT set_id, NULL, 'occupant-load table not extracted', 1 FROM a WHERE n = 0
UNION ALL SELECT set_id, NULL, CASE WHEN u > 0 THEN 'the set does not name a Table 1004.5 function for its tabulated spaces' ELSE 'occupant load factors not extracted' END, 1
  FROM a WHERE n > 0 AND m = 0 AND b = 0""")
def rule_occ_classification_consistency(spark, d):
    out = RU.run_rules(space_inputs(spark, d), spark, ["OCC.CLASSIFICATION_CONSISTENCY"])
    return out.groupBy("set_id", F.substring("fid", 1, 1).alias("grp"), "reason").agg(F.count(F.lit(1)).alias("n"))


# ---- the whole corpus ---------------------------------------------------------------------------------

def every_input(spark, d):
    i = code_inputs(spark, d)
    li = table(spark, d, "lineitem")
    page = F.col("l_linenumber")
    i.doors, i.spaces = door_inputs(spark, d).doors, space_inputs(spark, d).spaces
    i.resolved = FX.resolved_facts(claims(spark, d))
    i.sheets = li.select(F.col("l_orderkey").alias("set_id"), page.alias("page"), F.when(F.col("l_suppkey") % 3 == 0, F.concat(
        F.lit("p"), (page + 1).cast("string"))).otherwise("A-101").alias("code"), F.when(F.col("l_returnflag") == "A", "REFLECTED CEILING PLAN").otherwise("PLAN").alias("title"))
    i.text = li.select(F.col("l_orderkey").alias("set_id"), page.alias("page"), F.when(F.col("l_returnflag") == "R", "provide occupant load sign at the main exit").otherwise(
        "structure is non-rated; see notes and details").alias("text"))
    i.ceilings = li.select(F.col("l_orderkey").alias("set_id"), page.alias("page"), F.lit("A-101").alias("code"), (6 + F.col("l_quantity") / 10).alias("height_ft"), F.lit("tag").alias("raw"))
    i.exits = li.select(F.col("l_orderkey").alias("set_id"), page.alias("page"), F.lit("EXIT 1").alias("exit"), F.lit(72.0).alias("width_provided_in"), (F.col("l_quantity") * 12).alias("capacity"))
    return i


@query("run_rules", with_views("a_building") + """,
r AS (SELECT unnest([""" + ", ".join(f"'{r}'" for r in RU.registered()) + """]) AS rule_id)
SELECT rule_id, count(*) AS n_sets FROM a_building, r GROUP BY rule_id""")
def run_rules(spark, d):
    """No rule is ever silent: every rule speaks about every set."""
    out = RU.run_rules(every_input(spark, d), spark)
    return out.groupBy("rule_id").agg(F.count_distinct("set_id").alias("n_sets"))


@query("run_rules_counts")
def run_rules_counts(spark, d):
    out = RU.run_rules(every_input(spark, d), spark)
    return out.groupBy("rule_id", "fid", "severity", "reason").agg(F.count(F.lit(1)).alias("n"))


# ---- rules fed by row tables -----------------------------------------------------------------------

def row_inputs(spark, d):
    i = every_input(spark, d)
    i.resolved = i.doors = i.spaces = None
    return i


def by_set(arms, extra):
    return CODE + f""",
x AS ({extra})
SELECT set_id, 'as_drawn' AS scenario, CASE WHEN r LIKE '!%' THEN substr(r, 2) END AS fid, CASE WHEN r NOT LIKE '!%' THEN r END AS reason
FROM (SELECT bld.set_id, CASE {arms} END AS r FROM bld LEFT JOIN x ON x.set_id = bld.set_id)"""


query("rule_doc_sheet_numbers", by_set("""WHEN n IS NULL THEN 'the set has no sheets to identify' WHEN u / n > 0.2 THEN '!H-SN'
  WHEN u = 0 THEN 'every sheet''s number was read from its title block' ELSE 'sheets could not be identified; inside the reporting floor'""",
  "SELECT l_orderkey AS set_id, count(*) AS n, count(*) FILTER (WHERE l_suppkey % 3 = 0) AS u FROM lineitem GROUP BY l_orderkey"))(
    outcome_of("DOC.SHEET_NUMBERS", row_inputs))
query("rule_egress_ceiling_height", by_set("""WHEN NOT coalesce(rcp, FALSE) THEN 'reflected ceiling plan not found in this set'
  WHEN 6 + q / 10 + 1e-6 < 7.5 THEN '!M-CH' ELSE '!V-17'""",
  "SELECT l_orderkey AS set_id, bool_or(l_returnflag = 'A') AS rcp, min(l_quantity) AS q FROM lineitem GROUP BY l_orderkey"))(
    outcome_of("EGRESS.CEILING_HEIGHT", row_inputs))
query("rule_egress_occupant_load_posting", by_set(f"""WHEN g IS NULL THEN '{ABSENT}' WHEN g <> 'A-3' THEN 'the occupant-load posting of 1004.9 applies only to assembly occupancies'
  WHEN x.set_id IS NULL THEN 'sheet text not extracted on every sheet, so an absent posting cannot be established' WHEN posted THEN '!V-OLP' ELSE '!M-05'""",
  "SELECT l_orderkey AS set_id, bool_or(l_returnflag = 'R') AS posted FROM lineitem GROUP BY l_orderkey"))(
    outcome_of("EGRESS.OCCUPANT_LOAD_POSTING", row_inputs))
query("rule_egress_factor_consistency", by_set("""WHEN x.set_id IS NULL THEN 'exit widths and the occupants each exit is rated for not extracted'
  WHEN req IS NULL OR coalesce(occupant_load, 0) = 0 THEN 'required-width capacity factor not extracted'
  WHEN 72 / (lo * 12) - req / occupant_load > 0.005 OR req / occupant_load - 72 / (hi * 12) > 0.005 THEN '!M-02' ELSE '!V-UF'""",
  "SELECT l_orderkey AS set_id, min(l_quantity) AS lo, max(l_quantity) AS hi, any_value(f.req) AS req FROM lineitem LEFT JOIN first_ f ON f.set_id = l_orderkey AND f.section = '1005.3.2' GROUP BY l_orderkey"))(
    outcome_of("EGRESS.FACTOR_CONSISTENCY", row_inputs))
query("rule_fire_table_601_text", by_set("""WHEN coalesce(unrated, FALSE) AND t NOT IN ('II-B', 'V-B') THEN '!H-601' ELSE '!V-601'""",
  "SELECT l_orderkey AS set_id, bool_or(l_returnflag <> 'R') AS unrated FROM lineitem GROUP BY l_orderkey"))(
    outcome_of("FIRE.TABLE_601", row_inputs))
