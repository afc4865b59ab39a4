"""Rules on small sets: table checks, scenarios, and that no rule is ever silent."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from planlens.operators import facts as FX, reconcile as R, register as RG, rules as RU
from planlens.plans.review import review
from planlens.sources.catalog import questions
from planlens.sources.corpus import AREA, RATINGS, STORIES, TYPES, corpus

LONG = "set_id bigint, field string, value_num double, value_str string, value_bool boolean"


def long_rows(spark, answers):
    def row(i, f, v):
        flag = isinstance(v, bool)
        return (i, f, float(v) if isinstance(v, (int, float)) and not flag else None, v if isinstance(v, str) else None, v if flag else None)
    return spark.createDataFrame([row(i, f, v) for i, a in answers.items() for f, v in a.items()] or [], LONG)


def code(spark, *rows):
    return spark.createDataFrame([(i, s, r, p, n, f"G-{n}", "ROW", str(r), n) for n, (i, s, r, p) in enumerate(rows)],
                                 "set_id bigint, section string, required double, provided double, page int, sheet string, label string, required_raw string, ord bigint")


@pytest.fixture(scope="module")
def outcomes(spark):
    """One run over a set per case: 1 divergent, 2-3 rival common path, 4-5 exits and dead ends, 6-7 editions, 8-9 fixtures,
    10 air and panel, 11-12 measured runs, 13 an empty set."""
    business = {"occupancy_group": "B", "sprinkler_system": "YES"}
    gym = {"occupancy_group": "A-3", "sprinkler_system": "YES"}
    declared = {1: {"construction_type": "V-B"}, 6: {"code_edition": "fbc2020"}, 7: {"code_edition": "fbc2020"}}
    drawn = {1: {**business, "stories": 1, "construction_type": "II-B", "building_area_sf": 40000, "height_ft": 62}, 2: gym, 3: gym, 4: business, 5: gym, 8: gym, 9: gym}
    fx = [(i, 1, "ratio", k, m, w) for i in (8, 9) for k, m, w in (("wc", 125.0, 65.0), ("lav", 200.0, 200.0), ("drinking_fountain", 500.0, 500.0))]
    fx += [(i, 1, "load", "load", 70.0, None) for i in (8, 9)] + [(9, 1, "provided", "wc", 1.0, None)]
    fx += [(8, 1, "provided", k, n, None) for k, n in (("wc", 2.0), ("lav", 2.0), ("drinking_fountain", 1.0), ("service_sink", 1.0))]
    frame = spark.createDataFrame
    w = long_rows(spark, drawn).withColumn("source", F.lit("G-2")).withColumn("page", F.lit(2)).withColumn("note", F.lit(""))
    rec = R.reconcile(long_rows(spark, declared), w, questions(spark), sets=spark.range(1, 14).withColumnRenamed("id", "set_id"))
    i = RU.Inputs(
        R.scenarios(rec, keep_silent=True),
        attrs=frame([(4, 500.0, None, None, None), (5, 501.0, None, None, None), (6, None, dt.date(2023, 12, 30), None, None), (7, None, dt.date(2023, 12, 31), None, None),
                     (10, None, None, 860.0, 200.0)], "set_id bigint, occupant_load double, as_of date, oa_required_cfm double, panel_rating_a double"),
        code_data=code(spark, (2, "1006.2.1", 50.0, 38.0), (3, "1006.2.1", 75.0, 38.0), (4, "1006.3.2", 2.0, 2.0), (5, "1006.3.2", 2.0, 2.0), (4, "1020.5", 50.0, 9.0),
                       (5, "1020.5", 50.0, 9.0)),
        path_claims=frame([(2, "G-9", 1, 75.0, "COMMON PATH", 2, 9), (3, "G-1", 1, 75.0, "COMMON PATH", 2, 9)],
                          "set_id bigint, sheet string, page int, value_num double, label string, rank int, seq bigint"),
        fixtures=frame(fx, "set_id bigint, page int, part string, kind string, male double, female double"),
        schedules=frame([(10, "ROOF TOP UNIT SCHEDULE", 4, 2, "RTU-1", {"MARK": "RTU-1", "OUTSIDE AIR CFM": "500"}, ["RTU-1", "500"]),
                         (10, "ELECTRICAL LOAD CALCULATIONS", 5, 3, "TOTAL AMPERAGE", {"A": "B"}, ["TOTAL AMPERAGE", "220.5"]),
                         (10, "OCCUPANT DENSITY", 4, 1, "X", {"A": "B"}, ["X"])],
                        "set_id bigint, schedule string, page int, row_no int, mark string, cells map<string,string>, vals array<string>"),
        ventilation=frame([(10, 4, "STUDIO", 994.0, 40.0, 20.0, 0.06, 40.0, 860.0, False)],
                          "set_id bigint, page int, room string, area_sf double, density double, rp double, ra double, persons double, total_cfm double, is_total boolean"),
        egress_runs=frame([(11, 3, "A-1", 5, 1800.0, 18.0, ""), (12, 3, "A-1", 5, 1800.0, None, "spans several views")],
                          "set_id bigint, g_page int, g_sheet string, g_segments bigint, g_run_pt double, g_scale double, g_why string"))
    return RU.run_rules(i, spark).cache()


@pytest.fixture(scope="module")
def said(outcomes):
    return outcomes.collect()


def fids(said, set_id, *rules):
    return {r.rule_id: r.fid for r in said if r.set_id == set_id and r.rule_id in rules}


def test_every_rule_speaks_about_every_set(said):
    got = {(r.set_id, r.scenario, r.rule_id) for r in said}
    cases = [(1, "as_drawn"), (1, "as_declared")] + [(i, "as_drawn") for i in range(2, 14)]
    assert got == {(i, s, r) for i, s in cases for r in RU.registered()} and len(RU.registered()) == 39
    assert all(r.fid or r.reason for r in said)


def test_divergent_declaration_fails_one_reading_only(outcomes, said):
    got = {(r.scenario, r.fid) for r in said if r.set_id == 1 and r.rule_id.startswith("HEIGHT_AREA") and r.fid}
    assert got == {("as_drawn", "V-504H"), ("as_drawn", "V-504S"), ("as_drawn", "V-506"),
                   ("as_declared", "H-504H"), ("as_declared", "V-504S"), ("as_declared", "H-506")}
    by = {(r.rule_id, r.scenario) for r in RG.merge_scenarios(RU.findings(outcomes.where("set_id = 1"))).collect()}
    assert ("DECL.CONSTRUCTION_TYPE", "both") in by and ("HEIGHT_AREA.TABLE_506_AREA", "as_declared") in by


def test_common_path_and_its_rival_sheet(said):
    path = {r.set_id: (r.fid, r.sheet) for r in said if r.rule_id == "EGRESS.COMMON_PATH"}
    assert path[2] == ("H-02", "G-0") and path[3] == ("V-CP", "G-1") and path[13] == (None, None)


def test_exit_count_steps_and_dead_end_groups(said):
    assert fids(said, 4, "EGRESS.EXIT_COUNT", "EGRESS.DEAD_END") == {"EGRESS.EXIT_COUNT": "V-04", "EGRESS.DEAD_END": "V-02"}
    assert fids(said, 5, "EGRESS.EXIT_COUNT", "EGRESS.DEAD_END") == {"EGRESS.EXIT_COUNT": "C-EX", "EGRESS.DEAD_END": "M-DE"}


def test_edition_on_both_sides_of_a_change(said):
    assert [fids(said, i, "CODE.EDITION_CURRENT")["CODE.EDITION_CURRENT"] for i in (6, 7)] == ["V-ED", "C-ED"]


def test_fixture_counts(said):
    assert [fids(said, i, "PLUMB.FIXTURE_COUNT")["PLUMB.FIXTURE_COUNT"] for i in (8, 9)] == ["V-06", "P-01"]


def test_outdoor_air_and_panel(said):
    rules = ("MECH.OUTDOOR_AIR_CAPACITY", "MECH.OUTDOOR_AIR_ARITHMETIC", "ELEC.PANEL_LOADING")
    assert fids(said, 10, *rules) == dict(zip(rules, ("C-01", "V-35", "C-PL")))


def test_measured_run_needs_a_scale(said):
    got = {r.set_id: (r.severity, r.reason) for r in said if r.rule_id == "MEASURE.EGRESS_EXTENT"}
    assert got[11] == ("MEASURED", None) and got[12] == (None, "scale unresolved") and got[13][1].startswith("no CAD layer")


def test_corpus_invariants(spark):
    d = corpus(spark)
    assert d["area"].where("s1 <> 4 * ns or sm <> 3 * ns").count() == 0
    assert d["area"].where("grp = 'M' and ctype = 'V-B' and sm = 27000").count() == 1
    assert d["stories"].count() == len(STORIES) * 9 * 2 and len(RATINGS) == len(TYPES) == len(AREA["B"]["without"])


def test_review_end_to_end(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    z = (0.0, 0.0, 9.0, 9.0)
    rows = [("OCCUPANCY", ["ASSEMBLY (A-3)"], []), ("FIRE SPRINKLERS", ["YES"], []), ("COMMON PATH OF TRAVEL (1006.2.1)", ["50 LF", "38'-2\""], ["REQUIRED", "PROVIDED"]),
            ("CONSTRUCTION TYPE", ["III-B"], [])]
    pairs = spark.createDataFrame([(1, 0, "G-0", i, "row", l, v, h, [], "", z, [z, z]) for i, (l, v, h) in enumerate(rows)],
                                  f"set_id bigint, page int, sheet string, ord bigint, kind string, label string, values array<string>, headers array<string>, "
                                  f"context array<string>, heading string, label_box {box}, value_boxes array<{box}>")
    decl = spark.createDataFrame([(1, "V-B", 1)], "set_id bigint, construction_type string, stories int")
    register, stood = review(pairs, decl)
    got = {(r.rule_id, r.scenario, r.fid) for r in register.collect()}
    assert ("EGRESS.COMMON_PATH", "both", "H-02") in got and ("DECL.CONSTRUCTION_TYPE", "both", "X-CON") in got
    keys = [r.key for r in register.collect()]
    assert len(keys) == len(set(keys)) and stood.count() > 10


def test_conflicts_of_a_set_are_told_in_one_join(spark):
    """A finding per fact with rivals in order of field, a roll-up or an abstention otherwise, for every reading; the readings are worked out once."""
    lead = "struct<raw:string,page:int,sheet:string,label:string>"
    facts = spark.createDataFrame([(1, "b", "", 2, 2, ("r", 1, "A-1", "")), (1, "a", "", 1, 1, ("q", 2, "A-2", "L")), (1, "egress.common_path", "required", 1, 1, ("x", 3, "A-3", "")),
                                   (2, "a", "", 0, 2, ("s", 4, "A-4", "M")), (3, "a", "", 0, 1, ("t", 5, "A-5", ""))],
                                  f"set_id bigint, field string, role string, n_rivals bigint, n_stating bigint, lead {lead}")
    case = spark.createDataFrame([(i, s) for i in (1, 2, 3, 4) for s in ("as_drawn", "as_declared")], "set_id bigint, scenario string")
    out = RU.conflict_rules(RU.Inputs(case, resolved=facts), case)
    got = sorted((r.set_id, r.fid or "-", r.anchor or "-", r.page or 0) for r in out.where("scenario = 'as_declared'").collect())
    assert got == [(1, "M-XS", "L", 2), (1, "M-XSb", "r", 1), (2, "V-XS", "M", 4), (3, "-", "-", 0), (4, "-", "-", 0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
