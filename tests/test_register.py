"""Register, calibration, feedback and abstentions."""
from pyspark.sql import functions as F

from planlens.operators import abstentions as AB, calibration as C, feedback as FB, register as RG
from planlens.sources.catalog import questions

FIND = ("set_id bigint, rule_id string, fid string, status string, severity string, page int, sheet string, anchor string, title string, basis string, scenario string")


def f(fid, sev="HIGH", scenario="both", rule="R", page=0, status="OPEN", basis="drawings", title="t", set_id=1):
    return (set_id, rule, fid, status, sev, page, "A-1", "x", title, basis, scenario)


def test_twins_fold_and_repeats_pair_in_order(frame):
    df = frame([f("H-1", scenario="as_drawn"), f("H-1", scenario="as_declared"), f("H-2", scenario="as_drawn"), f("H-2", "LOW", "as_declared"),
                f("H-3", scenario="as_drawn", title="a"), f("H-3", scenario="as_drawn", title="b"), f("H-3", scenario="as_declared", title="a")], FIND)
    got = sorted((r.fid, r.scenario, r.severity, r.title) for r in RG.merge_scenarios(df).collect())
    assert got == [("H-1", "both", "HIGH", "t"), ("H-2", "as_declared", "LOW", "t"), ("H-2", "as_drawn", "HIGH", "t"), ("H-3", "as_drawn", "HIGH", "b"), ("H-3", "both", "HIGH", "a")]


def test_order_and_keys(frame):
    df = frame([f("H-3", page=2), f("H-3", page=1), f("M-1", "MEDIUM", "as_declared"), f("C-1", "CRITICAL", page=5), f("V-1", "VERIFIED"), f("X", "MEASURED")], FIND)
    got = [r.key for r in RG.finding_keys(RG.order_register(df)).orderBy("ord").collect()]
    assert got == ["C-1", "H-3", "H-3~2", "M-1@as_declared", "V-1", "X"]


def test_edits_apply_in_order_or_say_why_not(frame):
    keyed = frame([f("H-1"), f("V-1", "VERIFIED", status="PASS"), f("M-1", "MEDIUM")], FIND).withColumn("key", F.col("fid"))
    e = [(1, "H-1", 1, 0, "revise", "", "LOW", "", "why", "q", True, 0), (1, "H-1", 2, 1, "revise", "PASS", "HIGH", "", "why", "q", True, 0),
         (1, "V-1", 1, 2, "revise", "", "HIGH", "", "why", "", False, 0), (1, "M-1", 1, 3, "withdraw", "", "", "", "why", "q", True, 0),
         (1, "M-1", 2, 4, "revise", "", "LOW", "", "why", "q", True, 0)]
    edits = frame(e, "set_id bigint, key string, pass int, ordinal int, op string, status string, severity string, title string, reason string, quote string, quote_found boolean, page int")
    got = {r.key: r for r in RG.apply_edits(keyed, edits).collect()}
    assert (got["H-1"].severity, got["H-1"].held, got["H-1"].rejected[0].why) == ("LOW", 1, "a passing check cannot carry a problem severity")
    assert got["V-1"].severity == "VERIFIED" and "needs a quote" in got["V-1"].rejected[0].why
    assert got["M-1"].gone and got["M-1"].rejected[0].why == "no finding has the key"


def test_fingerprint_ignores_order_and_sees_change(frame):
    none = frame([], "set_id bigint, rule_id string, reason string, detail string")
    fp = lambda *rows: RG.fingerprint(frame(list(rows), FIND), none).collect()[0].fingerprint
    assert fp(f("A"), f("B")) == fp(f("B"), f("A")) != fp(f("A"), f("C"))


def test_viewer_rect_turns_the_box(frame):
    df = frame([(r, 10.0, 20.0, 30.0, 25.0, 100.0, 200.0) for r in (0, 90, 180, 270)], "r int, x0 double, y0 double, x1 double, y1 double, w double, h double")
    got = {x.r: (x.vx0, x.vy0, x.vx1, x.vy1) for x in df.select("r", *RG.viewer_rect("", "w", "h", "r")).collect()}
    assert got == {0: (10, 20, 30, 25), 90: (175, 10, 180, 30), 180: (70, 175, 90, 180), 270: (20, 70, 25, 90)}


PROF = ("rule_id string, profile_id string, version int, enabled boolean, severity_shift int, severity_cap string, severity_floor string, scope_occupancy array<string>, "
        "scope_basis array<string>, drop_verified boolean, weight double, confirmations int")


def p(rule, enabled=True, shift=0, cap=None, floor=None, occ=(), bas=(), drop=False, weight=1.0, n=0):
    return (rule, "active", 1, enabled, shift, cap, floor, list(occ), list(bas), drop, weight, n)


def test_profile_levels_and_never_loses_a_finding(frame):
    fs = frame([f("1", rule="off"), f("2", "CRITICAL", rule="up"), f("3", "LOW", rule="down"), f("4", "VERIFIED", rule="down"), f("5", rule="scoped"), f("6", rule="cap"),
                f("7", rule="none"), f("8", "VERIFIED", rule="drop")], FIND).withColumn("occupancy_group", F.lit("B"))
    prof = frame([p("off", enabled=False), p("up", shift=2), p("down", shift=-2), p("scoped", occ=["B"]), p("cap", cap="LOW"), p("drop", drop=True)], PROF)
    out = C.apply_profile(fs, prof)
    got = {r.fid: (r.disposition, r.after) for r in out.collect()}
    assert got == {"1": ("suppressed", "suppressed"), "2": ("kept", "CRITICAL"), "3": ("kept", "LOW"), "4": ("kept", "VERIFIED"), "5": ("suppressed", "suppressed"),
                   "6": ("kept", "LOW"), "7": ("kept", "HIGH"), "8": ("suppressed", "suppressed")}
    assert {r.rule_id for r in C.silenced(out).collect()} == {"off", "scoped"}
    assert C.kept(out).count() + out.where("disposition = 'suppressed'").count() == fs.count()


def test_next_version_leaves_the_old_one(frame, spark):
    prof = frame([p("a", shift=1, n=2)], PROF)
    ch = frame([(1, "a", "severity_shift", "-9"), (2, "b", "weight", "99"), (3, "a", "confirmations", "1"), (4, "a", "nonsense", "1")], "ordinal bigint, rule_id string, knob string, value string")
    got = {r.rule_id: r for r in C.next_version(prof, ch, C.knobs(spark)).collect()}
    assert (got["a"].severity_shift, got["a"].confirmations, got["a"].version, got["b"].weight, got["b"].enabled) == (-2, 3, 2, 5.0, True)


def fb(i, answers, rule="R", comment="", grp="B", subject="finding"):
    return (i, rule, subject, answers, comment, grp)


def test_triage_only_moves_up(frame, spark):
    rows = [fb(1, {"severity": "right"}), fb(2, {"severity": "overstated"}), fb(3, {"evidence": "misread_value"}), fb(4, {"citation": "wrong_section", "severity": "overstated"}),
            fb(5, {"conclusion": "not_applicable"}, grp=""), fb(6, {"severity": "overstated"}, comment="look"), fb(7, {"severity": "overstated"}, rule="loved"),
            fb(8, {"severity": "understated"}, rule="top"), fb(9, {})]
    df = frame(rows, "id bigint, rule_id string, subject string, answers map<string,string>, comment string, occupancy_group string")
    prof = frame([p("loved", n=3), p("top", shift=2)], PROF)
    got = {r.id: (r.disposition, r.signals) for r in FB.triage(df, FB.taxonomy(spark), prof).collect()}
    assert {i: d for i, (d, _) in got.items()} == {1: "confirmation", 2: "auto_tunable", 3: "needs_component", 4: "escalate", 5: "escalate", 6: "escalate", 7: "escalate", 8: "escalate",
                                                   9: "confirmation"}
    assert "citation" in got[4][1] and "no_occupancy" in got[5][1] and "contested" in got[7][1] and "out_of_bounds" in got[8][1] and got[9][1] == ["empty"]


def test_feedback_validation(frame, spark):
    df = frame([fb(1, {"severity": "right"}), fb(2, {"colour": "red"}), fb(3, {"severity": "bad"}), fb(4, {}, subject="coverage"), fb(5, {}, subject="x")],
               "id bigint, rule_id string, subject string, answers map<string,string>, comment string, occupancy_group string")
    got = {(r.id, r.problem) for r in FB.validate_feedback(df, FB.taxonomy(spark)).collect()}
    assert got == {(2, "unknown aspect"), (3, "unknown verdict"), (4, "must be answered"), (5, "unknown subject")}


def test_every_reason_has_a_class_and_causes_are_named(frame, spark):
    reasons = ["occupant load not extracted"] * 3 + ["neither the drawings nor the declaration state this", "no CAD layer matching 'egress path'", "rule raised", "something new"]
    a = frame([(1, f"R{i}", r, None, "") for i, r in enumerate(reasons)], "set_id bigint, rule_id string, reason string, page int, detail string")
    prof = frame([(1, [4, 2], [7], False, 0, False)], "set_id bigint, region_pages array<int>, raster_pages array<int>, converted boolean, cad_layers int, measured_off boolean")
    c = AB.classify(a, prof)
    assert [r.kind for r in c.orderBy("rule_id").collect()] == ["extraction"] * 4 + ["geometry", "error", "unknown"]
    got = {r.cause: (r.n, r.sheets) for r in AB.diagnose(c, prof).collect()}
    assert got == {"pasted_code_table": (4, [3, 5]), "scanned_sheets": (1, [8]), "no_layers": (1, []), "rule_error": (1, [])}


def test_rules_reasons_are_all_classified(spark):
    from planlens.operators import rules as RU
    import inspect
    import re
    src = inspect.getsource(RU)
    texts = set(re.findall(r'abstained\(r, "([^"]+)"', src)) | {RU.ABSENT, RU.NO_ROW.format("Table 1")}
    df = spark.createDataFrame([(t,) for t in texts], "reason string")
    unknown = [r.reason for r in df.withColumn("k", AB.reason_kind(F.col("reason"))).where("k = 'unknown'").collect()]
    assert unknown == []


def test_questions_unlock_rules(spark):
    got = {r.rule_id: r.fields for r in AB.unlocked_by(questions(spark)).collect()}
    assert got["STRUCT.WIND_STANDARD"] == ["wind_speed_mph", "exposure_category", "risk_category", "code_edition"]


def test_scorecard_is_not_multiplied_by_its_map(spark, shuffled):
    """Every rule speaks for every check: the rows that move stay in proportion to what was said and expected."""
    n = spark.range(300)
    pick = lambda k: F.element_at(F.array(*[F.lit(f"{k}{i}") for i in range(20)]), (F.col("j") + 1).cast("int"))
    four = n.select(F.col("id").alias("set_id"), F.explode(F.sequence(F.col("id") % 5, F.col("id") % 5 + 3)).alias("j"))
    said = four.select("set_id", pick("R").alias("rule_id"), F.lit("OPEN").alias("status"), F.lit("HIGH").alias("severity"))
    stood = four.select("set_id", pick("R").alias("rule_id"), F.lit("why").alias("reason"))
    expected = four.select("set_id", pick("E").alias("entry"), F.lit("HIGH").alias("severity"))
    rules = spark.range(20).select(F.concat(F.lit("R"), "id").alias("rule_id")).crossJoin(spark.range(20).select(F.concat(F.lit("E"), "id").alias("entry")))
    run = lambda: RG.scorecard(said, stood, expected, rules)
    assert {(r.outcome, r["count"]) for r in run().groupBy("outcome").count().collect()} == {("exact", 1200)}
    assert shuffled(run) < 3 * 3 * 1200
