"""Many claims to one value: grouping, rivals, independence, agreement."""
import random

from pyspark.sql import functions as F

from planlens.operators import facts as FX, reconcile as R
from planlens.sources.catalog import questions

SCHEMA = ("set_id bigint, field string, role string, value_type string, value_num double, value_str string, value_bool boolean, raw string, "
          "page int, sheet string, method string, label string, score double, source array<string>, seq bigint")


def claim(field, value, page=0, score=1.0, method="pair", sheet=None, seq=0, source=(), role="", set_id=1):
    num = float(value) if isinstance(value, (int, float)) else None
    return (set_id, field, role, "num" if num is not None else "str", num, None if num is not None else value, None, str(value), page,
            sheet or f"A-{page}", method, field, score, list(source), seq)


def test_most_specific_value_wins_and_rivals_stay(frame):
    df = frame([claim("occupancy_group", "A-3", 0, seq=1), claim("occupancy_group", "A", 1, seq=2), claim("occupancy_group", "A-2", 2, 0.95, seq=3)], SCHEMA)
    r = FX.resolved_facts(df).collect()
    assert len(r) == 1 and r[0].value_str == "A-3" and r[0].n_rivals == 1 and r[0].confidence == "high"


def test_written_out_values_are_one(frame):
    df = frame([claim("classification_of_work", "ALTERATION - LEVEL II", 0, seq=1), claim("classification_of_work", "LEVEL II", 1, seq=2),
                claim("classification_of_work", "LEVEL III", 2, seq=3)], SCHEMA)
    r = FX.resolved_facts(df).collect()[0]
    assert r.value_str == "ALTERATION - LEVEL II" and r.n_rivals == 1 and r.n_claims == 2


def test_tolerant_grouping_equals_the_walk(frame):
    rng = random.Random(3)
    vals = [(s, rng.choice([1000, 1015, 1040, 1060, 1500, 1530, 40000, 40500, 41200, 90000]), round(rng.random(), 1), rng.randrange(4), i)
            for s in range(6) for i in range(40)]
    df = frame([claim("total_area_sf", v, p, sc, seq=i, set_id=s) for s, v, sc, p, i in vals], SCHEMA)
    got = {(r.set_id, r.seq): r.group_no for r in FX.group_claims(df).select("set_id", "seq", "group_no").collect()}
    for s in range(6):
        groups = []
        for _, v, sc, p, i in sorted((x for x in vals if x[0] == s), key=lambda x: (-x[2], x[3], x[4])):
            home = next((g for g in groups if abs(g[0] - v) <= max(50, 0.02 * max(g[0], v))), None)
            if home is None:
                home = [v, len(groups) + 1]
                groups.append(home)
            assert got[(s, i)] == home[1]


def test_one_entity_read_twice_is_one_reading(frame):
    df = frame([claim("height_ft", 26.0, 0, method="pair", source=["e1"], seq=1), claim("height_ft", 26.0, 1, method="cad", source=["e1"], seq=2),
                claim("stories", 1, 0, source=["e1"], seq=3), claim("stories", 1, 1, source=["e2"], seq=4)], SCHEMA)
    r = {x.field: x.confidence for x in FX.resolved_facts(df, with_sources=True).collect()}
    assert r == {"height_ft": "medium", "stories": "high"}


def test_dedupe_keeps_the_first(frame):
    df = frame([claim("stories", 1, seq=5), claim("stories", 1, seq=2), claim("stories", 1, page=1, seq=3)], SCHEMA)
    assert sorted(r.seq for r in FX.dedupe_claims(df).collect()) == [2, 3]


def agree_rows(spark, rows):
    long = "set_id bigint, field string, value_num double, value_str string, value_bool boolean"
    split = lambda i, f, v: (i, f, float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None, v if isinstance(v, str) else None,
                             v if isinstance(v, bool) else None)
    d = spark.createDataFrame([split(i, f, a) for i, (f, a, b, w) in enumerate(rows)], long)
    w = spark.createDataFrame([split(i, f, b) for i, (f, a, b, w) in enumerate(rows)], long)
    return {r.set_id: r.state for r in R.reconcile(d, w, questions(spark)).collect()}


def test_agreement_and_tolerance(spark):
    rows = [("construction_type", "II-B", "Type IIB", True), ("height_ft", 26.33, "26'-4\"", True), ("building_area_sf", 15376, "15,500 SF", True),
            ("building_area_sf", 18000, 15376, False), ("stories", 1, 2, False), ("occupancy_group", "A-3", "ASSEMBLY", True),
            ("occupancy_group", "A-3", "A-2", False), ("sprinkler_system", "nfpa13", "YES", True), ("sprinkler_system", "none", "NFPA 13", False),
            ("sprinkler_system", "nfpa13r", "NFPA 13", False), ("wind_speed_mph", 170, 171, True), ("mixed_occupancy", True, "NO", False)]
    states = agree_rows(spark, rows)
    assert states == {i: "CORROBORATED" if r[3] else "CONFLICT" for i, r in enumerate(rows)}


def test_unanswered_is_unknown_and_two_scenarios_at_most(spark):
    long = "set_id bigint, field string, value_num double, value_str string, value_bool boolean"
    d = spark.createDataFrame([(1, "construction_type", None, "V-B", None), (1, "zoning", None, "C1", None), (2, "zoning", None, "C1", None)], long)
    w = spark.createDataFrame([(1, "construction_type", None, "II-B", None), (1, "stories", 2.0, None, None), (2, "zoning", None, "C2", None)], long)
    rec = R.reconcile(d, w, questions(spark), sets=spark.createDataFrame([(1,), (2,), (3,)], "set_id bigint"))
    assert rec.count() == 45 and rec.where("state = 'UNKNOWN'").count() == 45 - 4
    sc = R.scenarios(rec)
    assert {(r.set_id, r.scenario) for r in sc.select("set_id", "scenario").distinct().collect()} == {
        (1, "as_drawn"), (1, "as_declared"), (2, "as_drawn")}
    pick = {r.scenario: r.str for r in sc.where("field = 'construction_type'").collect()}
    assert pick == {"as_drawn": "II-B", "as_declared": "V-B"}


def test_separation_citation_overrides_a_no(frame):
    s = "set_id bigint, field string, value_num double, value_str string, value_bool boolean, source string, page int, note string"
    df = frame([(1, "separation_method", None, "separated", None, "G-2", 3, ""), (1, "mixed_occupancy", None, None, False, "G-2", 3, "")], s)
    r = R.apply_implication(df).where("field = 'mixed_occupancy'").collect()
    assert len(r) == 1 and r[0].value_bool is True and "not mixed" in r[0].note


def test_summary_is_wide(frame):
    df = frame([claim("stories", 1, seq=1), claim("occupancy_group", "B", seq=2)], SCHEMA)
    r = FX.fact_summary(FX.resolved_facts(df), ["stories", "occupancy_group", "height_ft"]).collect()[0]
    assert r["stories"] == "1.0" and r["occupancy_group"] == "B" and r["height_ft"] is None


def test_rounds_decide_as_the_walk_does(spark):
    r, rows = random.Random(4), []
    for i in range(250):
        kind = r.random()
        if kind < 0.5:
            v = ("num", r.choice([r.uniform(0, 4), r.uniform(90, 110), -r.uniform(1.9, 2.1), 1.5]), None, None)
        elif kind < 0.6:
            v = ("bool", None, None, r.random() < 0.5)
        else:
            v = ("text", None, " ".join(r.choices(["A", "B", "C-1", "d", "E.2", "see", "x"], k=r.randint(1, 6))) + r.choice(["", "!"]), None)
        rows.append((r.randint(1, 2), r.choice(["notes.x", "zz"]), r.choice(["", "required"]), *v, float(r.randint(1, 5)), r.randint(0, 3), i))
    rows += [(1, "zz", "", "text", None, "1.5", None, 5.0, 0, 1000), (1, "zz", "", "text", None, "???", None, 5.0, 0, 1001)]
    claims = spark.createDataFrame(rows, "set_id long, field string, role string, value_type string, value_num double, value_str string, value_bool boolean, "
                                         "score double, page int, seq long")
    order = F.struct((-F.col("score")).alias("s"), F.col("page").alias("p"), F.col("seq").alias("n"))
    v = claims.groupBy(*FX.FACT, *FX.VALUE).agg(F.min(order).alias("first")).select(*FX.FACT, F.struct("first", *FX._comparable(F.col("field")), *FX.VALUE).alias("v"))
    whole = v.withColumn("v", F.col("v").withField("value_type", F.lit("text")))  # one chain a fact
    assert sorted(map(str, FX.led_values(whole).collect())) == sorted(map(str, FX.walked_values(whole).collect()))


def test_a_fact_of_many_texts(spark):
    texts = spark.range(20_000).select(
        F.lit(1).alias("set_id"), F.lit("zz").alias("field"), F.lit("").alias("role"), F.lit("text").alias("value_type"), F.lit(None).cast("double").alias("value_num"),
        F.concat_ws(" ", F.lit("SEE SHEET"), "id", F.col("id") % 97).alias("value_str"), F.lit(None).cast("boolean").alias("value_bool"), F.lit(1.0).alias("score"),
        F.lit(0).alias("page"), F.col("id").alias("seq"))
    assert FX.group_claims(texts).agg(F.countDistinct("group_no"), F.count("*")).first() == (20_000, 20_000)


def test_reconciling_moves_each_side_once(spark, shuffled):
    """Both sides and the questions of a set meet in one exchange; readings by set move nothing more."""
    from pyspark.sql import functions as F
    from planlens.operators import reconcile as R
    from planlens.sources.catalog import DECLARED_FIELDS, questions
    one = spark.range(500).select(F.col("id").alias("set_id"), F.lit("stories").alias("field"), F.lit(2.0).alias("value_num"),
                                  F.lit(None).cast("string").alias("value_str"), F.lit(None).cast("boolean").alias("value_bool"))
    drawn = one.withColumn("value_num", F.when(F.col("set_id") % 2 == 0, 2.0).otherwise(3.0)).withColumn("page", F.lit(1))
    run = lambda: R.scenarios(R.reconcile(one, drawn, questions(spark), sets=one.select("set_id")), keep_silent=True)
    assert run().count() == 15 * 750
    assert shuffled(run) <= 500 * (2 + len(DECLARED_FIELDS)) + 100


def test_only_groups_of_several_readings_are_taken_apart(frame, monkeypatch):
    rows = [(1, "a", "", 1, ["e1"]), (1, "a", "", 2, ["e1"]), (1, "a", "", 2, ["e2"]), (1, "a", "", 3, ["e1", "e2"]), (1, "a", "", 3, ["e2", "e3"]),
            (1, "a", "", 4, ["e2", "e1"]), (1, "a", "", 4, ["e1", "e2"]), (1, "a", "", 5, []), (1, "a", "", 6, None)]
    g = frame([(*r[:4], k % 2, "L", r[4]) for k, r in enumerate(rows)], "set_id bigint, field string, role string, group_no int, page int, method string, source array<string>")
    seen = []
    whole = FX.connected_components
    monkeypatch.setattr(FX, "connected_components", lambda nodes, edges, keys: seen.append({r.group_no for r in nodes.collect()}) or whole(nodes, edges, keys))
    assert {r.group_no: r.n_clusters for r in FX.reading_clusters(g).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}
    assert seen == [{2, 3}]


def test_a_set_moves_as_one_row_a_side(spark, shuffled):
    """What a side says of a set is gathered before it moves; a question asked alone is read as it is among all."""
    from planlens.sources.catalog import DECLARED_FIELDS
    fields = ["stories", "height_ft", "building_area_sf", "zoning"]
    long = spark.range(400).select(F.col("id").alias("set_id"), F.explode(F.array(*map(F.lit, fields))).alias("field"), F.lit(2.0).alias("value_num"),
                                   F.when(F.col("id") % 3 == 0, "C1").otherwise("C2").alias("value_str"), F.lit(None).cast("boolean").alias("value_bool"))
    drawn = long.withColumn("value_num", F.when(F.col("set_id") % 4 == 0, 3.0).otherwise(2.0)).withColumn("page", F.lit(1)).where("set_id % 5 <> 0 or field <> 'stories'")
    run = lambda only=None: R.reconcile(long, drawn, questions(spark), sets=spark.range(400).withColumnRenamed("id", "set_id"), fields=only)
    assert run().count() == 400 * len(DECLARED_FIELDS)
    assert shuffled(run) <= 400 * 3 + 100
    assert sorted(map(str, run(["stories"]).collect())) == sorted(map(str, run().where("field = 'stories'").collect()))
    states = {r.state: r.n for r in run().groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert states["DECLARED_ONLY"] == 80 and states["CONFLICT"] == 80 + 100 and states["UNKNOWN"] == 400 * (len(DECLARED_FIELDS) - 4)


def test_values_said_twice_stand_beside_each_other(spark):
    long = "set_id bigint, field string, value_num double, value_str string, value_bool boolean"
    d = spark.createDataFrame([(1, "stories", 1.0, None, None), (1, "stories", 2.0, None, None), (2, "no_question", 1.0, None, None)], long)
    w = spark.createDataFrame([(1, "stories", 2.0, None, None), (1, "stories", 3.0, None, None)], long)
    rows = R.reconcile(d, w, questions(spark)).collect()
    assert sorted((r.declared_num, r.drawn_num, r.state) for r in rows) == [(1, 2, "CONFLICT"), (1, 3, "CONFLICT"), (2, 2, "CORROBORATED"), (2, 3, "CONFLICT")]


def test_asked_rows_are_those_of_the_views(spark):
    from planlens.plans import q_rules_more as M
    from planlens.plans.adapters import adapter
    d = "/root/testdata/sf0.001"
    for got, view in ((M.answers(spark, d), "a_answers"), (M.stated(spark, d), "a_stated")):
        want = adapter(spark, d, view)
        assert got.count() > 0 and sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_facts_of_few_values_join_no_pairs(spark, monkeypatch):
    """Facts of few values are folded, one of many goes through the rounds; both decide alike, numbers beside texts too."""
    rows = [(1, "zz", "", "num", v, None, None, 1.0, 0, i) for i, v in enumerate((1.0, 500.0, 501.0, 900.0))] + [(1, "zz", "", "text", None, "500.0", None, 1.0, 0, 9)]
    rows += [(2, "zz", "", "num", float(i * i), None, None, 1.0, 0, i) for i in range(FX.FOLDED + 20)]
    claims = spark.createDataFrame(rows, "set_id long, field string, role string, value_type string, value_num double, value_str string, value_bool boolean, "
                                         "score double, page int, seq long")
    seen, rounds = [], FX.led_values
    monkeypatch.setattr(FX, "led_values", lambda v: seen.append({r.set_id for r in v.select("set_id").distinct().collect()}) or rounds(v))
    groups = lambda: sorted((r.set_id, r.seq, r.group_no) for r in FX.group_claims(claims).collect())
    got = groups()
    assert seen == [{2}] and {g for s, n, g in got if s == 1 and n in (1, 2, 9)} == {2}
    monkeypatch.setattr(FX, "FOLDED", 0)
    assert groups() == got


def test_a_group_s_distinct_counts_move_a_claim_once(spark, shuffled):
    """Pages, sheets and readers of a group are counted in one aggregate, NULL ones not."""
    g = spark.range(900).select((F.col("id") % 9).alias("set_id"), F.lit("zz").alias("field"), F.lit("").alias("role"), F.lit(1).alias("group_no"), F.lit("num").alias("value_type"),
                                F.lit(1.0).alias("value_num"), F.lit(None).cast("string").alias("value_str"), F.lit(None).cast("boolean").alias("value_bool"), F.lit(1.0).alias("score"),
                                (F.col("id") % 5).cast("int").alias("page"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("A-"), (F.col("id") % 10).cast("string"))).alias("sheet"),
                                F.lit("m").alias("method"), F.lit("L").alias("label"), F.lit("r").alias("raw"), F.array(F.lit("e")).alias("source"), F.col("id").alias("seq"))
    assert {(r.n_pages, r.n_sheets, r.n_methods, r.n_claims) for r in FX.group_stats(g).collect()} == {(5, 5, 1, 100)}
    assert shuffled(lambda: FX.group_stats(g)) <= 9 * 8
