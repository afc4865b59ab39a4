"""Components, runs, scales, views, blocks."""
import random

import pytest
from pyspark.sql import functions as F

from planlens.operators import geometry as G, profile as P, tables as TB
from planlens.operators.helpers import connected_components


def test_components_equal_union_find(frame):
    rng = random.Random(11)
    edges = [(1, rng.randrange(80), rng.randrange(80)) for _ in range(55)]
    parent = list(range(80))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for _, a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = frame([(1, i) for i in range(80)], "set_id bigint, id bigint")
    got = connected_components(nodes, frame(edges, "set_id bigint, a bigint, b bigint"), ["set_id"]).collect()
    assert {r.id: r.label for r in got} == {i: root(i) for i in range(80)}


def test_longest_run_joins_dashes(frame):
    rng = random.Random(2)
    dashes = [(1, 0, float(x), 10.0, float(x + 6), 10.2) for x in range(0, 70, 7)] + [(1, 0, 200.0, 10.0, 240.0, 10.0), (1, 0, 5.0, 0.0, 5.0, 60.0), (1, 0, 0.0, 0.0, 50.0, 50.0)]
    rng.shuffle(dashes)
    df = frame(dashes, "set_id bigint, page int, x0 double, y0 double, x1 double, y1 double")
    assert G.longest_run(df).collect()[0].run_pt == 69.0


@pytest.mark.parametrize("text,want", [("1/4\" = 1'-0\"", 18.0), ("1 1/2\" = 1'-0\"", 108.0), ("\" = 1'-0\"", None), ("3/8\"=1'-0\"", 27.0)])
def test_scale_labels(frame, text, want):
    got = frame([(text,)], "t string").select(G.label_scale(F.col("t"))).collect()[0][0]
    assert got == want


def test_views_cluster_linework(frame):
    s = "set_id bigint, page int, x0 double, y0 double, x1 double, y1 double"
    box = lambda x, y: [(1, 0, x, y, x + 200.0, y + 5.0), (1, 0, x, y, x + 5.0, y + 150.0)]
    df = frame(box(50.0, 50.0) + box(500.0, 50.0) + [(1, 0, 0.0, 0.0, 1000.0, 800.0)], s)
    pages = frame([(1, 0, 1000.0, 800.0)], "set_id bigint, page int, width double, height double")
    v = G.views(df, pages).orderBy("view").collect()
    assert [(r.view, r.x0, r.x1) for r in v] == [(1, 48.0, 252.0), (2, 492.0, 708.0)]


def test_blocks_expand_and_cycles_pass_the_cap(frame):
    ins = frame([(1, None, "A", 2, 1), (1, "A", "B", 3, 0), (2, None, "C", 1, 0), (2, "C", "C", 1, 0)],
                "set_id bigint, block string, child string, copies int, attribs int")
    con = frame([(1, None, 5), (1, "A", 1), (1, "B", 4), (2, "C", 1)], "set_id bigint, block string, plain int")
    got = {r.set_id: r.n_entities for r in G.expanded_count(ins, con, 1000).collect()}
    # 5 + 2 x (1 + 1 attribute + A), A = 1 + 3 x (1 + 4)
    assert got == {1: 5 + 2 * (2 + 1 + 3 * 5), 2: 1001}


def test_bands_merge_transitively(frame):
    s = "set_id bigint, page int, img int, x0 double, y0 double, x1 double, y1 double, megapixels double"
    df = frame([(1, 0, 1, 0.0, 0.0, 100.0, 50.0, 0.2), (1, 0, 2, 0.0, 51.0, 100.0, 100.0, 0.2), (1, 0, 3, 0.0, 101.0, 98.0, 150.0, 0.2), (1, 0, 4, 0.0, 152.0, 30.0, 170.0, 0.1),
                (1, 0, 5, 300.0, 0.0, 400.0, 50.0, 0.2)], s)
    got = sorted((r.x0, r.y0, r.x1, r.y1, round(r.megapixels, 3)) for r in P.merge_bands(df).collect())
    assert got == [(0.0, 0.0, 100.0, 150.0, 0.6), (0.0, 152.0, 30.0, 170.0, 0.1), (300.0, 0.0, 400.0, 50.0, 0.2)]


def test_label_ties_stay_undecided(frame):
    v = frame([(1, 0, 1, 0.0, 0.0, 100.0, 100.0), (1, 0, 2, 100.0, 0.0, 200.0, 100.0)], "set_id bigint, page int, view int, x0 double, y0 double, x1 double, y1 double")
    l = frame([(1, 0, 1, 10.0, 110.0, 50.0, 120.0), (1, 0, 2, 90.0, 110.0, 110.0, 120.0), (1, 0, 3, 10.0, 400.0, 50.0, 410.0)],
              "set_id bigint, page int, label_id int, x0 double, y0 double, x1 double, y1 double")
    assert {r.label_id: r.view for r in G.label_owner(l, v).collect()} == {1: 1, 2: None, 3: None}


def test_an_absent_anchor_is_not_found_by_its_beginning(frame):
    items = frame([(1, 0, 1, "EGRESS CAPACITY OF NORTH STAIR", 0.0, 0.0, 90.0, 10.0), (1, 0, 2, "see plan", 0.0, 20.0, 40.0, 30.0)],
                  "set_id bigint, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    anchors = frame([(1, 0, "Egress capacity of south stair"), (1, 0, "north stair see  plan")], "set_id bigint, page int, anchor string")
    assert [(r.anchor, r.y1) for r in G.locate_anchor(items, anchors).collect()] == [("north stair see  plan", 30.0)]
    got = {r.anchor: (r.y1, r.whole) for r in G.locate_anchor(items, anchors, prefix=16).collect()}
    assert got == {"Egress capacity of south stair": (10.0, False), "north stair see  plan": (30.0, True)}


def test_long_titles_and_area_tables_are_read_to_the_end(frame):
    schema = "set_id bigint, page int, line_no int, text string"
    sheets = frame([(1, 0, "A-101", False), (2, 0, "A-101", False)], "set_id bigint, page int, code string, is_general_prefix boolean")
    title = ["SHEET TITLE", "FIRST", "SECOND", "THIRD", "FOURTH", "A-101"]
    high = ["FLOOR PLAN", *["NOTE: x"] * 9, "A-101"]
    ln = frame([(k, 0, i, t) for k, ts in ((1, title), (2, high)) for i, t in enumerate(ts)], schema)
    assert {r.set_id: r.title for r in P.sheet_titles(ln, sheets).collect()} == {1: "FIRST SECOND THIRD FOURTH", 2: "FLOOR PLAN"}
    assert {r.set_id: r.title for r in P.sheet_titles(ln, sheets, 3, 7).collect()} == {1: "FIRST SECOND THIRD", 2: ""}
    area = frame([(1, 0, i, t) for i, t in enumerate(["AREA CALCULATIONS", *["ROOM A 10 SQ. FT."] * 80])], schema)
    got = lambda *scan: [(r.n_rows, r.summed_sf) for r in TB.area_tally(area, sheets, *scan).collect()]
    assert got() == [(80, 800.0)] and got(60) == [(60, 600.0)]


def test_egress_runs_take_the_scale_of_their_view(frame):
    path = "set_id bigint, page int, layer string, kind string, x0 double, y0 double, x1 double, y1 double"
    walls = [(s, 0, "A-WALL", "rect", x, 0.0, x + 150.0, 150.0) for s in (1, 2, 3, 4, 5, 7) for x in (0.0, 400.0)]
    ways = [(1, 0, "L-Egress Path", "line", 10.0, 20.0, 60.0, 20.0), (1, 0, "L-Egress Path", "line", 140.0, 20.0, 61.0, 20.0),  # dashes of one run
            (1, 1, "L-Egress Path", "line", 0.0, 0.0, 900.0, 0.0),  # a later page
            (2, 0, "EGRESS PATH", "line", 10.0, 20.0, 100.0, 20.0), (2, 0, "EGRESS PATH", "line", 410.0, 20.0, 480.0, 20.0),
            (7, 0, "EGRESS PATH", "line", 10.0, 20.0, 500.0, 20.0),  # ties two plans into one view
            (3, 0, "EGRESS PATH", "curve", 0.0, 0.0, 50.0, 50.0),
            (4, 0, "EGRESS PATH", "rect", 10.0, 10.0, 40.0, 90.0), (5, 0, None, "line", 0.0, 0.0, 9.0, 0.0), (6, 0, "EGRESS PATH", "line", 0.0, 0.0, 30.0, 40.0)]
    quarter, eighth = "SCALE: 1/4\" = 1'-0\"", "SCALE: 1/8\" = 1'-0\""
    at = lambda s, i, x, t: (s, 0, i, t, x, 10.0, x + 60.0, 20.0)
    texts = [at(s, i, x, t) for s in (1, 2, 3, 7) for i, x, t in ((1, 20.0, quarter), (2, 420.0, eighth))] + [at(4, 1, 420.0, eighth), at(4, 2, 20.0, None)]
    t = "set_id bigint, page int, seg_id int, text string, x0 double, y0 double, x1 double, y1 double"
    pages = frame([(s, n, 1224.0, 792.0) for s in range(1, 8) for n in (0, 1)], "set_id bigint, page int, width double, height double")
    sheets = frame([(1, 0, "A-1")], "set_id bigint, page int, code string")
    got = {r.set_id: tuple(r)[1:] for r in G.egress_runs(frame(walls + ways, path), frame(texts, t), pages, sheets).collect()}
    assert got == {1: (0, "A-1", 2, 130.0, 18.0, ""), 2: (0, "", 2, 90.0, None, "spans several views"), 7: (0, "", 1, 490.0, None, "its view has no scale"), 3: (0, "", 0, None, None, ""),
                   4: (0, "", 4, 80.0, 9.0, ""), 6: (0, "", 1, 0.0, None, "the page has no scale and no views")}
    assert G.egress_runs(frame([], path), frame([], t), pages).collect() == []


def test_fixture_block_reads_its_page_once(frame):
    """Ratios above the two count columns, counts under the nearer one, all from one exchange of the segments by page."""
    from planlens.operators import tables as TB
    seg = lambda i, t, x0, y0, page=0, set_id=1: (set_id, page, i, t, x0, y0, x0 + 60.0, y0 + 10, 10.0, y0 + 5)
    rows = [seg(1, "PLUMBING COUNTS", 0.0, 0.0), seg(2, "WC: 1/125 MALE,", 0.0, 12.0), seg(3, "1/65 FEMALE", 90.0, 12.0), seg(4, "LAV: 1/200", 0.0, 24.0), seg(5, "LAV: 1/100", 0.0, 36.0),
            seg(6, "TOTAL REQUIRED", 0.0, 48.0), seg(7, "TOTAL PROVIDED", 150.0, 48.0), seg(8, "2 WC", 0.0, 60.0), seg(9, "3 WC", 150.0, 60.0), seg(10, "1 WC", 150.0, 72.0),
            seg(11, "PLUMBING COUNTS", 0.0, 300.0), seg(1, "PLUMBING COUNTS", 0.0, 0.0, 1), seg(2, "DF: 1/500", 0.0, 12.0, 1), seg(3, "OCCUPANTS: 7", 0.0, 12.0, 0, 2)]
    segs = frame(rows, "set_id bigint, page int, seg_id int, text string, x0 double, y0 double, x1 double, y1 double, h double, yc double")
    out = TB.fixture_block(segs)
    got = {(r.set_id, r.page, r.part, r.kind, r.male, r.female) for r in out.collect()}
    assert {(1, 0, "ratio", "wc", 125.0, 65.0), (1, 0, "ratio", "lav", 100.0, 100.0)} <= got and {g[:2] for g in got} == {(1, 0)}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_scale_for_counts_no_distinct_scales(spark):
    """Nested views of one scale govern a box, of two do not; one aggregation per box, without a distinct."""
    box = "set_id bigint, page int, {} x0 double, y0 double, x1 double, y1 double"
    boxes = spark.createDataFrame([(1, 0, 1, 5.0, 5.0, 6.0, 6.0), (2, 0, 1, 5.0, 5.0, 6.0, 6.0), (3, 0, 1, 5.0, 5.0, 6.0, 6.0)], box.format("box_id bigint,"))
    v = spark.createDataFrame([(1, 0, 18.0, 0.0, 0.0, 9.0, 9.0), (1, 0, 18.0, 4.0, 4.0, 9.0, 9.0), (2, 0, 18.0, 0.0, 0.0, 9.0, 9.0),
                               (2, 0, 36.0, 4.0, 4.0, 9.0, 9.0), (3, 0, 18.0, 0.0, 0.0, 9.0, 9.0), (3, 0, None, 4.0, 4.0, 9.0, 9.0)], box.format("scale double,"))
    pages = spark.createDataFrame([(i, 0, None) for i in (1, 2, 3)], "set_id bigint, page int, scale double")
    out = G.scale_for(boxes, v, pages)
    assert "distinct" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.set_id: (r.scale, r.why) for r in out.collect()} == {1: (18.0, ""), 2: (None, "nested views do not agree"), 3: (18.0, "")}


def test_views_of_a_page_are_cut_where_it_is(spark):
    """Winding linework is one view, found with one exchange of the paths and no rounds of joins; it equals a flood fill in plain Python."""
    import random
    rng = random.Random(3)
    boxes = [(s, 0, float(x := rng.randrange(-20, 900)), float(y := rng.randrange(-20, 700)), float(x + rng.randrange(1, 90)), float(y + rng.randrange(0, 40)))
             for s in range(6) for _ in range(6 + 5 * s)]
    boxes += [(9, 0, 14.0 * i, 400.0 * (i % 2), 14.0 * i + 5, 400.0) for i in range(20)]
    df = spark.createDataFrame(boxes, "set_id bigint, page int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(s, 0, 900.0, 700.0) for s in range(10)], "set_id bigint, page int, width double, height double")
    want = []
    for s in {b[0] for b in boxes}:
        hits = {}
        for _, _, x0, y0, x1, y1 in (b for b in boxes if b[0] == s):
            for cx in range(max(int(x0 // 12), 0), min(int(x1 // 12), 75) + 1):
                for cy in range(max(int(y0 // 12), 0), min(int(y1 // 12), 58) + 1):
                    hits[cx, cy] = hits.get((cx, cy), 0) + 1
        r = max(1, round(G.V.VIEW_GAP / 12))
        left = {(cx + i, cy + j) for cx, cy in hits for i in range(-r, r + 1) for j in range(-r, r + 1) if 0 <= cx + i <= 75 and 0 <= cy + j <= 58}
        while left:
            todo, part = [left.pop()], set()
            while todo:
                x, y = todo.pop()
                part.add((x, y))
                near = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & left
                left -= near
                todo += near
            own = [c for c in part if c in hits]
            if len(own) >= G.V.VIEW_MIN_CELLS:
                xs, ys = [c[0] for c in own], [c[1] for c in own]
                want.append((s, min(xs) * 12.0, min(ys) * 12.0, max(xs) * 12.0 + 12, max(ys) * 12.0 + 12, sum(hits[c] for c in own)))
    v = G.views(df, pages)
    assert sorted((r.set_id, r.x0, r.y0, r.x1, r.y1, r.paths) for r in v.collect()) == sorted(want) and len(want) > 8
    assert v._jdf.queryExecution().executedPlan().toString().count("MergeJoin") <= 1
    assert G.views(df.where("false"), pages).collect() == []
