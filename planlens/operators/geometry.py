"""Spatial measurement: scales, views, runs, areas, framing, block expansion, anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from planlens.functions import text as T, vocabulary as V
from planlens.operators import pages as PG
from planlens.operators.helpers import grid_join, merged_intervals, sided
from planlens.session import cut_lineage

PAGE = ["set_id", "page"]


def label_scale(c: Column) -> Column:
    """Points per foot of the first scale label in a text, NULL when it names no length."""
    whole = T.rx(c, V.SCALE_LABEL, 1).cast("double")
    part = T.rx(c, V.SCALE_LABEL, 2).cast("double") / F.nullif(T.rx(c, V.SCALE_LABEL, 3).cast("double"), F.lit(0.0))
    inch = F.coalesce(whole, F.lit(0.0)) + F.coalesce(part, F.lit(0.0))
    return T.bind(inch, lambda x: F.when(x > 0, F.bround(x * V.POINTS_PER_INCH, 3)))


def scale_labels(lines: DataFrame) -> DataFrame:
    """Every scale label printed on a line: set_id, page, line_no, label, pt_per_ft."""
    found = F.regexp_extract_all("text", F.lit(f"({V.SCALE_LABEL})"), 1)
    x = lines.select(*PAGE, "line_no", F.explode(found).alias("label"))
    return x.withColumn("pt_per_ft", label_scale(F.col("label"))).where("pt_per_ft is not null")


STRIDE = 1 << 20  # a cell's id is its row times this, and its column
CELLS_AT_ONCE = 1 << 21


def _stamped(a: np.ndarray, b: np.ndarray, c: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells that boxes from column a to b and row c to e cover, and how many boxes cover each."""
    wide, total = b - a + 1, np.cumsum((b - a + 1) * (e - c + 1))
    cells, hits, start = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + CELLS_AT_ONCE, "right")))
        box, k = PG.spread((wide * (e - c + 1))[start:stop])
        box += start
        at, n = np.unique((c[box] + k // wide[box]) * STRIDE + a[box] + k % wide[box], return_counts=True)
        cells, back = np.unique(np.r_[cells, at], return_inverse=True)
        hits, start = np.bincount(back, np.r_[hits, n]).astype(np.int64), stop
    return cells, hits


def _clusters(cells: np.ndarray) -> np.ndarray:
    """For each of sorted cells the place of the first cell it is connected with, over right and lower neighbours."""
    ends = []
    for step in (1, STRIDE):
        at = np.searchsorted(cells, cells + step)
        here = np.flatnonzero(cells[np.minimum(at, len(cells) - 1)] == cells + step)
        ends.append((here, at[here]))
    l, r = (np.concatenate(x) for x in zip(*ends))
    label = np.arange(len(cells))
    while True:
        low = np.minimum(label[l], label[r])
        new = label.copy()
        for x in (l, r, label[l], label[r]):  # the cells and what they were joined to
            np.minimum.at(new, x, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def views(paths: DataFrame, pages: DataFrame) -> DataFrame:
    """Clusters of linework on a page: set_id, page, view, box, number of path hits.

    Boxes are stamped on 12-point cells and cells within the gap reach each other; components of
    the grown cells with at least twelve stamped cells are views, boxed by the stamped ones. A page is worked out where it is.
    """
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    p = paths.join(pages.select(*PAGE, "width", "height"), PAGE)
    p = p.where(((F.col("x1") > F.col("x0")) | (F.col("y1") > F.col("y0")))
                & (area("") < V.VIEW_BORDER_SHARE * F.col("width") * F.col("height")))
    nx, ny = F.floor(F.col("width") / V.VIEW_CELL), F.floor(F.col("height") / V.VIEW_CELL)
    lo = lambda c: F.greatest(F.floor(F.col(c) / V.VIEW_CELL), F.lit(0)).cast("bigint")
    hi = lambda c, top: F.least(F.floor(F.col(c) / V.VIEW_CELL), top).cast("bigint")
    p = p.withColumn("a", lo("x0")).withColumn("b", hi("x1", nx)).withColumn("c", lo("y0")).withColumn("e", hi("y1", ny)).where(
        "b >= a and e >= c").withColumn("nx", nx).withColumn("ny", ny)  # boxes off the page drop
    reach, size = max(1, round(V.VIEW_GAP / V.VIEW_CELL)), V.VIEW_CELL

    def on_page(rows: pa.Table) -> dict:
        s = PG.arrays(rows, cols)
        cells, hits = _stamped(s["a"], s["b"], s["c"], s["e"])
        around, row, col = np.arange(-reach, reach + 1), cells // STRIDE, cells % STRIDE
        gx, gy = (g.ravel() for g in np.broadcast_arrays(col[:, None, None] + around[:, None], row[:, None, None] + around))
        grown = np.unique((gy * STRIDE + gx)[(gx >= 0) & (gy >= 0) & (gx <= s["nx"][0]) & (gy <= s["ny"][0])])
        label = _clusters(grown)[np.searchsorted(grown, cells)]
        at = np.argsort(label, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(label[at]) != 0])
        fold = lambda of, v: of.reduceat(v[at], first)
        x0, y0, x1, y1 = fold(np.minimum, col), fold(np.minimum, row), fold(np.maximum, col), fold(np.maximum, row)
        n = np.diff(np.r_[first, len(at)])
        order = np.lexsort((label[at[first]], x0, y0))
        v = order[n[order] >= V.VIEW_MIN_CELLS]
        return {"view": np.arange(1, len(v) + 1), "x0": x0[v] * float(size), "y0": y0[v] * float(size), "x1": (x1[v] + 1) * float(size),
                "y1": (y1[v] + 1) * float(size), "paths": fold(np.add, hits)[v]}
    cols = ["a", "b", "c", "e", "nx", "ny"]
    out = [PG.number("view"), *[StructField(c, DoubleType()) for c in ("x0", "y0", "x1", "y1")], StructField("paths", LongType())]
    return PG.each_page(p, cols, out, on_page)


def contains(o: str, i: str, slack: float = 2.0) -> Column:
    c = F.col
    return ((c(f"{i}x0") >= c(f"{o}x0") - slack) & (c(f"{i}y0") >= c(f"{o}y0") - slack)
            & (c(f"{i}x1") <= c(f"{o}x1") + slack) & (c(f"{i}y1") <= c(f"{o}y1") + slack))


def overlaps(a: str, b: str) -> Column:
    c = F.col
    return ((c(f"{a}x0") <= c(f"{b}x1")) & (c(f"{b}x0") <= c(f"{a}x1"))
            & (c(f"{a}y0") <= c(f"{b}y1")) & (c(f"{b}y0") <= c(f"{a}y1")))


def label_owner(labels: DataFrame, page_views: DataFrame) -> DataFrame:
    """The view each label belongs to: the one holding it, else the nearest above it, else the
    nearest within reach; NULL where two are equally good. A page has a handful of views."""
    box = ["x0", "y0", "x1", "y1"]
    l = labels.select(*PAGE, "label_id", *[F.col(c).alias(f"l_{c}") for c in box])
    v = page_views.select(*PAGE, "view", *[F.col(c).alias(f"v_{c}") for c in box])
    m = V.LABEL_MARGIN
    j = l.join(v, PAGE, "left")
    inside = contains("v_", "l_")
    over = (F.col("v_y1") <= F.col("l_y0") + m) & (F.col("v_x0") <= F.col("l_x1")) & (F.col("l_x0") <= F.col("v_x1"))
    dx = F.greatest(F.col("l_x0") - F.col("v_x1"), F.col("v_x0") - F.col("l_x1"), F.lit(0.0))
    dy = F.greatest(F.col("l_y0") - F.col("v_y1"), F.col("v_y0") - F.col("l_y1"), F.lit(0.0))
    near = lambda d, ok: F.array_sort(F.collect_list(F.when(ok, F.struct(d.alias("d"), "view"))))
    g = j.groupBy(*PAGE, "label_id").agg(
        F.count_if(inside).alias("n_in"), F.min(F.when(inside, F.col("view"))).alias("v_in"),
        near(F.col("l_y0") - F.col("v_y1"), over).alias("up"), near(F.sqrt(dx * dx + dy * dy), F.col("view").isNotNull()).alias("any"))
    def best(arr: str) -> Column:
        one, two = F.try_element_at(arr, F.lit(1)), F.try_element_at(arr, F.lit(2))
        clear = two.isNull() | (two["d"] - one["d"] > m)
        return F.when(clear & (one["d"] <= V.LABEL_REACH), one["view"])
    owner = F.when(F.col("n_in") == 1, F.col("v_in")).when(F.col("n_in") > 1, None).when(
        F.size("up") > 0, best("up")).otherwise(best("any"))
    return g.select(*PAGE, "label_id", owner.alias("view"))


def scale_agrees(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 0.05 * a / 18.0 + 0.05


def resolve_scale(labels: DataFrame, viewports: DataFrame, pages: DataFrame) -> DataFrame:
    """One scale per page, or why there is none.

    ``labels``: set_id, page, pt_per_ft; ``viewports``: set_id, page, pt_per_ft. One distinct
    label is HIGH when a viewport agrees, else MEDIUM; several abstain (views decide then).
    """
    lab = labels.groupBy(*PAGE).agg(F.count_distinct("pt_per_ft").alias("n_labels"), F.min("pt_per_ft").alias("scale"))
    one = lab.where("n_labels = 1").select(*PAGE, "scale")
    vp = viewports.join(one, PAGE, "left").groupBy(*PAGE).agg(
        F.count_distinct("pt_per_ft").alias("n_viewports"),
        F.coalesce(F.bool_or(scale_agrees(F.col("scale"), F.col("pt_per_ft"))), F.lit(False)).alias("agrees"))
    out = pages.select(*PAGE).join(lab, PAGE, "left").join(vp, PAGE, "left").fillna(0, ["n_labels", "n_viewports"])
    note = (F.when(F.col("n_labels") == 1, "").when(F.col("n_labels") > 1, "several scales are printed")
            .when(F.col("n_viewports") > 0, "no scale label to tell the viewports apart")
            .otherwise("no scale label and no viewports"))
    conf = F.when(F.col("n_labels") == 1, F.when(F.col("agrees"), "high").otherwise("medium")).otherwise("low")
    return out.select(*PAGE, F.when(F.col("n_labels") == 1, F.col("scale")).alias("scale"), conf.alias("confidence"),
                      note.alias("note"))


def view_scales(owned: DataFrame, page_views: DataFrame, viewports: DataFrame) -> DataFrame:
    """Each view's own scale from the labels it owns. ``owned``: set_id, page, view, pt_per_ft."""
    per = owned.where("view is not null").groupBy(*PAGE, "view").agg(
        F.count_distinct("pt_per_ft").alias("n"), F.min("pt_per_ft").alias("scale"))
    v = page_views.join(per, [*PAGE, "view"], "left")
    box = ["x0", "y0", "x1", "y1"]
    hit = (v.select(*PAGE, "view", "scale", *[F.col(c).alias(f"v_{c}") for c in box]).where("scale is not null")
           .join(viewports.select(*PAGE, "pt_per_ft", *[F.col(c).alias(f"p_{c}") for c in box]), PAGE)
           .where(overlaps("v_", "p_") & scale_agrees(F.col("scale"), F.col("pt_per_ft"))).select(*PAGE, "view").distinct()
           .withColumn("agrees", F.lit(True)))
    return v.join(hit, [*PAGE, "view"], "left").select(
        *PAGE, "view", *box, F.when(F.col("n") == 1, F.col("scale")).alias("scale"),
        F.when(F.col("n") == 1, F.when(F.col("agrees"), "high").otherwise("medium")).otherwise("low").alias("confidence"))


def scale_for(boxes: DataFrame, scaled_views: DataFrame, page_scale: DataFrame) -> DataFrame:
    """The scale governing each box: the page's, else the one view holding it, else a reason.

    ``boxes``: set_id, page, box_id, x0..y1.
    """
    box = ["x0", "y0", "x1", "y1"]
    b = boxes.select(*PAGE, "box_id", *[F.col(c).alias(f"b_{c}") for c in box])
    v = scaled_views.select(*PAGE, F.col("scale").alias("v_scale"), *[F.col(c).alias(f"v_{c}") for c in box], F.lit(True).alias("v"))
    j = b.join(v, PAGE, "left")
    inside, touch = contains("v_", "b_"), overlaps("v_", "b_")
    g = j.groupBy(*PAGE, "box_id").agg(
        F.count("v").alias("n_views"), F.count_if(inside).alias("n_in"), F.count_if(touch).alias("n_touch"),
        F.min(F.when(inside, F.col("v_scale"))).alias("in_scale"), F.max(F.when(inside, F.col("v_scale"))).alias("top_scale"))
    out = g.join(page_scale.select(*PAGE, F.col("scale").alias("p_scale")), PAGE, "left")
    scale = F.coalesce("p_scale", F.when((F.col("n_in") == 1) | ((F.col("n_in") > 1) & (F.col("in_scale") == F.col("top_scale"))), F.col("in_scale")))
    why = (F.when(scale.isNotNull(), "").when(F.col("n_views") == 0, "the page has no scale and no views")
           .when(F.col("n_in") == 1, "its view has no scale").when(F.col("n_in") > 1, "nested views do not agree")
           .when(F.col("n_touch") > 1, "spans several views").when(F.col("n_touch") == 1, "runs outside its view")
           .otherwise("outside every view"))
    return out.select(*PAGE, "box_id", scale.alias("scale"), why.alias("why"))


def longest_run(segments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The longest straight run per key after joining near-collinear dashes.

    ``segments``: keys, x0, y0, x1, y1. Dashes of one axis share a rounded fixed coordinate.
    """
    keys = keys or PAGE
    flat = F.abs(F.col("x1") - F.col("x0")) < V.COLLINEAR_PT
    level = F.abs(F.col("y1") - F.col("y0")) < V.COLLINEAR_PT
    run = lambda a, fixed, p, q: F.struct(F.lit(a).alias("axis"), F.bround(fixed, 1).alias("at"), F.least(p, q).alias("lo"),
                                          F.greatest(p, q).alias("hi"))
    arms = F.array_compact(F.array(F.when(flat, run("v", "x0", "y0", "y1")), F.when(level, run("h", "y0", "x0", "x1"))))
    x = segments.select(*keys, F.explode(arms).alias("r")).select(*keys, "r.*")
    merged = merged_intervals(x, [*keys, "axis", "at"], "lo", "hi", V.RUN_JOIN_PT)
    return merged.groupBy(*keys).agg(F.max(F.col("hi") - F.col("lo")).alias("run_pt"))


def line_segments(paths: DataFrame) -> DataFrame:
    """The straight lines of drawn paths: a ``line`` is one, a ``rect`` has four sides, other kinds none."""
    side = lambda a, b, c, d: F.struct(*[F.col(v).cast("double").alias(n) for v, n in zip((a, b, c, d), ("x0", "y0", "x1", "y1"))])
    whole = side("x0", "y0", "x1", "y1")
    sides = F.array(side("x0", "y0", "x1", "y0"), side("x1", "y0", "x1", "y1"), side("x1", "y1", "x0", "y1"), side("x0", "y1", "x0", "y0"))
    lines = F.when(F.col("kind") == "line", F.array(whole)).when(F.col("kind") == "rect", sides)
    rest = [c for c in paths.columns if c not in ("kind", "x0", "y0", "x1", "y1")]
    return paths.select(*rest, F.explode(lines).alias("s")).select(*rest, "s.*")


def egress_runs(paths: DataFrame, texts: DataFrame, pages: DataFrame, sheets: DataFrame | None = None, viewports: DataFrame | None = None,
                layer: str = V.EGRESS_LAYER) -> DataFrame:
    """What the egress layer of each set measures: set_id, g_page, g_sheet, g_segments, g_run_pt, g_scale, g_why.

    ``paths``: set_id, page, layer, kind (line, rect, anything else has no straight line), x0..y1; ``texts``:
    set_id, page, seg_id, text, x0..y1; ``pages``: set_id, page, width, height; ``sheets``: set_id, page, code;
    ``viewports``: set_id, page, pt_per_ft, x0..y1. Both may be left out.

    A set's first page with the layer counts. The longest straight run of the layer is measured in points; its scale is
    the page's where one label is printed, else that of the view which holds the whole layer, resolved
    from the labels the view owns. Views are cut only for pages with several labels. Without a scale ``g_why`` says why.
    A set without the layer has no row; a layer without straight lines has no run and no segments.
    """
    box = ["x0", "y0", "x1", "y1"]
    drawn = paths.where(F.contains(F.lower("layer"), F.lit(layer)))
    target = cut_lineage(drawn.groupBy("set_id").agg(F.min("page").alias("page")))
    lines = cut_lineage(line_segments(drawn.join(target, PAGE, "left_semi").select(*PAGE, "kind", *box)))
    reach = lines.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("g_segments"), F.min(F.least("x0", "x1")).alias("x0"), F.min(F.least("y0", "y1")).alias("y0"),
                                     F.max(F.greatest("x0", "x1")).alias("x1"), F.max(F.greatest("y0", "y1")).alias("y1"))
    here = pages.join(target, PAGE, "left_semi")
    said = texts.join(target, PAGE, "left_semi")
    labels = cut_lineage(scale_labels(said.withColumn("line_no", F.col("seg_id"))).select(*PAGE, F.col("line_no").alias("label_id"), "pt_per_ft").distinct())
    ports = (target.select(*PAGE, *[F.lit(None).cast("double").alias(c) for c in ("pt_per_ft", *box)]).where("false") if viewports is None
             else viewports.join(target, PAGE, "left_semi"))
    page_scale = cut_lineage(resolve_scale(labels, ports, here))
    several = labels.groupBy(*PAGE).agg(F.count_distinct("pt_per_ft").alias("n")).where("n > 1").select(*PAGE)
    ends = [F.least("x0", "x1").alias("x0"), F.least("y0", "y1").alias("y0"), F.greatest("x0", "x1").alias("x1"), F.greatest("y0", "y1").alias("y1")]
    cut = cut_lineage(views(paths.join(several, PAGE, "left_semi").select(*PAGE, *ends), here))
    at = said.select(*PAGE, F.col("seg_id").alias("label_id"), *box).join(labels.select(*PAGE, "label_id").distinct(), [*PAGE, "label_id"], "left_semi")
    owned = label_owner(at.join(several, PAGE, "left_semi"), cut).join(labels, [*PAGE, "label_id"])
    governed = scale_for(reach.withColumn("box_id", F.lit(1)), view_scales(owned, cut, ports), page_scale).select(
        *PAGE, F.col("scale").alias("g_scale"), F.col("why").alias("g_why"))
    out = (target.join(reach.select(*PAGE, "g_segments"), PAGE, "left").join(longest_run(lines), PAGE, "left").join(governed, PAGE, "left"))
    out = out.withColumn("code", F.lit("")) if sheets is None else out.join(sheets.select(*PAGE, "code"), PAGE, "left")
    # lines that all stand aslant have no straight run: its length is 0
    run = F.when(F.col("g_segments") > 0, F.coalesce("run_pt", F.lit(0.0)))
    return out.select("set_id", F.col("page").alias("g_page"), F.coalesce("code", F.lit("")).alias("g_sheet"), F.coalesce("g_segments", F.lit(0)).alias("g_segments"),
                      run.alias("g_run_pt"), "g_scale", F.coalesce("g_why", F.lit("")).alias("g_why"))


def polyline_length(points: Column, scale: Column) -> Column:
    """Length of a polyline in feet: points ARRAY<STRUCT<x,y>>; NULL without a scale."""
    legs = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points)),
                      lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
    total = F.aggregate(legs, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return F.when(F.size(points) >= 2, total / scale)


def shoelace(points: Column) -> Column:
    """Twice-signed area halved: the area a closed straight outline encloses."""
    nxt = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, F.lit(1), F.lit(1)))
    cross = F.zip_with(points, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, x: acc + x)) / 2.0


def polygon_area(outlines: DataFrame, windows: DataFrame, units_in: float) -> DataFrame:
    """Areas of closed straight outlines on area layers, in every view whose window holds their
    centre. ``outlines``: set_id, handle, layer, closed, has_arc, points. ``windows``: set_id, page,
    viewport, wx0..wy1."""
    sf = shoelace(F.col("points")) * units_in * units_in / 144.0
    mid = lambda c: (F.array_min(F.transform("points", lambda p: p[c])) + F.array_max(F.transform("points", lambda p: p[c]))) / 2
    o = outlines.where(F.col("layer").rlike(V.AREA_LAYER) & F.col("closed") & ~F.col("has_arc") & (F.size("points") >= 3))
    o = T.staged(o, area_sf=sf, mx=mid("x"), my=mid("y")).where("area_sf >= 1.0")
    inside = F.col("mx").between(F.col("wx0"), F.col("wx1")) & F.col("my").between(F.col("wy0"), F.col("wy1"))
    return o.join(windows, "set_id").where(inside).select(
        "set_id", "page", "viewport", "handle", "layer", F.bround("area_sf", 1).alias("area_sf"), F.size("points").alias("vertices"))


def dimension_check(dims: DataFrame) -> DataFrame:
    """Dimensions with the text they print beside what they measure.

    ``dims``: set_id, page, handle, viewport, seq, text, measured, factor, override. One row per
    dimension and viewport; the text runs of one dimension are its ordered parts.
    """
    runs = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("seq", F.trim("text").alias("t")))))
    g = dims.groupBy(*PAGE, "handle", "viewport").agg(
        F.array_join(F.transform(runs, lambda r: r["t"]), " ").alias("printed"), F.max("measured").alias("measured"),
        F.max("factor").alias("factor"), F.max("override").alias("override"))
    o = F.coalesce("override", F.lit(""))
    return g.where("measured is not null").withColumn("shown", F.bround(F.col("measured") * F.coalesce("factor", F.lit(1.0)), 4)).withColumn(
        "overridden", (o != "") & ~o.contains("<>"))


def framed(entities: DataFrame, windows: DataFrame, cell: float = 64.0) -> DataFrame:
    """How many plotted entities meet each viewport window. ``entities``: set_id, ent, x0..y1, plots;
    ``windows``: set_id, viewport, x0..y1."""
    box = ["x0", "y0", "x1", "y1"]
    hits = grid_join(sided(windows, "l_", ["set_id"], "viewport", *box), sided(entities.where("plots"), "r_", ["set_id"], "ent", *box),
                     ["set_id"], overlaps("l_", "r_"), cell=cell)
    n = hits.groupBy("set_id", F.col("l_viewport").alias("viewport")).agg(F.count(F.lit(1)).alias("drawn"))
    return windows.join(n, ["set_id", "viewport"], "left").fillna(0, ["drawn"])


def empty_share(framed_views: DataFrame) -> DataFrame:
    """Share of a sheet's viewport area that frames nothing. Needs ``area`` per viewport."""
    return framed_views.groupBy("set_id").agg(
        F.coalesce(F.try_divide(F.sum(F.when(F.col("drawn") == 0, F.col("area")).otherwise(0.0)), F.sum("area")), F.lit(0.0)).alias("share"))


def expanded_count(inserts: DataFrame, contents: DataFrame, cap: int) -> DataFrame:
    """Entities drawn once nested blocks are expanded, per set, capped at cap + 1.

    ``contents``: set_id, block, plain (entities that are no insert). ``inserts``: set_id, block
    (NULL: a layout), child, copies, attribs, summed per (block, child) before the walk. The walk
    goes level by level, however deep blocks nest; a chain with more links than its set has blocks
    comes back to one of them, so the set counts as past the cap.
    """
    past = float(cap + 1)
    edge = inserts.groupBy("set_id", "block", "child").agg(
        F.sum("copies").cast("double").alias("n"), F.sum(F.col("copies") * (1 + F.col("attribs"))).cast("double").alias("own"))
    edge = cut_lineage(edge)
    kids = edge.select("set_id", F.col("block").alias("at"), F.col("child").alias("next"), "n", "own")
    plain = contents.select("set_id", F.col("block").alias("at"), F.col("plain").cast("double").alias("plain"))
    front = edge.where("block is null").groupBy("set_id", F.col("child").alias("at")).agg(
        F.least(F.sum("n"), F.lit(past)).alias("mult"))
    total = edge.where("block is null").groupBy("set_id").agg(F.sum("own").alias("t")).unionByName(
        contents.where("block is null").groupBy("set_id").agg(F.sum("plain").cast("double").alias("t")))
    blocks = edge.groupBy("set_id").agg(F.count_distinct("child").alias("blocks"))
    depth = 0
    while True:
        front = cut_lineage(front)
        if depth:
            turned = front.join(blocks.where(F.col("blocks") < depth + 1), "set_id", "left_semi")
            total = total.unionByName(turned.select("set_id", F.lit(past).alias("t")))
            front = front.join(blocks.where(F.col("blocks") >= depth + 1), "set_id", "left_semi")
        if front.isEmpty():
            break
        depth += 1
        here = front.join(plain, ["set_id", "at"]).groupBy("set_id").agg(F.sum(F.col("mult") * F.col("plain")).alias("t"))
        down = front.join(kids, ["set_id", "at"])
        nested = down.groupBy("set_id").agg(F.sum(F.col("mult") * F.col("own")).alias("t"))
        total = total.unionByName(here).unionByName(nested)
        front = down.groupBy("set_id", F.col("next").alias("at")).agg(F.least(F.sum(F.col("mult") * F.col("n")), F.lit(past)).alias("mult"))
    return total.groupBy("set_id").agg(F.least(F.sum("t"), F.lit(past)).cast("bigint").alias("n_entities"))


def locate_anchor(items: DataFrame, anchors: DataFrame, prefix: int | None = None) -> DataFrame:
    """Boxes of every occurrence of an anchor phrase in a page's text items.

    ``items``: set_id, page, seq, text, x0..y1. ``anchors``: set_id, page, anchor. Occurrences are
    counted in content order and do not overlap. With ``prefix`` an anchor absent as a whole is looked
    for by so many of its first characters (the reference takes V.ANCHOR_PREFIX); such hits may be of
    other phrases and have ``whole`` false. The page text is joined once per page.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.upper(c), r"\s+", " "))
    it = items.withColumn("t", norm(F.col("text"))).where("t <> ''")
    w = W.partitionBy(*PAGE).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    it = it.withColumn("lo", F.coalesce(F.sum(F.length("t") + 1).over(w), F.lit(0))).withColumn("hi", F.col("lo") + F.length("t") + 1)
    page = it.groupBy(*PAGE).agg(F.concat(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda s: s["t"]), " "), F.lit(" ")).alias("joined"))
    a = anchors.select(*PAGE, "anchor").distinct().withColumn("target", norm(F.col("anchor"))).where("target <> ''").join(page, PAGE)
    a = a.withColumn("needle", F.col("target") if prefix is None else F.when(F.contains("joined", F.col("target")), F.col("target")).otherwise(
        F.substring("target", 1, prefix)))
    a = a.withColumn("whole", F.col("needle") == F.col("target"))
    parts = F.expr("split(joined, concat('\\\\Q', needle, '\\\\E'))")
    a = a.select(*PAGE, "anchor", "whole", F.length("needle").alias("len"), F.posexplode(parts).alias("i", "part"))
    v = W.partitionBy(*PAGE, "anchor").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    last = F.max("i").over(W.partitionBy(*PAGE, "anchor"))
    a = a.withColumn("at", F.sum(F.length("part")).over(v) + F.col("i") * F.col("len")).withColumn("_last", last).where("i < _last")
    hit = a.select(*PAGE, "anchor", "whole", F.col("i").alias("hit"), "at", (F.col("at") + F.col("len")).alias("stop"))
    # a stretch of 256 characters is the join key, so a page's text spreads over its stretches
    step = 256
    bucket = lambda lo, hi: F.explode(F.sequence((F.floor(F.col(lo) / step)).cast("int"), (F.floor((F.col(hi) - 1) / step)).cast("int")))
    h = hit.withColumn("bk", bucket("at", "stop"))
    i = it.select(*PAGE, "lo", "hi", "x0", "y0", "x1", "y1").withColumn("bk", bucket("lo", "hi"))
    return (h.join(i, [*PAGE, "bk"]).where((F.col("lo") < F.col("stop")) & (F.col("at") < F.col("hi")))
            .groupBy(*PAGE, "anchor", "hit", "whole").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")))
