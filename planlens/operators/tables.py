"""Schedules, area tables and small grouped blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from planlens.functions import normalise as N, text as T, vocabulary as V
from planlens.operators.helpers import grid_join, sided

PAGE = ["set_id", "page"]
TABLE = [*PAGE, "table_id"]


def pick_schedules(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """Cells of the one table filed under each schedule name, with its header row.

    ``cells``: set_id, page, table_id, x0..y1 of the table, row, col, text. A table is a candidate
    when its first two rows carry a title of the fixed vocabulary and it is not the page frame;
    the earlier title wins, then the earlier page, then the smaller table.
    """
    titles = [(name, i, title) for name, ts in V.SCHEDULES for i, title in enumerate(ts)]
    top = (cells.where("row < 2").groupBy(*TABLE, "x0", "y0", "x1", "y1").agg(
        F.upper(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))),
                                         lambda c: c["text"]), " ")).alias("blob")))  # two rows of one table
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    sized = top.join(pages.select(*PAGE, (F.col("width") * F.col("height")).alias("page_area")), PAGE).withColumn(
        "area", area).where(F.col("area") <= V.TABLE_MAX_SHARE * F.col("page_area"))
    hits = F.array_compact(F.array(*[F.when(F.col("blob").contains(t), F.struct(
        F.lit(n).alias("schedule"), F.lit(i).alias("title_rank"))) for n, i, t in titles]))
    cand = sized.select(*TABLE, "area", F.explode(hits).alias("h")).select(*TABLE, "area", "h.*")
    best = cand.groupBy("set_id", "schedule").agg(F.min_by(F.struct("page", "table_id"), F.struct(
        "title_rank", "page", "area", "table_id")).alias("t")).select("set_id", "schedule", "t.*")
    chosen = cells.join(best, TABLE)
    filled = chosen.where("row < 3").groupBy("set_id", "schedule", "row").agg(
        F.count_if(F.trim("text") != "").alias("full"), F.count(F.lit(1)).alias("n"))
    head = filled.where(F.col("full") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2))).groupBy(
        "set_id", "schedule").agg(F.min("row").alias("head_row"))
    return chosen.join(head, ["set_id", "schedule"], "left").fillna(0, ["head_row"])


def schedule_rows(picked: DataFrame) -> DataFrame:
    """(set_id, schedule, page, row_no, mark, cells MAP) under the header row."""
    names = picked.where("row = head_row").select("set_id", "schedule", "col", F.col("text").alias("name"))
    body = picked.where("row > head_row").join(names, ["set_id", "schedule", "col"], "left")
    name = F.when(F.coalesce("name", F.lit("")) == "", F.concat(F.lit("col"), F.col("col").cast("string"))).otherwise(
        F.col("name"))
    item = F.struct("col", name.alias("k"), F.trim("text").alias("v"))
    rows = body.groupBy("set_id", "schedule", "page", F.col("row").alias("row_no")).agg(
        F.array_sort(F.collect_list(item)).alias("c"))  # the cells of one row
    first = F.array_distinct(F.transform("c", lambda x: x["k"]))
    return rows.where(F.exists("c", lambda x: x["v"] != "")).select(
        "set_id", "schedule", "page", "row_no", F.element_at("c", 1)["v"].alias("mark"),
        F.map_from_arrays(first, F.transform(first, lambda k: F.element_at(
            F.filter("c", lambda x: x["k"] == k), -1)["v"])).alias("cells"),
        F.transform("c", lambda x: x["v"]).alias("vals"))


def repair_header(headers: DataFrame, keys: list[str]) -> DataFrame:
    """Header cells that swallowed the first data row, split when at least half of them split.

    ``headers``: keys, col, text. Adds ``label`` and ``data``.
    """
    toks = T.words(F.col("text"))
    cut = F.array_min(F.filter(F.transform("toks", lambda t, i: F.when(
        (i > 0) & F.upper(t).rlike(V.HEADER_DATA), i)), lambda i: i.isNotNull()))
    h = headers.withColumn("toks", toks).withColumn("_cut", F.coalesce(cut, F.size("toks")))
    h = h.withColumn("_l", F.array_join(F.slice("toks", F.lit(1), F.col("_cut")), " ")).withColumn(
        "_d", F.array_join(F.slice("toks", F.col("_cut") + 1, F.size("toks")), " "))
    per = h.groupBy(*keys).agg(F.count_if(F.col("_d") != "").alias("_s"), F.count_if(F.trim("text") != "").alias("_p"))
    h = h.join(per, keys)
    fix = (F.col("_p") > 0) & (F.col("_s") >= F.col("_p") / 2)
    return h.withColumn("label", F.when(fix & (F.col("_l") != ""), F.col("_l")).otherwise(F.col("text"))).withColumn(
        "data", F.when(fix, F.col("_d"))).drop("toks", "_cut", "_l", "_d", "_s", "_p")


def repair_rows(rows: DataFrame) -> DataFrame:
    """Rows that merged several source rows, split where every filled cell splits into the same
    number of parts; other rows give nothing. ``rows``: ..., cells MAP<STRING,STRING>."""
    full = F.map_filter("cells", lambda k, v: v != "")
    parts = F.transform_values(F.col("_full"), lambda k, v: F.split(v, r"\s+"))
    sizes = F.array_distinct(F.transform(F.map_values("_parts"), lambda p: F.size(p)))
    r = rows.withColumn("_full", full).withColumn("_parts", parts).withColumn("_n", sizes)
    r = r.where((F.size("_n") == 1) & (F.element_at("_n", 1) >= 2))
    return (r.select("*", F.posexplode(F.sequence(F.lit(1), F.element_at("_n", 1))).alias("part", "_i"))
            .withColumn("cells", F.transform_values("_parts", lambda k, p: F.element_at(p, F.col("_i"))))
            .withColumn("mark", F.element_at(F.map_values("cells"), 1)).drop("_full", "_parts", "_n", "_i"))


def cell_num(cells: Column, key: Column) -> Column:
    """The number a named cell of a row carries."""
    t = F.regexp_replace(F.try_element_at(cells, key), ",", "")
    return T.rx(t, r"(-?\d+\.?\d*)", 1).try_cast("double")


def doors(rows: DataFrame) -> DataFrame:
    """Door rows by column position; the mark must end in two or three digits."""
    v = lambda i: F.coalesce(F.try_element_at("vals", F.lit(i)), F.lit(""))
    leaf = lambda c: F.coalesce(
        T.rx(c, r"(\d+)\s*'\s*-?\s*(\d+)", 1).cast("double") * 12 + T.rx(c, r"(\d+)\s*'\s*-?\s*(\d+)", 2).cast("double"),
        N.to_inches(c))
    last = lambda c: F.element_at(F.split(F.trim(c), r"\s+"), -1)
    d = rows.where("schedule = 'DOOR AND FRAME SCHEDULE'").withColumn("number", last(F.col("mark")))
    return d.where(F.col("number").rlike(r"^\d{2,3}[A-Z]?$")).select(
        "set_id", "page", "row_no", "number", last(v(2)).alias("style"), leaf(v(3)).alias("width_in"),
        leaf(v(4)).alias("height_in"), N.to_inches(v(5)).alias("thickness_in"), v(6).alias("material"),
        v(10).alias("hardware_set"), v(11).alias("remarks"), F.upper(v(2)).contains("EXISTING").alias("is_existing"))


#: column of an outdoor-air table -> test of its upper-case header; fixed values
VENT_COLUMNS = {
    "area_sf": lambda u: u.startswith("AREA") & ~u.contains("OUTDOOR"),
    "density": lambda u: u.contains("DENSITY") | u.contains("#/1000"),
    "rp": lambda u: u.contains("CFM/PERSON") | u.rlike(r"\bRP\b"),
    "ra": lambda u: u.contains("CFM/SQFT") | u.contains("CFM/SF") | u.rlike(r"\bRA\b"),
    "persons": lambda u: (u.contains("PERSONS") | (u == "PEOPLE")) & ~u.contains("CFM"),
    "total_cfm": lambda u: u.contains("TOTAL") & u.contains("CFM"),
}


def ventilation(cells: DataFrame) -> DataFrame:
    """Room rows of outdoor-air tables up to the TOTAL or NOTE row; ``is_total`` marks that row.

    ``cells``: set_id, page, table_id, row, col, text, head_row.
    """
    u = F.upper(F.trim("text"))
    head = cells.where("row = head_row")
    first = lambda test: F.min(F.when(test(u), F.col("col")))
    room = first(lambda x: x.isin("ROOM", "ZONE", "SPACE")).alias("c_room")
    at = head.groupBy(*TABLE).agg(room, *[first(t).alias(f"c_{k}") for k, t in VENT_COLUMNS.items()])
    body = cells.where("row > head_row").join(at.where(
        "c_room is not null and c_area_sf is not null and c_total_cfm is not null"), TABLE)
    number = F.when(F.regexp_replace(F.trim("text"), ",", "").rlike(r"^-?\d+\.?\d*$"),
                    F.regexp_replace(F.trim("text"), ",", "").cast("double"))
    pick = lambda k: F.max(F.when(F.col("col") == F.col(f"c_{k}"), number)).alias(k)
    rows = body.groupBy(*TABLE, "row").agg(
        F.max(F.when(F.col("col") == F.col("c_room"), F.trim("text"))).alias("room"), *[pick(k) for k in VENT_COLUMNS])
    name = F.upper(F.coalesce("room", F.lit("")))
    stop = (name == "") | name.startswith("TOTAL") | name.startswith("NOTE")
    w = W.partitionBy(*TABLE).orderBy("row")
    rows = rows.withColumn("_s", F.max(stop.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    prev = F.coalesce(F.lag("_s").over(w), F.lit(0))
    return rows.withColumn("is_total", name.startswith("TOTAL")).withColumn("_p", prev).where(
        (F.col("_s") == 0) | F.col("is_total")).drop("_s", "_p")


def area_tally(lines: DataFrame, sheets: DataFrame, scan: int | None = None) -> DataFrame:
    """The area table of each set: lines ``name number unit`` under a heading.

    A scan covers ``scan`` lines (None: all; the reference takes V.AREA_SCAN) and ends at the next heading or, once rows were met, at the third
    line in a row that is none. At least two rows; a stated total must match their sum. General
    pages first, then page order; the first reliable table of the set.
    """
    t = F.col("text")
    n = F.regexp_replace(T.rx(t, V.AREA_ROW, 2), ",", "").try_cast("double")
    w = W.partitionBy(*PAGE).orderBy("line_no")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    x = T.staged(lines, heading=F.upper(T.rx(t, V.AREA_HEADING, 1)),
                 label=F.trim(F.regexp_replace(T.rx(t, V.AREA_ROW, 1), r"\s+", " ")), sf=n)
    x = x.withColumn("blk", F.sum(F.when(F.col("heading").isNotNull(), 1).otherwise(0)).over(run)).where("blk > 0")
    b = W.partitionBy(*PAGE, "blk").orderBy("line_no")
    upto = b.rowsBetween(W.unboundedPreceding, 0)
    is_row = F.col("heading").isNull() & F.col("sf").isNotNull()
    good = is_row & F.col("sf").between(V.AREA_MIN_SF, V.AREA_MAX_SF)
    total = good & F.col("label").rlike(V.TOTAL_LABEL)
    x = (x.withColumn("_pos", F.row_number().over(b) - 1).withColumn("_row", is_row).withColumn("_total", total)
         .withColumn("_space", good & ~total).where(F.lit(True) if scan is None else F.col("_pos") <= scan)
         .withColumn("_since", F.sum(F.when(F.col("_row"), 1).otherwise(0)).over(upto))
         .withColumn("_rows", F.sum(F.when(F.col("_space"), 1).otherwise(0)).over(upto)))
    gap = W.partitionBy(*PAGE, "blk", "_since").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_gap", F.sum(F.when(~F.col("_row") & F.col("heading").isNull(), 1).otherwise(0)).over(gap))
    x = x.withColumn("_end", F.max(F.when((F.col("_gap") >= V.AREA_GAP) & (F.col("_rows") > 0), 1).otherwise(0)).over(upto))
    live = x.where("_end = 0")
    per = live.groupBy(*PAGE, "blk").agg(
        F.max("heading").alias("heading"), F.count_if("_space").alias("n_rows"),
        F.round(F.sum(F.when(F.col("_space"), F.col("sf"))), 2).alias("summed_sf"),
        F.min_by(F.when(F.col("_total"), F.col("sf")), F.when(F.col("_total"), F.col("line_no"))).alias("stated_total"))
    # the first table of a page with two rows or more is that page's table
    page = per.where("n_rows >= 2").groupBy(*PAGE).agg(
        F.min_by(F.struct("heading", "n_rows", "summed_sf", "stated_total"), "blk").alias("t")).select(*PAGE, "t.*")
    reliable = F.col("stated_total").isNull() | ((F.col("stated_total") > 0) & (
        F.abs(F.col("summed_sf") - F.col("stated_total")) <= V.AREA_TOTAL_TOL * F.col("stated_total")))
    late = sheets.select(*PAGE, (~F.coalesce("is_general_prefix", F.lit(False))).alias("_late"))
    best = F.min_by(F.struct("page", "heading", "n_rows", "summed_sf", "stated_total"), F.struct("_late", "page")).alias("t")
    return (page.where(reliable).join(late, PAGE).groupBy("set_id").agg(best).select("set_id", "t.*")
            .withColumn("total_sf", F.coalesce("stated_total", "summed_sf")))


def exit_blocks(pairs: DataFrame) -> DataFrame:
    """Rows under one EXIT heading as one exit: widths, capacity, load; later rows overwrite.

    ``pairs``: set_id, page, ord, label, values, context, box.
    """
    named = F.filter(F.transform("context", lambda c: T.rx(F.upper(F.trim(c)), V.EXIT_HEADING, 1)), lambda c: c.isNotNull())
    p = pairs.withColumn("exit", F.try_element_at(named, F.lit(1))).where("exit is not null and size(values) > 0")
    lab, raw = T.normal_label(F.col("label")), F.element_at("values", 1)
    kind = (F.when(lab.contains("WIDTH") & lab.contains("PROVIDED"), "wp").when(lab.contains("WIDTH") & lab.contains("REQUIRED"), "wr")
            .when(lab.contains("CAPACITY"), "cap").when(lab.isin("OCCUPANT LOAD", "OCCUPANTS", "OCCUPANTS SERVED"), "load"))
    p = T.staged(p, _k=kind, _in=N.inches(raw), _n=N.count(raw))
    last = lambda k, c: F.max_by(c, F.when(F.col("_k") == k, F.col("ord")))
    return p.groupBy(*PAGE, "exit").agg(
        last("wr", "_in").alias("width_required_in"), last("wp", "_in").alias("width_provided_in"),
        last("cap", "_n").alias("capacity"), last("load", "_n").alias("occupant_load"))


def occupancy_rows(pairs: DataFrame) -> DataFrame:
    """Rows of occupant-load tables, known by their column headers.

    ``pairs``: set_id, page, ord, label, values, headers, context, heading.
    """
    heads = F.transform("headers", T.normal_label)
    at = lambda test: F.array_min(F.filter(F.transform("_h", lambda h, i: F.when(test(h), i + 1)), lambda i: i.isNotNull()))
    p = pairs.withColumn("_h", heads)
    p = T.staged(p, _f=at(lambda h: h.contains("PER OCCUPANT") | h.contains("FACTOR")),
                 _l=at(lambda h: h.isin("OCCUPANT LOAD", "OCCUPANTS")), _u=at(lambda h: h.isin("USE", "FUNCTION", "OCCUPANCY")),
                 _a=at(lambda h: h.isin(V.AREA_HEADERS[:1] + ["AREA SF", "NET AREA", "GROSS AREA", "SF"])))
    p = p.where(F.col("_f").isNotNull() & F.col("_l").isNotNull() & ~T.normal_label(F.col("label")).isin("TOTAL", "TOTALS"))
    v = lambda c: F.when(F.col(c).isNotNull(), F.element_at("values", F.col(c)))
    ctx = F.upper(F.concat_ws(" ", F.array_join("context", " "), "heading"))
    code = F.when(ctx.rlike("FFPC|NFPA"), "FFPC").when(ctx.rlike(r"FBC|1004\.5"), "FBC").otherwise("")
    raw = F.trim(v("_f"))
    return p.select(
        *PAGE, "ord", F.trim("label").alias("space"), F.coalesce(F.trim(v("_u")), F.lit("")).alias("use"),
        N.area(v("_a")).alias("area_sf"), F.regexp_replace(T.rx(raw, V.OCCUPANCY_FACTOR, 1), ",", "").cast("double").alias("factor"),
        F.lower(F.regexp_extract(raw, V.OCCUPANCY_FACTOR, 2)).alias("basis"), N.count(v("_l")).alias("load"),
        code.alias("code"), F.concat("context", F.array("heading")).alias("context"))


def fixture_kind(word: Column) -> Column:
    w = F.trim(F.regexp_replace(F.upper(word), r"\.", ""))
    return (F.when(w.rlike("^(WC|WATER CLOSET)"), "wc").when(w.startswith("LAV"), "lav")
            .when(w.rlike("^(DF|DRINKING)"), "drinking_fountain").when(w.rlike("^(SERVICE|MOP)"), "service_sink")
            .otherwise("urinal"))


def fixture_block(segs: DataFrame) -> DataFrame:
    """Plumbing fixture facts of each set's first block: set_id, page, part, kind, male, female.

    ``part`` is ratio, required, provided, load, sinks or unisex. The ratio lines sit above the
    two count columns; a count belongs to the nearer column header.
    """
    up = F.upper(F.trim("text"))
    # everything of a page is decided where the page is: one exchange by page, then one of the few facts by set
    page = W.partitionBy(*PAGE)
    head = F.struct(F.col("seg_id").alias("hid"), F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("y0").alias("hy0"), F.col("h").alias("hh"))
    s = segs.where("set_id is not null and page is not null").withColumn("b", F.min(F.when(up.rlike(V.PLUMBING_HEADING), head)).over(page)).select("*", "b.*").where(
        (F.col("seg_id") != F.col("hid")) & F.col("x0").between(F.col("hx0") - 120, F.col("hx1") + 260)
        & (F.col("y0") > F.col("hy0")) & (F.col("y0") <= F.col("hy0") + 45 * F.greatest("hh", F.lit(1.0))))
    s = s.withColumn("t", up)
    col = lambda k: F.max(F.when(F.col("t").startswith(k), F.col("x0"))).over(page)
    s = s.withColumns({"rx": col("TOTAL REQUIRED"), "px": col("TOTAL PROVIDED"), "top": F.min(F.when(
        F.col("t").rlike("^TOTAL (REQUIRED|PROVIDED)"), F.col("y0"))).over(page)})
    above = F.col("top").isNull() | (F.col("y0") < F.col("top"))
    under = F.col("rx").isNotNull() & F.col("px").isNotNull() & (F.col("y0") > F.col("top"))
    # ratio lines read across: segments of one line joined left to right; a segment under the columns stands alone
    near = F.when(F.abs(F.col("rx") - F.col("x0")) <= F.abs(F.col("px") - F.col("x0")), "required").otherwise("provided")
    unit = s.where(above | under).withColumn("up", F.coalesce(above, F.lit(False))).groupBy(
        *PAGE, "up", F.when(F.col("up"), F.bround(F.col("yc") / F.greatest("h", F.lit(1.0)), 0)).alias("ln"), F.when(~F.col("up"), F.col("seg_id")).alias("alone"),
        F.when(~F.col("up"), near).alias("side"), F.when(~F.col("up"), F.col("t")).alias("own")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "t"))), lambda x: x["t"]), " ").alias("line"), F.count(F.lit(1)).alias("times"))
    num = lambda c: F.regexp_replace(c, ",", "").cast("double")
    none = F.lit(None).cast("double")
    word, body = T.rx(F.col("line"), V.FIXTURE_RATIO, 1), T.rx(F.col("line"), V.FIXTURE_RATIO, 2)
    per = lambda sex: T.rx(body, rf"1\s*/\s*(\d[\d,]*)\s*{sex}\b", 1)
    plain = T.rx(body, r"1\s*/\s*(\d[\d,]*)\s*(?!\d|,|MALE|FEMALE)", 1)
    n = T.rx(F.col("own"), V.FIXTURE_COUNT, 1).cast("double")

    def fact(when: Column, part: Column, kind: Column, male: Column, female: Column = none) -> Column:
        return F.when(when, F.struct(part.alias("part"), kind.alias("kind"), male.alias("male"), female.alias("female")))

    def single(part: str, pattern: str) -> Column:
        v = num(T.rx(F.col("line"), pattern, 1))
        return fact(F.col("up") & v.isNotNull(), F.lit(part), F.lit(part), v)

    unisex = F.lit("unisex")
    facts = F.array_compact(F.array(
        fact(F.col("up") & word.isNotNull(), F.lit("ratio"), fixture_kind(word), F.coalesce(num(per("MALE")), num(plain)), F.coalesce(num(per("FEMALE")), num(plain))),
        single("load", V.FIXTURE_LOAD), single("sinks", V.SERVICE_SINK),
        fact(n.isNotNull(), F.col("side"), fixture_kind(T.rx(F.col("own"), V.FIXTURE_COUNT, 3)), n * F.col("times")),
        fact(n.isNotNull() & (F.col("side") == "provided") & T.rx(F.col("own"), V.FIXTURE_COUNT, 2).isNotNull(), unisex, unisex, F.lit(1.0))))
    each = unit.select(*PAGE, "ln", F.explode(facts).alias("f")).select(*PAGE, "ln", "f.*")
    last = F.max_by(F.struct("male", "female"), F.when(F.col("part") == "load", -F.col("ln")).otherwise(F.col("ln")))
    every = each.groupBy(*PAGE, "part", "kind").agg(F.when(F.col("part").isin("required", "provided"), F.struct(F.sum("male").alias("male"), none.alias("female"))).when(
        F.col("part") == "unisex", F.struct(F.max("male").alias("male"), none.alias("female"))).otherwise(last).alias("v")).select(*PAGE, "part", "kind", "v.*")
    first = F.min(F.when(F.col("part").isin("ratio", "provided"), F.col("page"))).over(W.partitionBy("set_id"))
    return every.withColumn("_first", first).where("page = _first").drop("_first")


def ceiling_tags(segs: DataFrame, sheets: DataFrame) -> DataFrame:
    """Height tags on ceiling plans: a height with its reference above or below it, or on one line.

    ``sheets``: set_id, page, code, title.
    """
    plan = F.upper(F.coalesce("title", F.lit("")))
    rcp = sheets.where(plan.contains("CEILING") | plan.startswith("RCP")).select(*PAGE, "code")
    s = segs.join(rcp, PAGE).withColumn("t", F.upper(F.trim("text")))
    one = T.rx(F.col("t"), V.CEILING_ONE_LINE, 1)
    alone = s.withColumn("_one", one).where("_one is not null").select(
        *PAGE, "code", "seg_id", N.feet(F.col("_one")).alias("height_ft"), F.col("_one").alias("raw"),
        T.rx(F.col("t"), V.CEILING_ONE_LINE, 2).alias("reference"))
    cols = ["seg_id", "x0", "y0", "x1", "y1", "h", "t", "code"]
    high = sided(s.where(F.col("t").rlike(V.CEILING_HEIGHT)), "l_", PAGE, *cols)
    ref = sided(s.where(F.col("t").rlike(V.CEILING_REFERENCE)), "r_", PAGE, *cols)
    gap = F.least(F.abs(F.col("r_y0") - F.col("l_y1")), F.abs(F.col("l_y0") - F.col("r_y1")))
    ok = (gap <= 1.6 * F.greatest("l_h", "r_h")) & (F.least("l_x1", "r_x1") - F.greatest("l_x0", "r_x0") > 0)
    near = grid_join(high, ref, PAGE, ok & (F.col("l_seg_id") != F.col("r_seg_id")), pad_y=64.0)
    first = near.groupBy(*PAGE, F.col("l_code").alias("code"), F.col("l_seg_id").alias("seg_id"), F.col("l_t").alias("raw")).agg(
        F.min_by("r_t", "r_seg_id").alias("reference"))
    stacked = first.select(*PAGE, "code", "seg_id", N.feet(F.col("raw")).alias("height_ft"), "raw", "reference")
    return alone.unionByName(stacked).where("height_ft is not null")
