"""Registered queries: schedules, area tables, grouped blocks and spatial measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlens.operators import geometry as G, tables as TB
from planlens.plans.adapters import DUCK_LINES, lines
from planlens.plans.registry import ORACLE, query, table

BOX = ["x0", "y0", "x1", "y1"]


# ---- tables -------------------------------------------------------------------------------------

def table_cells(spark, d):
    """A two-column table per order: a title row, a header row and a row per line."""
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders")
    key, page = F.col("l_orderkey").alias("set_id"), F.lit(1).alias("page")
    titles = F.element_at(F.array(*map(F.lit, ("DOOR SCHEDULE", "ROOF TOP UNIT SCHEDULE", "LOAD CALCULATIONS", "FINISH PLAN"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    box = [F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("x1"), (50.0 + F.col("o_custkey") % 3000).alias("y1")]
    base = o.select(F.col("o_orderkey").alias("set_id"), F.lit(1).alias("page"), F.lit(7).alias("table_id"), *box, titles.alias("t"))
    rows = lambda r, a, b: base.select("set_id", "page", "table_id", *BOX, F.lit(r).alias("row"), F.posexplode(F.array(a, b)).alias("col", "text"))
    head = rows(0, F.col("t"), F.lit("")).unionByName(rows(1, F.lit("MARK"), F.lit("SIZE")))
    body = li.groupBy(key, "l_linenumber").agg(F.max("l_quantity").alias("q")).join(base, "set_id").select(
        "set_id", "page", "table_id", *BOX, (F.col("l_linenumber") + 1).alias("row"),
        F.posexplode(F.array(F.concat(F.lit("M"), F.col("l_linenumber").cast("string")), F.col("q").cast("int").cast("string"))).alias("col", "text"))
    pages = base.select("set_id", "page", F.lit(500.0).alias("width"), F.lit(1000.0).alias("height"))
    return head.unionByName(body), pages


PICKED = """WITH p AS (SELECT o_orderkey AS set_id, CASE o_custkey % 4 WHEN 0 THEN 'DOOR AND FRAME SCHEDULE' WHEN 1 THEN 'ROOF TOP UNIT SCHEDULE'
  ELSE 'ELECTRICAL LOAD CALCULATIONS' END AS schedule FROM orders WHERE o_custkey % 4 <> 3 AND 100 * (50 + o_custkey % 3000) <= 150000),
m AS (SELECT l_orderkey AS set_id, l_linenumber AS ln, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
"""


@query("tbl_schedule_pick", PICKED + """SELECT p.set_id, schedule, CAST(ln + 1 AS INTEGER) AS row_no, 'M' || CAST(ln AS VARCHAR) AS mark,
  CAST(CAST(q AS INTEGER) AS VARCHAR) AS size FROM p JOIN m ON m.set_id = p.set_id""")
def tbl_schedule_pick(spark, d):
    r = TB.schedule_rows(TB.pick_schedules(*table_cells(spark, d)))
    return r.select("set_id", "schedule", "row_no", "mark", F.col("cells")["SIZE"].alias("size"))


@query("tbl_row_number", PICKED + "SELECT p.set_id, sum(CAST(CAST(q AS INTEGER) AS DOUBLE)) AS total FROM p JOIN m ON m.set_id = p.set_id GROUP BY p.set_id")
def tbl_row_number(spark, d):
    r = TB.schedule_rows(TB.pick_schedules(*table_cells(spark, d)))
    return r.groupBy("set_id").agg(F.sum(TB.cell_num(F.col("cells"), F.lit("SIZE"))).alias("total"))


@query("tbl_header_repair", """
SELECT o_orderkey AS set_id, 'WIDTH' AS label, CASE WHEN o_orderstatus = 'F' THEN '32"' ELSE '' END AS data FROM orders WHERE o_orderstatus IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'MARK', CASE WHEN o_orderstatus = 'F' THEN '101' ELSE '' END FROM orders WHERE o_orderstatus IN ('F', 'O')
UNION ALL SELECT o_orderkey, CASE WHEN i = 0 THEN 'MARK 7' ELSE 'NOTE' END, NULL FROM orders, (VALUES (0), (1), (2)) t(i) WHERE o_orderstatus = 'P'""")
def tbl_header_repair(spark, d):
    o = table(spark, d, "orders")
    st = F.col("o_orderstatus")
    heads = (F.when(st == "F", F.array(F.lit('WIDTH 32"'), F.lit("MARK 101"))).when(st == "O", F.array(F.lit("WIDTH"), F.lit("MARK")))
             .otherwise(F.array(F.lit("MARK 7"), F.lit("NOTE"), F.lit("NOTE"))))
    h = o.select(F.col("o_orderkey").alias("set_id"), "o_orderstatus", F.posexplode(heads).alias("col", "text"))
    out = TB.repair_header(h, ["set_id"])
    plain = F.when((F.col("o_orderstatus") == "O"), F.coalesce("data", F.lit(""))).otherwise(F.col("data"))
    return out.select("set_id", "label", plain.alias("data"))


@query("tbl_row_repair", """
SELECT o_orderkey AS set_id, CAST(i AS INTEGER) AS part, CASE i WHEN 0 THEN 'RECEPTION' ELSE 'STUDIO' END AS mark,
  CASE i WHEN 0 THEN '164' ELSE CAST(o_custkey AS VARCHAR) END AS area FROM orders, (VALUES (0), (1)) t(i) WHERE o_orderstatus = 'F'""")
def tbl_row_repair(spark, d):
    o = table(spark, d, "orders")
    both = F.concat(F.lit("164 "), F.col("o_custkey").cast("string"))
    area = F.when(F.col("o_orderstatus") == "F", both).when(F.col("o_orderstatus") == "O", "1 2 3").otherwise("9")
    rows = o.select(F.col("o_orderkey").alias("set_id"), F.create_map(F.lit("ROOM"), F.lit("RECEPTION STUDIO"), F.lit("AREA"), area, F.lit("NOTE"), F.lit("")).alias("cells"))
    return TB.repair_rows(rows).select("set_id", "part", "mark", F.col("cells")["AREA"].alias("area"))


@query("tbl_doors", """SELECT l_orderkey AS set_id, CAST(100 + l_linenumber AS VARCHAR) AS number, CAST(floor(l_quantity / 12) * 12 + floor(l_quantity) % 12 AS DOUBLE) AS width_in,
  l_returnflag = 'R' AS is_existing, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL""")
def tbl_doors(spark, d):
    li = table(spark, d, "lineitem")
    q = F.floor("l_quantity")
    size = F.concat(F.floor(q / 12).cast("string"), F.lit("'-"), (q % 12).cast("string"), F.lit('"'))
    mark = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("DOOR "), (100 + F.col("l_linenumber")).cast("string"))).otherwise("NOTE")
    vals = F.array(mark, F.when(F.col("l_returnflag") == "R", "EXISTING").otherwise("TYPE A"), size, F.lit("7'-0\""), F.lit('1 3/4"'))
    rows = li.select(F.col("l_orderkey").alias("set_id"), F.lit(0).alias("page"), F.xxhash64(*li.columns).alias("row_no"), F.lit("DOOR AND FRAME SCHEDULE").alias("schedule"),
                     mark.alias("mark"), vals.alias("vals"))
    return TB.doors(rows).groupBy("set_id", "number", "width_in", "is_existing").agg(F.count(F.lit(1)).alias("n"))


@query("tbl_ventilation", """
WITH m AS (SELECT l_orderkey AS set_id, l_linenumber AS ln, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
s AS (SELECT *, ln > coalesce((SELECT min(ln) FROM m x WHERE x.set_id = m.set_id AND x.q < 5), 99) AS cut FROM m)
SELECT set_id, CAST(ln AS INTEGER) AS row, CASE WHEN q < 5 THEN 'TOTAL' ELSE 'ROOM ' || CAST(ln AS VARCHAR) END AS room, q AS area_sf, q * 2 AS total_cfm, q < 5 AS is_total
FROM s WHERE NOT cut OR q < 5""")
def tbl_ventilation(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("row")).agg(F.max("l_quantity").alias("q"))
    room = F.when(F.col("q") < 5, "TOTAL").otherwise(F.concat(F.lit("ROOM "), F.col("row").cast("string")))
    cells = lambda df, r, *v: df.select("set_id", F.lit(0).alias("page"), F.lit(1).alias("table_id"), r.alias("row"), F.lit(0).alias("head_row"), F.posexplode(F.array(*v)).alias("col", "text"))
    head = cells(m.select("set_id").distinct(), F.lit(0), F.lit("ROOM"), F.lit("AREA (SF)"), F.lit("TOTAL CFM"))
    body = cells(m, F.col("row"), room, F.col("q").cast("string"), (F.col("q") * 2).cast("string"))
    return TB.ventilation(head.unionByName(body)).select("set_id", "row", "room", "area_sf", "total_cfm", "is_total")


AREA_LINES = DUCK_LINES + """,
t AS (SELECT set_id, page, line_no, length(text) AS n FROM a_lines),
b AS (SELECT *, line_no // 6 AS blk, line_no % 6 AS k FROM t)
"""


def area_lines(spark, d):
    n, k = F.length("text"), F.col("line_no") % 6
    text = (F.when(k == 0, "AREA CALCULATIONS").when(k == 4, F.concat(F.lit("TOTAL "), (n % 7 * 100).cast("string"), F.lit(" SF"))).when(
        k == 5, "see plan").otherwise(F.concat(F.lit("ROOM A "), (n % 900 + 5).cast("string"), F.lit(" SQ. FT."))))
    return lines(spark, d).withColumn("text", text)


@query("tbl_area_tally", AREA_LINES + """,
g AS (SELECT set_id, page, blk, count(*) FILTER (WHERE k IN (1, 2, 3)) AS n_rows, sum(CASE WHEN k IN (1, 2, 3) THEN n % 900 + 5 END) AS s,
        max(CASE WHEN k = 4 AND n % 7 * 100 >= 5 THEN n % 7 * 100 END) AS total FROM b GROUP BY set_id, page, blk),
p AS (SELECT set_id, page, arg_min(ROW(n_rows, s, total), blk) AS r FROM g WHERE n_rows >= 2 GROUP BY set_id, page),
q AS (SELECT set_id, page, r[1] AS n_rows, r[2] AS s, r[3] AS total FROM p),
ok AS (SELECT * FROM q WHERE total IS NULL OR abs(s - total) <= 0.02 * total)
SELECT set_id, min(page) AS page, arg_min(n_rows, page) AS n_rows, CAST(arg_min(s, page) AS DOUBLE) AS summed_sf FROM ok GROUP BY set_id""")
def tbl_area_tally(spark, d):
    ln = area_lines(spark, d)
    sheets = ln.select("set_id", "page").distinct().withColumn("is_general_prefix", F.lit(False))
    return TB.area_tally(ln, sheets).select("set_id", "page", "n_rows", "summed_sf")


def exit_pairs(spark, d):
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    label = F.when(n == 1, "WIDTH PROVIDED").when(n == 2, "WIDTH REQUIRED").when(n == 3, "OCCUPANT CAPACITY").when(n == 4, "OCCUPANT LOAD").otherwise("NOTES")
    raw = F.when(n <= 2, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit('"'))).otherwise(F.col("l_quantity").cast("int").cast("string"))
    return li.select(F.col("l_orderkey").alias("set_id"), F.lit(0).alias("page"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("ord"), label.alias("label"),
                     F.array(raw).alias("values"), F.array(F.concat(F.lit("exit discharge "), (F.col("l_suppkey") % 2).cast("string"), F.lit(":"))).alias("context"))


@query("tbl_exit_blocks", """
SELECT l_orderkey AS set_id, 'EXIT DISCHARGE ' || CAST(l_suppkey % 2 AS VARCHAR) AS exit,
  arg_max(floor(l_quantity), l_partkey * 1000000 + l_suppkey) FILTER (WHERE l_linenumber = 1) AS width_provided_in,
  arg_max(floor(l_quantity), l_partkey * 1000000 + l_suppkey) FILTER (WHERE l_linenumber = 3) AS capacity,
  arg_max(floor(l_quantity), l_partkey * 1000000 + l_suppkey) FILTER (WHERE l_linenumber = 4) AS occupant_load FROM lineitem GROUP BY ALL""")
def tbl_exit_blocks(spark, d):
    return TB.exit_blocks(exit_pairs(spark, d)).select("set_id", "exit", "width_provided_in", "capacity", "occupant_load")


@query("tbl_occupancy_rows", """
SELECT l_orderkey AS set_id, 'ROOM ' || CAST(l_linenumber AS VARCHAR) AS space, floor(l_quantity) * 10 AS area_sf, CASE l_returnflag WHEN 'A' THEN 15 ELSE 150 END::DOUBLE AS factor,
  CASE l_returnflag WHEN 'A' THEN 'net' ELSE 'gross' END AS basis, floor(l_quantity) AS load, CASE l_linestatus WHEN 'F' THEN 'FFPC' ELSE 'FBC' END AS code, count(*) AS n
FROM lineitem WHERE l_returnflag <> 'N' AND floor(l_quantity) * 10 >= 20 GROUP BY ALL UNION ALL
SELECT l_orderkey, 'ROOM ' || CAST(l_linenumber AS VARCHAR), NULL, CASE l_returnflag WHEN 'A' THEN 15 ELSE 150 END, CASE l_returnflag WHEN 'A' THEN 'net' ELSE 'gross' END, floor(l_quantity),
  CASE l_linestatus WHEN 'F' THEN 'FFPC' ELSE 'FBC' END, count(*) FROM lineitem WHERE l_returnflag <> 'N' AND floor(l_quantity) * 10 < 20 GROUP BY ALL""")
def tbl_occupancy_rows(spark, d):
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    heads = F.when(F.col("l_returnflag") == "N", F.array(F.lit("AREA"), F.lit("NOTE"))).otherwise(F.array(*map(F.lit, ("USE", "AREA (SF)", "AREA PER OCCUPANT", "OCCUPANT LOAD:"))))
    vals = F.array(F.lit("ASSEMBLY"), F.concat((q * 10).cast("string"), F.lit(" SF")), F.when(F.col("l_returnflag") == "A", "15 (NET)").otherwise("150 SF (GROSS)"), q.cast("string"))
    p = li.select(F.col("l_orderkey").alias("set_id"), F.lit(0).alias("page"), F.xxhash64(*li.columns).alias("ord"), F.concat(F.lit("ROOM "), F.col("l_linenumber").cast("string")).alias("label"),
                  vals.alias("values"), heads.alias("headers"), F.array(F.when(F.col("l_linestatus") == "F", "PER NFPA 101").otherwise("PER FBC")).alias("context"), F.lit("").alias("heading"))
    o = TB.occupancy_rows(p)
    return o.groupBy("set_id", "space", "area_sf", "factor", "basis", "load", "code").agg(F.count(F.lit(1)).alias("n"))


def stack(spark, d, texts, key="o_orderkey"):
    """A column of segments per order, ten points apart."""
    o = table(spark, d, "orders")
    s = o.select(F.col(key).alias("set_id"), "o_custkey", "o_orderstatus", F.lit(0).alias("page"), F.posexplode(F.array(*texts)).alias("i", "text"))
    return s.where("text is not null").withColumn("seg_id", F.col("i") + 1).withColumn("x0", F.lit(0.0)).withColumn("y0", F.col("i") * 12.0).withColumn("x1", F.lit(80.0)).withColumn(
        "y1", F.col("i") * 12.0 + 10).withColumn("h", F.lit(10.0)).withColumn("yc", F.col("i") * 12.0 + 5)


@query("tbl_fixture_block", """
SELECT o_orderkey AS set_id, part, kind, male FROM orders, (VALUES ('ratio', 'wc', 125.0::DOUBLE), ('ratio', 'lav', 200.0), ('ratio', 'drinking_fountain', 500.0), ('sinks', 'sinks', 1.0),
  ('load', 'load', NULL)) t(part, kind, male) WHERE part <> 'load' UNION ALL SELECT o_orderkey, 'load', 'load', CAST(o_custkey + 1 AS DOUBLE) FROM orders""")
def tbl_fixture_block(spark, d):
    s = stack(spark, d, [F.lit("PLUMBING COUNTS"), F.concat(F.lit("ASSEMBLY OCCUPANCY: "), (F.col("o_custkey") + 1).cast("string")), F.lit("WC: 1/125 MALE, 1/65 FEMALE"),
                         F.lit("LAV: 1/200"), F.lit("DF: 1/500"), F.lit("SERVICE SINK: 1")])
    return TB.fixture_block(s).select("set_id", "part", "kind", "male")


@query("tbl_ceiling_tags", """
SELECT o_orderkey AS set_id, CAST(8 + o_custkey % 5 AS DOUBLE) + 0.5 AS height_ft, 'A.F.F.' AS reference FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, 14.0, 'B/O BAR JOIST' FROM orders""")
def tbl_ceiling_tags(spark, d):
    tag = F.concat(F.lit("+"), (8 + F.col("o_custkey") % 5).cast("string"), F.lit("'-6\""))
    s = stack(spark, d, [F.when(F.col("o_orderstatus") != "P", F.lit("A.F.F.")), tag, F.lit("SEE NOTE"), F.lit("SEE NOTE 2"), F.lit("B/O BAR JOIST"), F.lit("+14'-0\"")])
    sheets = s.select("set_id", "page").distinct().withColumn("code", F.lit("A-6")).withColumn("title", F.lit("Reflected ceiling plan"))
    return TB.ceiling_tags(s, sheets).select("set_id", "height_ft", "reference")


# ---- geometry -------------------------------------------------------------------------------------

@query("geo_scale_labels", DUCK_LINES + """
SELECT set_id, page, line_no, CASE length(text) % 4 WHEN 0 THEN 18.0 WHEN 1 THEN 108.0 ELSE 72.0 END::DOUBLE AS pt_per_ft FROM a_lines WHERE length(text) % 4 < 3""")
def geo_scale_labels(spark, d):
    n = F.length("text") % 4
    t = F.when(n == 0, "PLAN 1/4\" = 1'-0\"").when(n == 1, "DETAIL: 1 1/2\" = 1' - 0\"").when(n == 2, "1\"=1'-0\" TYP").otherwise("\" = 1'-0\"")
    return G.scale_labels(lines(spark, d).withColumn("text", t)).select("set_id", "page", "line_no", "pt_per_ft")


def paths(spark, d):
    """Embedding fours as linework boxes on the pages of a label's set, kept near a grid point."""
    e = table(spark, d, "embeddings")
    at = lambda i: F.expr(f"element_at(embedding, CAST(g * 4 + {i} AS INT))").cast("double")
    base = e.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("ox", (F.col("vec_id") % 3) * 300.0 + 100).withColumn("oy", (F.col("g") % 2) * 350.0 + 100)
    return base.select(F.col("label").cast("bigint").alias("set_id"), (F.col("vec_id") % 20).cast("int").alias("page"), (F.col("vec_id") * 16 + F.col("g")).alias("ent"),
                       (F.col("ox") + F.least(at(1), at(3)) * 200).alias("x0"), (F.col("oy") + F.least(at(2), at(4)) * 200).alias("y0"),
                       (F.col("ox") + F.greatest(at(1), at(3)) * 200).alias("x1"), (F.col("oy") + F.greatest(at(2), at(4)) * 200).alias("y1"))


def sized(df, w=1200.0, h=900.0):
    return df.select("set_id", "page").distinct().select("*", F.lit(w).alias("width"), F.lit(h).alias("height"))


@query("geo_views")
def geo_views(spark, d):
    p = paths(spark, d)
    return G.views(p, sized(p))


def set_views(spark, d):
    """Three fixed views on every order's page and a label per line near one of them."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("set_id"), F.lit(0).alias("page"), F.explode(F.array(*[F.struct(
        F.lit(i).alias("view"), F.lit(x).alias("x0"), F.lit(0.0).alias("y0"), F.lit(x + 200.0).alias("x1"), F.lit(200.0).alias("y1"), F.lit(sc).alias("scale"))
        for i, x, sc in ((1, 0.0, 18.0), (2, 205.0, 36.0), (3, 500.0, 108.0))])).alias("v")).select("set_id", "page", "v.*")
    li = table(spark, d, "lineitem")
    boxes = li.select(F.col("l_orderkey").alias("set_id"), F.lit(0).alias("page"), F.xxhash64(*li.columns).alias("label_id"), (F.col("l_suppkey") % 8 * 100.0).alias("x0"),
                      (F.col("l_quantity") * 8).alias("y0"), (F.col("l_suppkey") % 8 * 100.0 + 60).alias("x1"), (F.col("l_quantity") * 8 + 10).alias("y1"), "l_partkey")
    return o, boxes


OWNED = """WITH v(view, x0, x1) AS (VALUES (1, 0.0::DOUBLE, 200.0::DOUBLE), (2, 205.0, 405.0), (3, 500.0, 700.0)),
b AS (SELECT l_orderkey AS set_id, l_partkey, l_extendedprice AS px, (l_suppkey % 8) * 100.0::DOUBLE AS x0, l_quantity * 8 AS y0, (l_suppkey % 8) * 100.0::DOUBLE + 60 AS x1, l_quantity * 8 + 10 AS y1 FROM lineitem),
j AS (SELECT b.*, v.view, v.x0 AS vx0, v.x1 AS vx1, b.x0 >= v.x0 - 2 AND b.x1 <= v.x1 + 2 AND b.y1 <= 202 AS inside, 200 <= b.y0 + 12 AND v.x0 <= b.x1 AND b.x0 <= v.x1 AS up,
        b.y0 - 200 AS ud, sqrt(greatest(b.x0 - v.x1, v.x0 - b.x1, 0) ** 2 + greatest(b.y0 - 200, 0) ** 2) AS nd, b.x0 <= v.x1 AND v.x0 <= b.x1 AND b.y0 <= 200 AS touch FROM b, v)
"""


@query("geo_label_owner", OWNED + """,
g AS (SELECT set_id, l_partkey, px, x0, y0, count(*) FILTER (WHERE inside) AS n_in, min(view) FILTER (WHERE inside) AS v_in, list(ROW(ud, view) ORDER BY ud, view) FILTER (WHERE up) AS ups,
        list(ROW(nd, view) ORDER BY nd, view) AS nears FROM j GROUP BY ALL)
SELECT set_id, CASE WHEN n_in = 1 THEN v_in WHEN n_in > 1 THEN NULL WHEN len(ups) > 0 THEN CASE WHEN (len(ups) = 1 OR ups[2][1] - ups[1][1] > 12) AND ups[1][1] <= 96 THEN ups[1][2] END
  ELSE CASE WHEN nears[2][1] - nears[1][1] > 12 AND nears[1][1] <= 96 THEN nears[1][2] END END AS view, count(*) AS n FROM g GROUP BY ALL""")
def geo_label_owner(spark, d):
    v, b = set_views(spark, d)
    return G.label_owner(b, v).groupBy("set_id", "view").agg(F.count(F.lit(1)).alias("n"))


@query("geo_scale_for", OWNED + """,
g AS (SELECT set_id, l_partkey, px, x0, y0, count(*) FILTER (WHERE inside) AS n_in, min(CASE view WHEN 1 THEN 18.0 WHEN 2 THEN 36.0 ELSE 108.0 END::DOUBLE) FILTER (WHERE inside) AS sc,
        count(*) FILTER (WHERE touch) AS nt FROM j GROUP BY ALL)
SELECT set_id, CASE WHEN n_in = 1 THEN sc END AS scale, CASE WHEN n_in = 1 THEN '' WHEN nt > 1 THEN 'spans several views' WHEN nt = 1 THEN 'runs outside its view' ELSE 'outside every view' END AS why,
  count(*) AS n FROM g GROUP BY ALL""")
def geo_scale_for(spark, d):
    v, b = set_views(spark, d)
    none = v.select("set_id", "page").distinct().withColumn("scale", F.lit(None).cast("double"))
    return G.scale_for(b.withColumnRenamed("label_id", "box_id"), v, none).groupBy("set_id", "scale", "why").agg(F.count(F.lit(1)).alias("n"))


@query("geo_scale_resolve", """
WITH l AS (SELECT l_orderkey AS set_id, count(DISTINCT CASE WHEN l_quantity < 45 THEN 18 ELSE 36 END) AS n, min(CASE WHEN l_quantity < 45 THEN 18 ELSE 36 END) AS s,
             bool_or(l_returnflag = 'R' AND l_quantity < 45) AS v18, bool_or(l_returnflag = 'R' AND l_quantity >= 45) AS v36 FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS set_id, CASE WHEN n = 1 THEN s END::DOUBLE AS scale, CASE WHEN n = 1 THEN CASE WHEN (s = 18 AND v18) OR (s = 36 AND v36) THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence
FROM orders LEFT JOIN l ON l.set_id = o_orderkey""")
def geo_scale_resolve(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.lit(0).alias("page"), F.when(F.col("l_quantity") < 45, 18.0).otherwise(36.0).alias("pt_per_ft"), "l_returnflag")
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("set_id"), F.lit(0).alias("page"))
    return G.resolve_scale(li, li.where("l_returnflag = 'R'"), pages).select("set_id", "scale", "confidence")


@query("geo_egress_runs", """
WITH p AS (SELECT l_orderkey AS set_id, l_linenumber % 2 AS page, l_suppkey % 3 AS slot, 48 + l_quantity AS w, 40 + l_linenumber AS h,
             CASE l_partkey % 7 WHEN 0 THEN 'rect' WHEN 1 THEN 'rect' WHEN 2 THEN 'line' WHEN 3 THEN 'curve' END AS kind,
             CASE WHEN l_tax > 0.02 THEN CASE WHEN l_quantity < 25 THEN 18.0 ELSE 9.0 END END AS pt FROM lineitem),
t AS (SELECT set_id, min(page) AS page FROM p WHERE kind IS NOT NULL GROUP BY set_id),
e AS (SELECT set_id, page, sum(CASE kind WHEN 'rect' THEN 4 WHEN 'line' THEN 1 ELSE 0 END) AS segs,
        max(greatest(w, CASE WHEN kind = 'rect' THEN h ELSE 0 END)) FILTER (WHERE kind <> 'curve') AS run,
        count(DISTINCT slot) FILTER (WHERE kind <> 'curve') AS slots, min(slot) FILTER (WHERE kind <> 'curve') AS slot
      FROM p JOIN t USING (set_id, page) WHERE kind IS NOT NULL GROUP BY set_id, page),
l AS (SELECT set_id, page, count(DISTINCT pt) AS n, min(pt) AS pt FROM p GROUP BY set_id, page),
v AS (SELECT set_id, page, slot, count(DISTINCT pt) AS n, min(pt) AS pt FROM p GROUP BY set_id, page, slot),
s AS (SELECT e.*, l.n AS ln, CASE WHEN segs > 0 THEN CASE WHEN l.n = 1 THEN l.pt WHEN l.n > 1 AND slots = 1 AND v.n = 1 THEN v.pt END END AS scale
      FROM e JOIN l USING (set_id, page) LEFT JOIN v ON v.set_id = e.set_id AND v.page = e.page AND v.slot = e.slot)
SELECT set_id, CAST(page AS INTEGER) AS g_page, CAST(segs AS BIGINT) AS g_segments, CAST(run AS DOUBLE) AS g_run_pt, CAST(scale AS DOUBLE) AS g_scale,
  CASE WHEN segs = 0 OR scale IS NOT NULL THEN '' WHEN ln = 0 THEN 'the page has no scale and no views' WHEN slots > 1 THEN 'spans several views' ELSE 'its view has no scale' END AS g_why
FROM s""")
def geo_egress_runs(spark, d):
    """Every line a room on its order's page, in one of three plans, with its walls, an egress path and a printed scale."""
    li = table(spark, d, "lineitem")
    li = li.select(
        F.col("l_orderkey").alias("set_id"), (F.col("l_linenumber") % 2).cast("int").alias("page"), F.xxhash64(*li.columns).alias("seg_id"),
        (F.col("l_suppkey") % 3 * 400.0).alias("x0"), F.lit(0.0).alias("y0"), (48.0 + F.col("l_quantity")).cast("double").alias("w"),
        (40.0 + F.col("l_linenumber")).cast("double").alias("y1"), "l_partkey", "l_quantity", "l_tax").withColumn("x1", F.col("x0") + F.col("w"))
    room = li.select("set_id", "page", F.lit("A-WALL").alias("layer"), F.lit("rect").alias("kind"), "x0", "y0", "x1", "y1")
    part = F.col("l_partkey") % 7
    kind = F.when(part < 2, "rect").when(part == 2, "line").when(part == 3, "curve")
    line = F.col("kind") == "line"
    way = li.withColumn("kind", kind).where("kind is not null").select(
        "set_id", "page", F.lit("L-EGRESS PATH").alias("layer"), "kind", "x0", F.when(line, 20.0).otherwise(F.col("y0")).alias("y0"), "x1",
        F.when(line, 20.0).otherwise(F.col("y1")).alias("y1"))
    scale = F.when(F.col("l_quantity") < 25, "SCALE: 1/4\" = 1'-0\"").otherwise("SCALE: 1/8\" = 1'-0\"")
    texts = li.where("l_tax > 0.02").select("set_id", "page", "seg_id", scale.alias("text"), (F.col("x0") + 5).alias("x0"), F.lit(5.0).alias("y0"),
                                            (F.col("x0") + 40).alias("x1"), F.lit(15.0).alias("y1"))
    pages = li.select("set_id", "page").distinct().select("*", F.lit(1224.0).alias("width"), F.lit(792.0).alias("height"))
    return G.egress_runs(room.unionByName(way), texts, pages).drop("g_sheet")


@query("geo_longest_run", """
WITH s AS (SELECT l_suppkey AS set_id, l_linenumber AS a_, l_quantity * 7 AS lo, l_quantity * 7 + 6 AS hi FROM lineitem),
f AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY set_id, a_ ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS b FROM s),
g AS (SELECT *, sum(b) OVER (PARTITION BY set_id, a_ ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT set_id, max(r) AS run_pt FROM (SELECT set_id, a_, i, max(hi) - min(lo) AS r FROM g GROUP BY ALL) GROUP BY set_id""")
def geo_longest_run(spark, d):
    seg = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("set_id"), (F.col("l_quantity") * 7).alias("x0"), F.col("l_linenumber").cast("double").alias("y0"),
                                             (F.col("l_quantity") * 7 + 6).alias("x1"), F.col("l_linenumber").cast("double").alias("y1"))
    return G.longest_run(seg, ["set_id"])


def points(c="embedding"):
    return F.transform(F.sequence(F.lit(1), F.lit(63), F.lit(2)), lambda i: F.struct(
        F.element_at(c, i).cast("double").alias("x"), F.element_at(c, i + 1).cast("double").alias("y")))


_PTS = "WITH p AS (SELECT vec_id, label, list_transform(range(1, 65, 2), lambda i: CAST(embedding[i] AS DOUBLE)) AS xs, list_transform(range(2, 65, 2), lambda i: CAST(embedding[i] AS DOUBLE)) AS ys FROM embeddings)"


@query("geo_polyline", _PTS + """
SELECT vec_id, round(list_sum(list_transform(range(1, 32), lambda i: sqrt((xs[i + 1] - xs[i]) ** 2 + (ys[i + 1] - ys[i]) ** 2))) / 18.0, 6) AS feet FROM p""")
def geo_polyline(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(G.polyline_length(points(), F.lit(18.0)), 6).alias("feet"))


@query("geo_polygon_area", _PTS + """
SELECT vec_id, round_even(round(abs(list_sum(list_transform(range(1, 33), lambda i: 40000 * (xs[i] * ys[i % 32 + 1] - xs[i % 32 + 1] * ys[i])))) / 2 / 144.0, 9), 1) AS area_sf FROM p
WHERE abs(list_sum(list_transform(range(1, 33), lambda i: 40000 * (xs[i] * ys[i % 32 + 1] - xs[i % 32 + 1] * ys[i])))) / 2 / 144.0 >= 1""")
def geo_polygon_area(spark, d):
    e = table(spark, d, "embeddings")
    pts = F.transform(points(), lambda p: F.struct((p["x"] * 200).alias("x"), (p["y"] * 200).alias("y")))
    o = e.select(F.col("vec_id").alias("set_id"), F.lit("H").alias("handle"), F.lit("A-AREA").alias("layer"), F.lit(True).alias("closed"), F.lit(False).alias("has_arc"), pts.alias("points"))
    w = e.select(F.col("vec_id").alias("set_id"), F.lit(0).alias("page"), F.lit("V").alias("viewport"), F.lit(-1e6).alias("wx0"), F.lit(-1e6).alias("wy0"), F.lit(1e6).alias("wx1"), F.lit(1e6).alias("wy1"))
    return G.polygon_area(o, w, 1.0).select(F.col("set_id").alias("vec_id"), "area_sf")


@query("geo_dimension_check", """
SELECT l_orderkey AS set_id, CAST(l_linenumber AS VARCHAR) AS handle, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_partkey, l_suppkey) AS printed, max(l_quantity) * 0.5::DOUBLE AS shown,
  max(CASE l_returnflag WHEN 'R' THEN '12''' WHEN 'A' THEN '<> TYP' ELSE '' END) = '12''' AND NOT bool_or(l_returnflag = 'A') AS overridden FROM lineitem GROUP BY ALL""")
def geo_dimension_check(spark, d):
    li = table(spark, d, "lineitem")
    dims = li.select(F.col("l_orderkey").alias("set_id"), F.lit(0).alias("page"), F.col("l_linenumber").cast("string").alias("handle"), F.lit("V").alias("viewport"),
                     (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("seq"), F.col("l_partkey").cast("string").alias("text"), F.col("l_quantity").alias("measured"), F.lit(0.5).alias("factor"),
                     F.when(F.col("l_returnflag") == "R", "12'").when(F.col("l_returnflag") == "A", "<> TYP").otherwise("").alias("override"))
    return G.dimension_check(dims).select("set_id", "handle", "printed", "shown", "overridden")


@query("geo_framed_count", """
WITH e AS (SELECT l_suppkey AS set_id, l_quantity * 20 AS x0, CAST(l_linenumber AS DOUBLE) * 50 AS y0, l_returnflag <> 'N' AS plots FROM lineitem),
w AS (SELECT s_suppkey AS set_id, v, v * 250.0::DOUBLE AS x0 FROM supplier, (VALUES (0), (1), (2), (3), (9)) t(v))
SELECT w.set_id, 'V' || CAST(v AS VARCHAR) AS viewport, count(e.set_id) AS drawn FROM w LEFT JOIN e ON e.set_id = w.set_id AND e.plots AND e.x0 <= w.x0 + 200 AND w.x0 <= e.x0 + 30 AND e.y0 <= 180 AND 60 <= e.y0 + 30 GROUP BY ALL""")
def geo_framed_count(spark, d):
    li = table(spark, d, "lineitem")
    ent = li.select(F.col("l_suppkey").alias("set_id"), F.xxhash64(*li.columns).alias("ent"), (F.col("l_quantity") * 20).alias("x0"), (F.col("l_linenumber") * 50.0).alias("y0"),
                    (F.col("l_quantity") * 20 + 30).alias("x1"), (F.col("l_linenumber") * 50.0 + 30).alias("y1"), (F.col("l_returnflag") != "N").alias("plots"))
    win = table(spark, d, "supplier").select(F.col("s_suppkey").alias("set_id"), F.explode(F.array(*map(F.lit, (0, 1, 2, 3, 9)))).alias("v")).select(
        "set_id", F.concat(F.lit("V"), F.col("v").cast("string")).alias("viewport"), (F.col("v") * 250.0).alias("x0"), F.lit(60.0).alias("y0"), (F.col("v") * 250.0 + 200).alias("x1"), F.lit(180.0).alias("y1"))
    return G.framed(ent, win).select("set_id", "viewport", "drawn")


@query("geo_block_expand", """
SELECT n_regionkey AS set_id, least(1000000001, sum(1 + c.n * (1 + coalesce(s, 0)))) AS n_entities FROM nation JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) s ON s.k = n_nationkey GROUP BY n_regionkey""".replace("least(1000000001, sum(1 + c.n * (1 + coalesce(s, 0))))",
       "CAST(least(1000000001, sum(1 + c.n * (1 + coalesce(s.s, 0)))) AS BIGINT)"))
def geo_block_expand(spark, d):
    """A region is a drawing, a nation a block in it, its customers inserts of a block of suppliers."""
    n, c, s = (table(spark, d, t) for t in ("nation", "customer", "supplier"))
    reg = n.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("bigint").alias("set_id"))
    nat = lambda p: F.concat(F.lit(p), F.col("k").cast("string"))
    top = reg.select("set_id", F.lit(None).cast("string").alias("block"), nat("N").alias("child"), F.lit(1).alias("copies"), F.lit(0).alias("attribs"))
    mid = c.select(F.col("c_nationkey").alias("k")).join(reg, "k").select("set_id", nat("N").alias("block"), nat("S").alias("child"), F.lit(1).alias("copies"), F.lit(0).alias("attribs"))
    leaf = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("plain")).join(reg, "k").select("set_id", nat("S").alias("block"), "plain")
    out = G.expanded_count(top.unionByName(mid), leaf, 1_000_000_000)
    return out.select(F.col("set_id").cast("int").alias("set_id"), "n_entities")


def line_items(spark, d):
    return lines(spark, d).select("set_id", "page", F.col("line_no").alias("seq"), "text", F.lit(0.0).alias("x0"), (F.col("line_no") * 12.0).alias("y0"), F.lit(100.0).alias("x1"), (F.col("line_no") * 12.0 + 10).alias("y1"))


@query("geo_anchor", DUCK_LINES + """,
p AS (SELECT set_id, page, string_agg(trim(regexp_replace(upper(text), '\\s+', ' ', 'g')), ' ' ORDER BY line_no) || ' ' AS j FROM a_lines
      WHERE trim(regexp_replace(upper(text), '\\s+', ' ', 'g')) <> '' GROUP BY set_id, page)
SELECT set_id, page, len(string_split(j, 'THE')) - 1 AS n FROM p WHERE contains(j, 'THE')""")
def geo_anchor(spark, d):
    anchors = lines(spark, d).select("set_id", "page").distinct().withColumn("anchor", F.lit("the"))
    return G.locate_anchor(line_items(spark, d), anchors).groupBy("set_id", "page").agg(F.count(F.lit(1)).alias("n"))


@query("geo_anchor_lines", DUCK_LINES + """,
l AS (SELECT set_id, page, line_no, text AS raw, trim(regexp_replace(upper(text), '\\s+', ' ', 'g')) AS t FROM a_lines),
p AS (SELECT set_id, page, string_agg(t, ' ' ORDER BY line_no) || ' ' AS j FROM l WHERE t <> '' GROUP BY set_id, page),
a AS (SELECT DISTINCT l.set_id, n.page, raw, t FROM l JOIN (SELECT DISTINCT set_id, page FROM l) n ON n.set_id = l.set_id AND n.page IN (l.page, l.page + 1) WHERE t <> '')
SELECT a.set_id, a.page, raw AS anchor, len(string_split(j, t)) - 1 AS n FROM a JOIN p ON p.set_id = a.set_id AND p.page = a.page WHERE contains(j, t)""")
def geo_anchor_lines(spark, d):
    """Every line as an anchor on its own page and, where it may be absent, on the next."""
    ln = lines(spark, d)
    both = ln.select("set_id", F.explode(F.array(F.col("page"), (F.col("page") + 1).cast(ln.schema["page"].dataType))).alias("page"), F.col("text").alias("anchor"))
    return G.locate_anchor(line_items(spark, d), both).groupBy("set_id", "page", "anchor").agg(F.count(F.lit(1)).alias("n"))


@query("geo_empty_share", ORACLE["geo_framed_count"].replace("SELECT w.set_id, 'V'", ", f AS (SELECT w.set_id, v, 'V'").replace("GROUP BY ALL", """GROUP BY ALL)
SELECT set_id, coalesce(sum(CASE WHEN drawn = 0 THEN 120.0 * (v + 1) ELSE 0 END)::DOUBLE / sum(120.0 * (v + 1))::DOUBLE, 0) AS share FROM f GROUP BY set_id"""))
def geo_empty_share(spark, d):
    """Share of each set's viewport area that frames nothing; a viewport's area grows with its number."""
    framed = geo_framed_count(spark, d).withColumn("area", 120.0 * (F.substring("viewport", 2, 2).cast("double") + 1))
    return G.empty_share(framed).select("set_id", "share")
