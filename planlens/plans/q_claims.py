"""Registered queries: sources, profiling, claims and grounding."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planlens.functions import text as T
from planlens.operators import claims as C, grounding as G, layout as L, profile as P, register as RG
from planlens.plans.adapters import DUCK_LINES, DUCK_WORDS, adapter, lines, with_views, words
from planlens.plans.registry import query, table
from planlens.session import cut_lineage, ensure_checkpoint_dir
from planlens.sources import readers as R, sinks as S
from planlens.sources.catalog import CATALOG_FIELDS, catalog
from planlens.sources.corpus import corpus

WIDTH, HEIGHT = 612.0, 792.0


# ---- sources and sinks ------------------------------------------------------------------------

def folder(spark, name):
    """A folder of its own for one run, in the place every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/planlens-{name}-{uuid.uuid4().hex}"


@query("src_words", DUCK_WORDS + "SELECT set_id, page, count(*) AS n, sum(x1) AS sx FROM a_words WHERE trim(text) <> '' GROUP BY set_id, page")
def src_words(spark, d):
    at = folder(spark, "words")
    words(spark, d).write.parquet(at)
    return R.read_words(spark, at).groupBy("set_id", "page").agg(F.count(F.lit(1)).alias("n"), F.sum("x1").alias("sx"))


@query("src_page_text", DUCK_LINES + "SELECT set_id, page, line_no, text FROM a_lines")
def src_page_text(spark, d):
    pages = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("set_id"),
                                                (F.col("doc_id") % 10).cast("int").alias("page"), "text")
    return R.page_lines(pages)


@query("src_ocr_words", """
SELECT doc_id AS set_id, count(*) AS n, sum(CAST(i AS DOUBLE) * 10 + length(t)) AS sx1 FROM (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS t FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents))
WHERE trim(replace(replace(t, chr(10), ''), chr(9), '')) <> '' AND length(t) * 7 % 101 >= 40 AND i % 9 <> 4 GROUP BY doc_id""")
def src_ocr_words(spark, d):
    w = table(spark, d, "documents").select(F.col("doc_id").alias("set_id"), F.posexplode(F.split("text", " ")).alias("i", "t"))
    raw = w.select("set_id", F.translate("t", "\n\t", "").alias("text"), (F.col("i") * 10).cast("string").alias("left"),
                   F.lit("0").alias("top"), F.when(F.col("i") % 9 == 4, "wide").otherwise(F.length("t").cast("string")).alias("width"),
                   F.lit("9").alias("height"), (F.length("t") * 7 % 101).cast("string").alias("conf"))
    out = R.clean_ocr_words(raw)
    return out.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x1").alias("sx1"))


@query("src_readings", """
SELECT conv_id AS set_id, turn AS page, CASE role WHEN 'user' THEN 'height_ft' ELSE 'stories' END AS field, text AS value
FROM conversations""")
def src_readings(spark, d):
    c = table(spark, d, "conversations")
    f = F.array(F.struct(F.when(F.col("role") == "user", "height_ft").otherwise("stories").alias("field"),
                         F.col("text").alias("value"), F.col("text").alias("quote"), F.lit("").alias("role")))
    sheets = F.create_map(F.col("turn").cast("string"), F.struct(F.lit("G-1").alias("sheet_number"), f.alias("fields")))
    js = c.select(F.col("conv_id").alias("set_id"), F.to_json(F.struct(sheets.alias("sheets"))).alias("json"))
    out = R.proposals_of(R.parse_readings(js))
    return out.select("set_id", F.col("page").cast("bigint").alias("page"), "field", "value")


@query("src_sidecar", "SELECT page_id AS set_id, CAST(page_id % 7 AS INTEGER) AS page, url AS text, length(html) * 1.0::DOUBLE AS x1 FROM pages")
def src_sidecar(spark, d):
    p = table(spark, d, "pages")
    box = F.array(F.lit(0.0), F.lit(0.0), F.length("html").cast("double"), F.lit(9.0))
    page = F.struct((F.col("page_id") % 7).cast("int").alias("page"), F.lit("G-1").alias("number"), F.lit("T").alias("title"), F.lit("L").alias("layout"),
                    F.array(F.struct(F.col("url").alias("text"), F.array(F.lit("1A")).alias("handles"), box.alias("box"))).alias("text"))
    js = p.select(F.col("page_id").alias("set_id"), F.to_json(F.struct(F.array(page).alias("pages"))).alias("json"))
    parsed = js.select("set_id", F.from_json("json", R.SIDECAR.replace("set_id bigint, ", "")).alias("s")).select("set_id", "s.*")
    _, cells, _ = R.sidecar_tables(parsed)
    return cells.select("set_id", "page", "text", "box.x1")


@query("src_declarations", "SELECT c_custkey AS set_id, c_acctbal AS building_area_sf, c_mktsegment AS zoning FROM customer")
def src_declarations(spark, d):
    c = table(spark, d, "customer")
    js = c.select(F.col("c_custkey").alias("set_id"), F.to_json(F.struct(
        F.col("c_acctbal").alias("building_area_sf"), F.col("c_mktsegment").alias("zoning"), F.col("c_name").alias("unknown_key"))).alias("json"))
    return R.parse_declarations(js).select("set_id", "building_area_sf", "zoning")


@query("src_corpus", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 37500 WHEN 1 THEN 23000 WHEN 2 THEN 19000 ELSE 9000 END::DOUBLE AS ns,
       CASE p_size % 4 WHEN 0 THEN 150000 WHEN 1 THEN 92000 WHEN 2 THEN 76000 ELSE 36000 END::DOUBLE AS s1 FROM part""")
def src_corpus(spark, d):
    pick = F.element_at(F.array(*map(F.lit, ("II-A", "II-B", "III-B", "V-B"))), (F.col("p_size") % 4 + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", F.lit("B").alias("grp"), pick.alias("ctype"))
    return p.join(F.broadcast(corpus(spark)["area"]), ["grp", "ctype"]).select("p_partkey", "ns", "s1")


@query("sink_findings", with_views("a_findings") + "SELECT set_id, count(*) AS n, round(sum(price), 2) AS total FROM a_findings GROUP BY set_id")
def sink_findings(spark, d):
    at = folder(spark, "findings")
    S.write_review(adapter(spark, d, "a_findings"), at, buckets=4)
    return spark.read.parquet(at).groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("src_declaration_files", "SELECT c_custkey AS set_id, c_acctbal AS height_ft, c_mktsegment AS zoning FROM customer")
def src_declaration_files(spark, d):
    """Declarations written as JSON files with a key the schema does not know, and read back."""
    at = folder(spark, "declarations")
    c = table(spark, d, "customer")
    c.select(F.col("c_custkey").alias("set_id"), F.col("c_acctbal").alias("height_ft"), F.col("c_mktsegment").alias("zoning"), F.col("c_nationkey").alias("made_up")).write.json(at)
    return R.read_declarations(spark, at).select("set_id", "height_ft", "zoning")


@query("src_ocr_files", """
WITH w AS (SELECT month(o_orderdate) AS set_id, year(o_orderdate) AS page, o_custkey::DOUBLE AS x0, o_orderkey + 10.0::DOUBLE AS y1, o_orderpriority AS text, floor(o_totalprice / 5000) AS conf FROM orders)
SELECT CAST(set_id AS INTEGER) AS set_id, CAST(page AS INTEGER) AS page, x0, CAST(y1 AS DOUBLE) AS y1, text, CAST(conf AS DOUBLE) AS conf FROM w WHERE conf >= 40""")
def src_ocr_files(spark, d):
    """Recognised words written as tab-separated files per set and page, and read back without the doubtful ones."""
    at = folder(spark, "ocr")
    said = {"left": F.col("o_custkey"), "top": F.col("o_orderkey"), "width": F.lit(10), "height": F.lit(10), "conf": F.floor(F.col("o_totalprice") / 5000), "text": F.col("o_orderpriority")}
    o = table(spark, d, "orders").select(F.month("o_orderdate").alias("set_id"), F.year("o_orderdate").alias("page"), *[said.get(c, F.lit(1)).cast("string").alias(c) for c in R.OCR_COLUMNS])
    o.repartition("set_id", "page").write.partitionBy("set_id", "page").csv(at, sep="\t", header=True, quote="")
    return R.read_ocr_tsv(spark, at).select("set_id", "page", "x0", "y1", "text", "conf")


@query("sink_reports", with_views("a_findings") + """
SELECT set_id, count(*) AS n, count(*) FILTER (WHERE status = 'CONFLICT') AS n_conflicts, round(sum(price), 2) AS total FROM a_findings GROUP BY set_id""")
def sink_reports(spark, d):
    """Findings and their summary committed together by job; one job runs twice and one attempt never commits."""
    at = folder(spark, "reports")
    found = adapter(spark, d, "a_findings")
    for job, part in (("odd", "set_id % 2 = 1"), ("even", "set_id % 4 = 0"), ("even", "set_id % 2 = 0")):
        mine = found.where(part)
        S.write_reports({"findings": mine, "summary": RG.summary(mine)}, at, job)
    found.write.parquet(f"{at}/reports/findings/attempt=lost")
    got = S.read_reports(spark, at, ["findings", "summary"])
    total = got["findings"].groupBy("set_id").agg(F.round(F.sum("price"), 2).alias("total"))
    return got["summary"].select("set_id", F.col("findings_count").alias("n"), "n_conflicts").join(total, "set_id")


# ---- profiling ----------------------------------------------------------------------------------

STATS = """WITH s AS (SELECT page_id // 5 AS set_id, CAST(page_id % 5 AS INTEGER) AS page, length(html) % 300 AS vec, length(url) * 5 AS chars,
  length(html) % 3 AS imgs, (length(html) % 100) / 100.0::DOUBLE AS cover FROM pages),
k AS (SELECT *, CASE WHEN vec < 8 AND chars < 20 AND imgs = 0 THEN 'blank' WHEN vec >= 120 AND chars >= 120 THEN CASE WHEN cover >= 0.55 THEN 'hybrid' ELSE 'vector' END
  WHEN cover >= 0.55 OR (vec < 120 AND chars < 120) THEN 'raster' ELSE 'hybrid' END AS kind FROM s)
"""


def stats(spark, d):
    n = F.length("html")
    return table(spark, d, "pages").select(
        F.floor(F.col("page_id") / 5).alias("set_id"), (F.col("page_id") % 5).cast("int").alias("page"), (n % 300).alias("vector_items"),
        (F.length("url") * 5).alias("live_chars"), (n % 3).alias("image_count"), ((n % 100) / 100.0).alias("image_cover"), (n % 120).alias("paths"))


@query("prof_page_kind", STATS + "SELECT set_id, page, kind FROM k")
def prof_page_kind(spark, d):
    return P.page_kind(stats(spark, d)).select("set_id", "page", "kind")


@query("prof_doc_kind", STATS + """SELECT set_id, count(*) AS n_pages, count(*) FILTER (WHERE kind = 'raster') AS n_raster,
  count(*) FILTER (WHERE kind IN ('vector', 'hybrid')) AS n_readable, count(*) FILTER (WHERE kind = 'blank') AS n_blank,
  CASE WHEN bool_and(kind = 'blank') THEN 'blank' WHEN NOT bool_or(kind = 'raster') THEN 'vector' WHEN NOT bool_or(kind IN ('vector', 'hybrid')) THEN 'raster'
  ELSE 'mixed' END AS kind FROM k GROUP BY set_id""")
def prof_doc_kind(spark, d):
    return P.doc_kind(P.page_kind(stats(spark, d)))


def images(spark, d):
    """Every fourth of an embedding as a picture box on a page of its label."""
    e = table(spark, d, "embeddings")
    at = lambda i, j: F.round(F.expr(f"element_at(embedding, CAST(g * 4 + {i} AS INT))").cast("double") * 400 + 400)
    return (e.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(15)))).select(
        F.col("label").cast("bigint").alias("set_id"), (F.col("vec_id") % 50).cast("int").alias("page"), (F.col("vec_id") * 16 + F.col("g")).alias("img"),
        F.least(at(1, 0), at(3, 0)).alias("x0"), F.least(at(2, 0), at(4, 0)).alias("y0"), F.greatest(at(1, 0), at(3, 0)).alias("x1"),
        F.greatest(at(2, 0), at(4, 0)).alias("y1"), F.lit(0.1).alias("megapixels")))


@query("prof_band_merge")
def prof_band_merge(spark, d):
    return P.merge_bands(images(spark, d))


@query("prof_region_filter")
def prof_region_filter(spark, d):
    i = images(spark, d)
    pages = i.select("set_id", "page").distinct().select("*", F.lit(800.0).alias("width"), F.lit(800.0).alias("height"))
    return P.readable_regions(P.merge_bands(i), pages)


@query("prof_coverage", STATS + """SELECT set_id, count(*) AS total, count(*) FILTER (WHERE page % 3 <> 0) AS numbered,
  count(*) FILTER (WHERE chars > 200) AS read, count(*) FILTER (WHERE n % 120 > 50) AS drawn FROM (SELECT k.*, length(html) AS n FROM k JOIN pages
  ON page_id = set_id * 5 + page) GROUP BY set_id""")
def prof_coverage(spark, d):
    s = stats(spark, d)
    code = F.when(F.col("page") % 3 == 0, F.concat(F.lit("p"), (F.col("page") + 1).cast("string"))).otherwise("A-1")
    return P.coverage(s.select("set_id", "page", code.alias("code")), s)


@query("prof_layers", "SELECT l_orderkey AS set_id, l_linenumber AS page, l_returnflag AS layer, count(*) AS n FROM lineitem GROUP BY ALL")
def prof_layers(spark, d):
    return P.layer_histogram(table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("page"), F.col("l_returnflag").alias("layer")))


SHEETS = """WITH t AS (SELECT l_orderkey AS set_id, l_linenumber AS page, l_partkey AS seq, CASE l_suppkey % 6 WHEN 0 THEN 'a' || CAST(l_partkey % 90 AS VARCHAR)
   WHEN 1 THEN 'M.' || CAST(100 + l_partkey % 90 AS VARCHAR) WHEN 2 THEN 'PT-' || CAST(l_partkey % 9 AS VARCHAR) WHEN 3 THEN 'G-00' || CAST(l_partkey % 9 AS VARCHAR)
   ELSE 'note' END AS text, l_quantity * 10 AS x0, (l_suppkey % 50) * 12.0::DOUBLE AS y0, l_extendedprice AS p FROM lineitem),
c AS (SELECT *, CASE WHEN text LIKE 'a%' THEN 'A-' || substr(text, 2) WHEN text LIKE 'M%' OR text LIKE 'G%' THEN text END AS code,
   round_even(x0 / 500, 1) AS cx, round_even(y0 / 600, 1) AS cy FROM t),
cells AS (SELECT set_id, page, cx, cy, arg_min(code, ROW(seq, p)) AS code FROM c WHERE code IS NOT NULL GROUP BY set_id, page, cx, cy)
"""


def sheet_words(spark, d):
    li = table(spark, d, "lineitem")
    k, p = F.col("l_suppkey") % 6, F.col("l_partkey")
    text = (F.when(k == 0, F.concat(F.lit("a"), (p % 90).cast("string"))).when(k == 1, F.concat(F.lit("M."), (100 + p % 90).cast("string")))
            .when(k == 2, F.concat(F.lit("PT-"), (p % 9).cast("string"))).when(k == 3, F.concat(F.lit("G-00"), (p % 9).cast("string"))).otherwise("note"))
    w = li.select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("page"), p.alias("block"), F.col("l_extendedprice").alias("line"),
                  F.lit(0).alias("seq"), text.alias("text"), (F.col("l_quantity") * 10).alias("x0"), ((F.col("l_suppkey") % 50) * 12.0).alias("y0"))
    pages = w.select("set_id", "page").distinct().select("*", F.lit(500.0).alias("width"), F.lit(600.0).alias("height"))
    return w, pages


@query("prof_sheet_number", SHEETS + "SELECT set_id, page, cx, cy, code FROM cells")
def prof_sheet_number(spark, d):
    return P.sheet_cells(*sheet_words(spark, d))


@query("prof_sheet_anchor", SHEETS + """,
n AS (SELECT set_id, cx, cy, count(*) AS n FROM cells GROUP BY set_id, cx, cy),
a AS (SELECT set_id, cx, cy FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY n DESC, cx, cy) AS k FROM n) WHERE k = 1),
p AS (SELECT DISTINCT set_id, page FROM t)
SELECT p.set_id, p.page, coalesce(cells.code, 'p' || CAST(p.page + 1 AS VARCHAR)) AS code FROM p LEFT JOIN a ON a.set_id = p.set_id
LEFT JOIN cells ON cells.set_id = p.set_id AND cells.page = p.page AND cells.cx = a.cx AND cells.cy = a.cy""")
def prof_sheet_anchor(spark, d):
    w, pages = sheet_words(spark, d)
    return P.sheet_index(pages, P.sheet_cells(w, pages)).select("set_id", "page", "code")


@query("prof_sheet_title", DUCK_LINES + """,
t AS (SELECT set_id, page, row_number() OVER (PARTITION BY set_id, page ORDER BY line_no) AS line_no, text, line_no AS l0 FROM (
   SELECT set_id, page, line_no * 10 + 1 AS line_no, trim(replace(replace(text, ':', ''), '|', '')) AS text FROM a_lines UNION ALL
   SELECT DISTINCT set_id, page, 15, 'SHEET TITLE' FROM a_lines UNION ALL SELECT DISTINCT set_id, page, 16, 'DATE: 1/2/2024' FROM a_lines
   UNION ALL SELECT DISTINCT set_id, page, 35, 'A-101' FROM a_lines) WHERE text <> ''),
v AS (SELECT *, row_number() OVER (PARTITION BY set_id, page ORDER BY line_no) AS k FROM t WHERE l0 > 16),
e AS (SELECT set_id, page, min(k) AS stop FROM v WHERE l0 = 35 GROUP BY set_id, page),
first_ AS (SELECT v.set_id, v.page, string_agg(text, ' ' ORDER BY k) AS title FROM v JOIN e USING (set_id, page)
   WHERE CASE WHEN stop = 1 THEN k BETWEEN 2 AND 4 ELSE k < stop AND k <= 3 END GROUP BY v.set_id, v.page),
ab AS (SELECT t.set_id, t.page, arg_max(text, line_no) AS title FROM t JOIN (SELECT set_id, page, line_no AS n FROM t WHERE l0 = 35) USING (set_id, page)
   WHERE line_no < n AND line_no >= n - 7 AND text <> 'SHEET TITLE' AND NOT contains(text, ':') AND length(text) > 2 GROUP BY t.set_id, t.page)
SELECT p.set_id, p.page, coalesce(first_.title, ab.title, '') AS title FROM (SELECT DISTINCT set_id, page FROM a_lines) p
LEFT JOIN first_ USING (set_id, page) LEFT JOIN ab USING (set_id, page)""")
def prof_sheet_title(spark, d):
    ln = lines(spark, d).select("set_id", "page", (F.col("line_no") * 10 + 1).alias("line_no"), F.translate("text", ":|", "").alias("text"))
    pages = ln.select("set_id", "page").distinct()
    extra = pages.select("set_id", "page", F.explode(F.array(
        F.struct(F.lit(15).alias("line_no"), F.lit("SHEET TITLE").alias("text")), F.struct(F.lit(16).alias("line_no"), F.lit("DATE: 1/2/2024").alias("text")),
        F.struct(F.lit(35).alias("line_no"), F.lit("A-101").alias("text")))).alias("e")).select("set_id", "page", "e.*")
    sheets = pages.withColumn("code", F.lit("A-101"))
    return P.sheet_titles(ln.unionByName(extra), sheets, 3, 7).select("set_id", "page", "title")


@query("filter_pages_naming", """SELECT doc_id // 10 AS set_id, CAST(doc_id % 10 AS INTEGER) AS page, p AS phrase FROM documents,
(VALUES ('the'), ('und'), ('les'), ('zzz')) t(p) WHERE contains(upper(text), upper(p))""")
def filter_pages_naming(spark, d):
    t = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("set_id"), (F.col("doc_id") % 10).cast("int").alias("page"), "text")
    return P.pages_naming(t, ["the", "und", "les", "zzz"])


@query("first_match", """
WITH t AS (SELECT doc_id // 10 AS set_id, CAST(doc_id % 10 AS INTEGER) AS page, text, lang <> 'de' AS late FROM documents),
h AS (SELECT set_id, page, late, 0 AS rank, regexp_extract(text, '(th[a-z]+ing)', 1) AS hit FROM t UNION ALL
      SELECT set_id, page, late, 1, regexp_extract(text, '(un[a-z]+)', 1) FROM t UNION ALL SELECT set_id, page, late, 2, regexp_extract(text, '([a-z]+)', 1) FROM t)
SELECT set_id, arg_min(hit, ROW(rank, late, page)) AS hit, arg_min(page, ROW(rank, late, page)) AS page FROM h WHERE hit <> '' GROUP BY set_id""")
def first_match(spark, d):
    t = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("set_id"), (F.col("doc_id") % 10).cast("int").alias("page"), "text", "lang")
    return P.first_match(t, ["(th[a-z]+ing)", "(un[a-z]+)", "([a-z]+)"], F.col("lang") == "de").select("set_id", "hit", "page")


@query("prof_block_counts", with_views("a_findings") + """,
p AS (SELECT page AS set_id, title AS name, anchor AS layer, count(*) AS n FROM a_findings GROUP BY ALL),
n AS (SELECT set_id, name, sum(n) AS total FROM p GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY total DESC, name) AS k FROM n),
l AS (SELECT *, row_number() OVER (PARTITION BY set_id, name ORDER BY n DESC, layer) AS j FROM p)
SELECT top.set_id, top.name, CAST(total AS BIGINT) AS total, string_agg(layer, ',' ORDER BY j) AS layers FROM top JOIN l ON l.set_id = top.set_id AND l.name = top.name
WHERE k <= 200 AND j <= 3 GROUP BY ALL""")
def prof_block_counts(spark, d):
    return P.block_counts(adapter(spark, d, "a_findings").select(F.col("page").alias("set_id"), F.col("title").alias("name"), F.col("anchor").alias("layer")), 200, 3)


# ---- claims -------------------------------------------------------------------------------------

_VALS = {"occupancy": "GROUP A - 3", "construction": "TYPE II-B", "sprinkler": "YES, PER NFPA 13R", "area": "1,436 SF", "feet": "26'-6\"", "inches": "44\"",
         "count": "70 PERSONS", "factor": "0.15 IN", "wind": "ULTIMATE: 170 MPH", "roman": "III (3)", "letter": "CATEGORY C", "bool": "YES", "edition": "FBC 2020", "text": "a  b."}
_EXPECT = {"occupancy": "A-3", "construction": "II-B", "sprinkler": "NFPA13R", "area": "1436.0", "feet": "26.5", "inches": "44.0", "count": "70.0", "factor": "0.15",
           "wind": "170.0", "roman": "III", "letter": "C", "bool": "true", "edition": "fbc2020", "text": "A B"}
_KINDS = list(_VALS)


@query("clm_normalise", "SELECT p_partkey, CASE p_partkey % 15 " + " ".join(
    f"WHEN {i} THEN '{_EXPECT[k]}'" for i, k in enumerate(_KINDS)) + " END AS value FROM part")
def clm_normalise(spark, d):
    k = F.col("p_partkey") % 15
    pick = lambda m: F.coalesce(*[F.when(k == i, F.lit(m[x])) for i, x in enumerate(_KINDS)])
    raw = table(spark, d, "part").select("p_partkey", F.coalesce(pick({x: x for x in _KINDS}), F.lit("wind")).alias("kind"),
                                         F.coalesce(pick(_VALS), F.lit("12 MPH")).alias("raw"))
    n = C.normalise(raw)
    return n.select("p_partkey", F.coalesce("value_str", F.col("value_num").cast("string"), F.col("value_bool").cast("string")).alias("value"))


_LABELS = ["OCCUPANCY", "TOTAL OCCUPANT LOAD", "MAX TRAVEL DISTANCE (1017.2)", "SITE AREA", "GROSS FLOOR AREA", "THE RISK CATEGORY NOW", "TOTAL", "NOTHING"]


def claim_pairs(spark, d, rows=None):
    """A pair per order line: the supplier picks the label, the quantity is the value."""
    li = table(spark, d, "lineitem") if rows is None else rows
    i = (F.col("l_suppkey") % 8).cast("int")
    q = F.col("l_quantity").cast("int").cast("string")
    label = F.element_at(F.array(*map(F.lit, _LABELS)), i + 1)
    values = (F.when(i == 0, F.array(F.lit("GROUP B"))).when(i == 2, F.array(F.concat(q, F.lit(" LF")), F.concat(q, F.lit("'-6\""))))
              .when(i == 4, F.array(F.concat(q, F.lit("0 SF")))).when(i == 5, F.array(F.lit("III"))).when(i == 6, F.array(F.concat(q, F.lit("0")), q)).otherwise(F.array(q)))
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(9.0).alias("y1"))
    heads = F.when(i == 6, F.array(F.lit("AREA"), F.lit("OCCUPANT LOAD"))).otherwise(F.array().cast("array<string>"))
    ctx = F.when(F.col("l_returnflag") == "R", F.array(F.lit("EXIT DISCHARGE 1"))).otherwise(F.array().cast("array<string>"))
    return li.select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("page"), F.lit("G-1").alias("sheet"),
                     F.xxhash64(*li.columns).alias("ord"), F.lit("row").alias("kind"), label.alias("label"), values.alias("values"), heads.alias("headers"),
                     ctx.alias("context"), F.lit("").alias("heading"), box.alias("label_box"), F.array(box, box).alias("value_boxes"))


_I = "l_suppkey % 8"


@query("clm_label_match", f"""
SELECT l_orderkey AS set_id, field, score, count(*) AS n FROM lineitem, (VALUES (0, 'occupancy_group', 1.0::DOUBLE), (1, 'occupant_load', 0.99),
  (2, 'egress.travel_distance', 1.0), (4, 'building_area_sf', 0.98), (5, 'risk_category', 0.8)) t(i, field, score) WHERE {_I} = t.i GROUP BY ALL""")
def clm_label_match(spark, d):
    m = C.match_labels(claim_pairs(spark, d), catalog(spark))
    return m.groupBy("set_id", "field", "score").agg(F.count(F.lit(1)).alias("n"))


@query("clm_context_veto", f"""
SELECT l_orderkey AS set_id, field, count(*) AS n FROM lineitem, (VALUES (0, 'occupancy_group'), (1, 'occupant_load'),
  (2, 'egress.travel_distance'), (4, 'building_area_sf'), (5, 'risk_category')) t(i, field)
WHERE {_I} = t.i AND NOT (field = 'occupant_load' AND l_returnflag = 'R') GROUP BY ALL""")
def clm_context_veto(spark, d):
    m = C.context_ok(C.match_labels(claim_pairs(spark, d), catalog(spark)))
    return m.groupBy("set_id", "field").agg(F.count(F.lit(1)).alias("n"))


@query("clm_role", """SELECT l_orderkey AS set_id, l_partkey AS part, CASE l_linenumber WHEN 1 THEN 'required' WHEN 2 THEN 'provided' WHEN 3 THEN
  CASE WHEN l_quantity >= 25 THEN 'required' ELSE 'provided' END WHEN 4 THEN 'required' WHEN 5 THEN 'provided' WHEN 6 THEN 'required' ELSE '' END AS role FROM lineitem""")
def clm_role(spark, d):
    n = F.col("l_linenumber")
    li = table(spark, d, "lineitem")
    header = F.when(n == 1, "MAX. REQ'D REQUIRED:").when(n == 2, "ACTUAL").otherwise("")
    label = F.when(n == 4, "MAX. COMMON PATH").otherwise("COMMON PATH")
    raw = F.when(n == 5, "38'-2\"").when(n == 6, "50 LF").otherwise("7")
    i = F.when((n == 3) & (F.col("l_quantity") < 25), 1).otherwise(0)
    return li.select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("part"),
                     C.assign_role(header, label, i, F.when(n == 3, 2).otherwise(1), raw).alias("role"))


@query("clm_from_pairs", f"""
WITH q AS (SELECT l_orderkey AS set_id, {_I} AS i, CAST(floor(l_quantity) AS DOUBLE) AS q, l_returnflag AS rf FROM lineitem)
SELECT set_id, field, role, value, count(*) AS n FROM (
  SELECT set_id, 'occupancy_group' AS field, '' AS role, 'B' AS value FROM q WHERE i = 0 UNION ALL
  SELECT set_id, 'occupant_load', '', CAST(q AS VARCHAR) FROM q WHERE i = 1 AND rf <> 'R' UNION ALL
  SELECT set_id, 'egress.travel_distance', 'required', CAST(q AS VARCHAR) FROM q WHERE i = 2 UNION ALL
  SELECT set_id, 'egress.travel_distance', 'provided', CAST(q + 0.5 AS VARCHAR) FROM q WHERE i = 2 UNION ALL
  SELECT set_id, 'building_area_sf', '', CAST(q * 10 AS VARCHAR) FROM q WHERE i = 4 AND q * 10 >= 20 UNION ALL
  SELECT set_id, 'risk_category', '', 'III' FROM q WHERE i = 5) GROUP BY ALL""")
def clm_from_pairs(spark, d):
    c = C.claims_from_pairs(claim_pairs(spark, d), catalog(spark))
    v = F.coalesce("value_str", F.col("value_num").cast("string"))
    return c.groupBy("set_id", "field", "role", v.alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("clm_tabulated", f"""
WITH q AS (SELECT l_orderkey AS set_id, CAST(floor(l_quantity) AS DOUBLE) AS q FROM lineitem WHERE {_I} = 6)
SELECT set_id, field, value_num, score, count(*) AS n FROM (SELECT set_id, 'area.tabulated_total_sf' AS field, q * 10 AS value_num, 0.9::DOUBLE AS score FROM q WHERE q * 10 >= 20
UNION ALL SELECT set_id, 'occupant_load', q, 0.95 FROM q) GROUP BY ALL""")
def clm_tabulated(spark, d):
    return C.tabulated_claims(claim_pairs(spark, d)).groupBy("set_id", "field", "value_num", "score").agg(F.count(F.lit(1)).alias("n"))


@query("clm_lines", DUCK_LINES + """
SELECT set_id, page, line_no, CASE length(text) % 4 WHEN 0 THEN 'fbc2023' WHEN 1 THEN 'fbc2020' END AS value FROM a_lines WHERE length(text) % 4 < 2""")
def clm_lines(spark, d):
    n = F.length("text") % 4
    t = lines(spark, d).withColumn("text", F.when(n == 0, "2023 FLORIDA BUILDING CODE 8TH EDITION").when(n == 1, "FBC 2020").when(
        n == 2, "2020 NATIONAL ELECTRIC CODE").otherwise("no code here"))
    out = C.line_claims(t.withColumn("raw_line", F.col("line_no")).withColumn("page", F.struct("page", "line_no")))
    return out.select("set_id", "page.page", "page.line_no", F.col("value_str").alias("value"))


@query("clm_attributes", """
SELECT p_size AS set_id, CASE p_size % 3 WHEN 0 THEN 'risk_category' WHEN 1 THEN 'occupancy_group' END AS field, 0.9::DOUBLE AS score, count(*) AS n
FROM part WHERE p_size % 3 < 2 AND p_type <> 'ECONOMY' GROUP BY ALL""")
def clm_attributes(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_size") % 3
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(9.0).alias("y1"))
    attrs = p.select(F.col("p_size").alias("set_id"), F.lit(0).alias("page"), F.lit("ATTRIB").alias("kind"), F.when(k == 0, "RISK_CATEGORY").when(k == 1, "OCCUPANCY-GROUP")
                     .otherwise("COLOUR").alias("tag"), F.lit("").alias("prompt"), F.when(k == 0, "II").otherwise("B").alias("text"), F.lit("0").alias("layer"),
                     F.col("p_partkey").cast("string").alias("handle"), F.when(F.col("p_type") == "ECONOMY", "V1").otherwise("").alias("viewport"),
                     F.lit(False).alias("repeated"), box.alias("box"))
    return C.attribute_claims(attrs, catalog(spark)).groupBy("set_id", "field", "score").agg(F.count(F.lit(1)).alias("n"))


@query("clm_stamp", DUCK_WORDS + """,
c AS (SELECT set_id, page, line * 1000 + seq AS id, x0, y0, x0 + 70 AS x1, y1 FROM a_words WHERE text LIKE '%,')
SELECT c.set_id, c.page, CAST(c.id AS BIGINT) AS claim_id, count(*) AS n FROM c JOIN a_words w ON w.set_id = c.set_id AND w.page = c.page
 AND least(c.x1 + 0.5, w.x1) > greatest(c.x0 - 0.5, w.x0) AND least(c.y1 + 0.5, w.y1) > greatest(c.y0 - 0.5, w.y0)
 AND (least(c.x1 + 0.5, w.x1) - greatest(c.x0 - 0.5, w.x0)) * (least(c.y1 + 0.5, w.y1) - greatest(c.y0 - 0.5, w.y0))
     >= 0.5 * least((w.x1 - w.x0) * (w.y1 - w.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) GROUP BY ALL""")
def clm_stamp(spark, d):
    w = words(spark, d).withColumn("handle", F.concat_ws("-", F.col("line").cast("string"), F.col("seq").cast("string")))
    c = w.where("text like '%,'").select("set_id", "page", (F.col("line") * 1000 + F.col("seq")).cast("bigint").alias("claim_id"), "x0", "y0",
                                         (F.col("x0") + 70).alias("x1"), "y1")
    return C.stamp_sources(c, w).select("set_id", "page", "claim_id", F.size("source").cast("bigint").alias("n"))


# ---- grounding ----------------------------------------------------------------------------------

def proposals(spark, d):
    """Every printed line as the quote of a reading, on the page it is from."""
    ln = lines(spark, d)
    n = F.length("text")
    field = F.element_at(F.array(*map(F.lit, ("zoning", "height_ft", "nothing", "stories", "egress.width"))), (n % 5).cast("int") + 1)
    toks = T.words(F.col("text"))
    at = F.when(n % 7 == 0, F.size(toks) + 1).otherwise((1 + n % F.greatest(F.size(toks), F.lit(1))).cast("int"))  # some values stand in no quote
    return ln.select("set_id", "page", F.col("line_no").cast("bigint").alias("prop_id"), field.alias("field"),
                     F.coalesce(F.try_element_at(toks, at), F.lit("elsewhere")).alias("value"), F.col("text").alias("quote"), F.lit("").alias("role"))


@query("clm_locate_words")
def clm_locate_words(spark, d):
    w = words(spark, d)
    pages = w.select("set_id", "page").distinct().select("*", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    return G.locate_words(proposals(spark, d), w, pages).select("set_id", "page", "prop_id", "span", "fuzzy")


def line_pairs(spark, d):
    ln = lines(spark, d)
    toks = T.words(F.col("text"))
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(9.0).alias("y1"))
    half = F.greatest(F.floor(F.size(toks) / 2), F.lit(1)).cast("int")
    return ln.select("set_id", "page", F.col("line_no").alias("ord"), F.array_join(F.slice(toks, F.lit(1), half), " ").alias("label"),
                     F.array(F.array_join(F.slice(toks, half + 1, F.greatest(F.size(toks), F.lit(1))), " ")).alias("values"), box.alias("box"))


@query("clm_locate_pair")
def clm_locate_pair(spark, d):
    return G.locate_pair(proposals(spark, d), line_pairs(spark, d)).select("set_id", "page", "prop_id", "ord", "extra")


@query("clm_ground")
def clm_ground(spark, d):
    p = proposals(spark, d)
    found = G.locate_pair(p, line_pairs(spark, d)).select("set_id", "page", "prop_id", F.lit(False).alias("fuzzy"),
                                                          F.array(F.lit("ZONING")).alias("context"), F.lit("").alias("heading"))
    return G.ground(p, found, catalog(spark)).select("set_id", "page", "prop_id", "field", "reason", "value_str", "confidence")


@query("clm_merge_readings", """
WITH u AS (SELECT conv_id AS set_id, text AS quote, role AS field, 0 AS pass, turn AS seq FROM conversations WHERE role = 'user' UNION ALL
           SELECT conv_id, text, 'user', 1, turn FROM conversations)
SELECT set_id, quote, field, CAST(min(pass) AS INTEGER) AS pass, count(*) > 1 AS again FROM u GROUP BY set_id, quote, field""")
def clm_merge_readings(spark, d):
    c = table(spark, d, "conversations")
    shape = lambda df: df.select(F.col("conv_id").alias("set_id"), F.lit(0).alias("page"), F.lit("user").alias("field"), F.lit("v").alias("value"),
                                 F.col("text").alias("quote"), F.lit("").alias("role"), F.col("turn").alias("seq"))
    both = shape(c.where("role = 'user'")).unionByName(shape(c)).groupBy("set_id", "quote").agg((F.count(F.lit(1)) > 1).alias("again"))
    return G.merge_readings(shape(c.where("role = 'user'")), shape(c)).select("set_id", "quote", "field", "pass").join(both, ["set_id", "quote"])
