"""Registered queries: layout of words into rows, segments and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlens.functions import text as T
from planlens.operators import layout as L
from planlens.operators.helpers import grid_join, sided
from planlens.plans.adapters import DUCK_LINES, DUCK_WORDS, lines, words
from planlens.plans.registry import ORACLE, query

WIDTH, HEIGHT = 612.0, 792.0

SEGS = DUCK_WORDS + """,
br AS (SELECT *, CASE WHEN lag(x1) OVER w IS NULL OR x0 - lag(x1) OVER w > 6.0 THEN 1 ELSE 0 END AS b FROM a_words
       WINDOW w AS (PARTITION BY set_id, page, line ORDER BY x0, seq)),
isl AS (SELECT *, sum(b) OVER (PARTITION BY set_id, page, line ORDER BY x0, seq) AS island FROM br),
segs AS (SELECT set_id, page, row_number() OVER (PARTITION BY set_id, page ORDER BY line, island) AS seg_id, *
         EXCLUDE (set_id, page) FROM (
         SELECT set_id, page, line, island, string_agg(text, ' ' ORDER BY x0, seq) AS text, min(x0) AS x0, min(y0) AS y0,
                max(x1) AS x1, max(y1) AS y1 FROM isl GROUP BY set_id, page, line, island))
"""


def segs(spark, d):
    return L.segments(words(spark, d))


@query("lay_segments", SEGS + "SELECT set_id, page, CAST(seg_id AS INTEGER) AS seg_id, text, x0, y0, x1, y1 FROM segs")
def lay_segments(spark, d):
    return segs(spark, d).select("set_id", "page", "seg_id", "text", "x0", "y0", "x1", "y1")


@query("lay_merge_segments", DUCK_WORDS + """,
m AS (SELECT *, CASE WHEN lag(x1) OVER w IS NULL OR x0 - lag(x1) OVER w > 6.0 THEN 1 ELSE 0 END AS b FROM a_words
      WINDOW w AS (PARTITION BY set_id, page, line ORDER BY x0)),
g AS (SELECT *, sum(b) OVER (PARTITION BY set_id, page, line ORDER BY x0) AS island FROM m)
SELECT set_id, page, string_agg(text, ' ' ORDER BY x0) AS text, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0
FROM g GROUP BY set_id, page, line, island""")
def lay_merge_segments(spark, d):
    """Every word its own text object, as an overlay writes them; neighbours join again."""
    w = words(spark, d)
    single = L.segments(w.withColumn("block", F.col("seq")))
    return L.merge_segments(single).select("set_id", "page", "text", "x0", "x1", "y0")


@query("lay_grid_join", SEGS + """
SELECT l.set_id, l.page, CAST(l.seg_id AS INTEGER) AS l_seg, CAST(r.seg_id AS INTEGER) AS r_seg FROM segs l
JOIN segs r ON l.set_id = r.set_id AND l.page = r.page AND l.seg_id < r.seg_id
 AND abs(l.x0 - r.x0) <= 40 AND abs(l.y0 - r.y0) <= 24""")
def lay_grid_join(spark, d):
    s = segs(spark, d)
    cols = ["seg_id", "x0", "y0", "x1", "y1"]
    near = ((F.col("l_seg_id") < F.col("r_seg_id")) & (F.abs(F.col("l_x0") - F.col("r_x0")) <= 40)
            & (F.abs(F.col("l_y0") - F.col("r_y0")) <= 24))
    out = grid_join(sided(s, "l_", L.PAGE, *cols), sided(s, "r_", L.PAGE, *cols), L.PAGE, near, pad_x=40.0, pad_y=24.0)
    return out.select("set_id", "page", F.col("l_seg_id").alias("l_seg"), F.col("r_seg_id").alias("r_seg"))


@query("lay_right_of", SEGS + """
SELECT l.set_id, l.page, CAST(l.seg_id AS INTEGER) AS l_seg, CAST(r.seg_id AS INTEGER) AS r_seg,
       CAST(row_number() OVER (PARTITION BY l.set_id, l.page, l.seg_id ORDER BY r.x0, r.seg_id) AS INTEGER) AS n
FROM segs l JOIN segs r ON l.set_id = r.set_id AND l.page = r.page AND l.seg_id <> r.seg_id AND r.line = l.line
 AND r.x0 >= l.x1 - 1.0 AND r.x0 <= l.x1 + 183.60000000000002""")
def lay_right_of(spark, d):
    return L.right_of(segs(spark, d), WIDTH).select(
        "set_id", "page", F.col("l_seg_id").alias("l_seg"), F.col("r_seg_id").alias("r_seg"), "n")


@query("lay_below", SEGS + """
SELECT l.set_id, l.page, CAST(l.seg_id AS INTEGER) AS l_seg, CAST(r.seg_id AS INTEGER) AS r_seg,
       CAST(row_number() OVER (PARTITION BY l.set_id, l.page, l.seg_id ORDER BY r.y0, abs(r.x0 - l.x0), r.seg_id) AS INTEGER) AS n
FROM segs l JOIN segs r ON l.set_id = r.set_id AND l.page = r.page AND l.seg_id <> r.seg_id
 AND r.y0 >= l.y1 - 2.5 AND r.y0 - l.y1 <= 26
 AND (abs(r.x0 - l.x0) <= 15 OR least(l.x1, r.x1) - greatest(l.x0, r.x0) >= 0.5 * least(l.x1 - l.x0, r.x1 - r.x0))""")
def lay_below(spark, d):
    return L.below(segs(spark, d)).select(
        "set_id", "page", F.col("l_seg_id").alias("l_seg"), F.col("r_seg_id").alias("r_seg"), "n")


MARKED = DUCK_LINES + """, m AS (SELECT set_id, page, line_no, trim(regexp_replace(text, ', ', ': ')) AS text FROM a_lines)"""


def marked_lines(spark, d):
    """Lines whose first comma is a label mark."""
    ln = lines(spark, d)
    at = F.instr("text", ", ")
    text = F.when(at > 0, F.concat(F.substring("text", F.lit(1), at - 1), F.lit(": "),
                                   F.substring("text", at + 2, F.length("text")))).otherwise(F.col("text"))
    return ln.withColumn("text", F.trim(text))


@query("lay_inline_pairs", MARKED + """,
x AS (SELECT *, regexp_extract(text, '^(.*?[A-Za-z)\\]])\\s*([:?])(\\s+|$)(.*)$', 1) AS l,
             regexp_extract(text, '^(.*?[A-Za-z)\\]])\\s*([:?])(\\s+|$)(.*)$', 4) AS v FROM m)
SELECT set_id, page, line_no, trim(l) AS label, trim(v) AS value FROM x
WHERE l <> '' AND length(regexp_replace(trim(l), '[^\\p{L}]', '', 'g')) >= 2""")
def lay_inline_pairs(spark, d):
    return L.inline_pairs(marked_lines(spark, d)).select("set_id", "page", "line_no", "label", "value")


@query("lay_find_value", MARKED + """,
x AS (SELECT *, trim(regexp_extract(text, '^(.*?[A-Za-z)\\]])\\s*([:?])(\\s+|$)(.*)$', 1)) AS l,
             trim(regexp_extract(text, '^(.*?[A-Za-z)\\]])\\s*([:?])(\\s+|$)(.*)$', 4)) AS v FROM m),
k AS (SELECT *, trim(regexp_replace(replace(upper(l), 'ß', 'SS'), '[^A-Z0-9 ]', '', 'g')) AS key FROM x
      WHERE l <> '' AND length(regexp_replace(l, '[^\\p{L}]', '', 'g')) >= 2)
SELECT set_id, arg_min(l, page * 100000 + line_no) AS label, arg_min(v, page * 100000 + line_no) AS value FROM k
WHERE v <> '' AND contains(key, 'THE') AND NOT list_contains(string_split(key, ' '), 'AND') GROUP BY set_id""")
def lay_find_value(spark, d):
    p = L.inline_pairs(marked_lines(spark, d)).withColumn("ord", F.struct("page", "line_no"))
    return L.find_value(p, ["the"], ["and"])


@query("lay_trailing_pairs", DUCK_LINES + """,
t AS (SELECT set_id, page, line_no, regexp_replace(trim(text), '[.,;]$', '') ||
        CASE length(text) % 4 WHEN 0 THEN ' 42' WHEN 1 THEN ' 250 LF' WHEN 2 THEN ' SF' ELSE '' END AS text FROM a_lines WHERE trim(text) <> ''),
x AS (SELECT *, trim(regexp_extract(text, '^(.*?)((\\s+[,;]*(?i:\\d[\\d,]*(?:\\.\\d+)?|LF|SF|OPEN|NO|IN|[A-FHIMRSUV])[,;]*)+)$', 1)) AS l,
             trim(regexp_extract(text, '^(.*?)((\\s+[,;]*(?i:\\d[\\d,]*(?:\\.\\d+)?|LF|SF|OPEN|NO|IN|[A-FHIMRSUV])[,;]*)+)$', 2)) AS v FROM t)
SELECT set_id, page, line_no, count(*) AS n FROM x WHERE l <> '' AND length(regexp_replace(l, '[^\\p{L}]', '', 'g')) >= 2
  AND NOT regexp_matches(l, '[0-9]') AND len(list_filter(regexp_split_to_array(v, '\\s+'), lambda t: upper(t) NOT IN ('LF', 'SF', 'IN', 'A', 'V', ''))) > 0 GROUP BY ALL""")
def lay_trailing_pairs(spark, d):
    n = F.length("text") % 4
    tail = F.when(n == 0, " 42").when(n == 1, " 250 LF").when(n == 2, " SF").otherwise("")
    t = lines(spark, d).where("trim(text) <> ''").withColumn(
        "text", F.concat(F.regexp_replace(F.trim("text"), "[.,;]$", ""), tail))
    return L.trailing_pairs(t).groupBy("set_id", "page", "line_no").agg(F.count(F.lit(1)).alias("n"))


@query("lay_types", DUCK_LINES + """,
t AS (SELECT set_id, page, line_no, CASE length(text) % 7 WHEN 0 THEN trim(text) || ':' WHEN 1 THEN CAST(length(text) AS VARCHAR) || ' SF'
        WHEN 2 THEN 'Type II-B' WHEN 3 THEN 'no' WHEN 4 THEN 'group A-3' ELSE trim(text) END AS text, length(text) % 7 AS k FROM a_lines WHERE trim(text) <> ''),
u AS (SELECT *, upper(text) AS up, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters,
             len(regexp_split_to_array(trim(text), '\\s+')) AS nt FROM t),
v AS (SELECT *, k <> 0 AND NOT text LIKE '%:' AND (k IN (1, 2, 3, 4) OR (regexp_matches(up, '[0-9]') AND nt <= 6)
        OR regexp_matches(up, '^(GROUP\\s+)?[ABEFHIMRSU](\\s*-\\s*\\d)?$') OR regexp_matches(up, '^(I{1,3}|IV|V)\\s*-?\\s*[AB]?$')
        OR (nt <= 4 AND regexp_matches(up, '^[,;]*(YES|NO|NONE|N/A|NA|N\\.A\\.|-{1,4}|OPEN|I{1,3}|IV|V|[BCD])[,;]*(\\s|$)'))) AS is_value,
        regexp_matches(text, '[:?]$') AS is_marked FROM u)
SELECT set_id, page, line_no, is_value, is_marked, letters >= 2 AND (NOT is_value OR is_marked) AS is_label FROM v""")
def lay_types(spark, d):
    n = F.length("text") % 7
    t = lines(spark, d).where("trim(text) <> ''").withColumn(
        "text", F.when(n == 0, F.concat(F.trim("text"), F.lit(":"))).when(n == 1, F.concat(F.length("text").cast("string"), F.lit(" SF")))
        .when(n == 2, "Type II-B").when(n == 3, "no").when(n == 4, "group A-3").otherwise(F.trim("text")))
    return L.typed_segments(t).select("set_id", "page", "line_no", "is_value", "is_marked", "is_label")


@query("lay_col_header")
def lay_col_header(spark, d):
    heads = L.column_header(with_marks(spark, d))
    return heads.groupBy("set_id", "page").agg(F.count(F.lit(1)).alias("n"))


@query("lay_row_pairs")
def lay_row_pairs(spark, d):
    return L.row_values(with_marks(spark, d), WIDTH).select("set_id", "page", "label_id", "n", "value_id", "gap")


def with_marks(spark, d):
    """Segments in which every third opens a question, so values sit under and beside labels."""
    s = segs(spark, d)
    return s.withColumn("text", F.when(F.col("seg_id") % 3 == 0, F.concat(F.regexp_replace("text", "( 42)?[,.;]$", ""), F.lit(":")))
                        .otherwise(F.regexp_replace("text", ",$", "")))


@query("lay_stacked_pairs")
def lay_stacked_pairs(spark, d):
    """A row per line of each value that stands beneath its label; ``n`` counts the lines, ``head_id`` is a wrapped label's upper line."""
    s = L.stacked_values(with_marks(spark, d), WIDTH)
    return s.select("set_id", "page", "label_id", "head_id", "label", "distance", F.posexplode(F.arrays_zip("value_ids", "values")).alias("n", "v")).select(
        "set_id", "page", "label_id", "head_id", "label", F.col("v.value_ids").alias("value_id"), F.col("v.values").alias("value"), (F.col("n") + 1).alias("n"), "distance")


@query("lay_pair_assign")
def lay_pair_assign(spark, d):
    p = L.assign_pairs(with_marks(spark, d), WIDTH)
    return p.select("set_id", "page", "ord", "kind", "label", F.array_join("values", "|").alias("value"))


@query("lay_headings")
def lay_headings(spark, d):
    h = L.assign_pairs(with_marks(spark, d), WIDTH, headed=True)
    return h.select("set_id", "page", "label_id", F.array_join("context", "|").alias("context"), "heading")


@query("lay_reading_order", SEGS + """
SELECT set_id, page, CAST(seg_id AS INTEGER) AS seg_id, CAST(row_number() OVER (PARTITION BY set_id, page
       ORDER BY round_even((y0 + y1) / 2 / 10.0, 0), x0, seg_id) AS INTEGER) AS ord FROM segs""")
def lay_reading_order(spark, d):
    return L.reading_order(segs(spark, d)).select("set_id", "page", "seg_id", "ord")


@query("lay_row_bands", DUCK_WORDS + """
SELECT set_id, page, CAST(round_even(y0 / 5.0, 0) AS INTEGER) AS band, string_agg(text, ' ' ORDER BY x0, seq) AS text, min(y0) AS y0
FROM a_words GROUP BY set_id, page, band""")
def lay_row_bands(spark, d):
    return L.row_bands(words(spark, d), 5.0).select("set_id", "page", "band", "text", "y0")


@query("lay_row_sequential", DUCK_WORDS + """,
c AS (SELECT *, length(text) * 5 % 100 AS conf, CASE WHEN lag(x1) OVER w IS NULL OR x0 - lag(x1) OVER w > 12 THEN 1 ELSE 0 END AS b FROM a_words
      WINDOW w AS (PARTITION BY set_id, page, line ORDER BY x0)),
k AS (SELECT *, sum(b) OVER (PARTITION BY set_id, page, line ORDER BY x0) AS cell,
             dense_rank() OVER (PARTITION BY set_id, page ORDER BY line) AS row_ FROM c)
SELECT set_id, page, CAST(row_ AS INTEGER) AS row, cell, string_agg(text, ' ' ORDER BY x0) AS text, min(x0) AS x0, max(x1) AS x1,
       CAST(min(conf) AS BIGINT) AS conf FROM (SELECT * REPLACE (CAST(cell AS BIGINT) AS cell) FROM k) GROUP BY set_id, page, row_, cell""")
def lay_row_sequential(spark, d):
    w = words(spark, d).withColumn("conf", (F.length("text") * 5 % 100).cast("bigint"))
    return L.ocr_cells(w).select("set_id", "page", "row", "cell", "text", "x0", "x1", "conf")


@query("lay_column_strips", DUCK_WORDS + """,
r AS (SELECT *, max(x1) OVER (PARTITION BY set_id, page ORDER BY x0, seq, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a_words),
p AS (SELECT *, sum(CASE WHEN x0 - reach > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY set_id, page ORDER BY x0, seq, line ROWS UNBOUNDED PRECEDING) AS part,
             coalesce(x0 - reach > 15, FALSE) AS c FROM r),
k AS (SELECT *, c AND count(*) OVER (PARTITION BY set_id, page, part) >= 2
        AND bool_or(regexp_matches(text, '[:?]$')) OVER (PARTITION BY set_id, page, part) AS keep FROM p),
s AS (SELECT *, sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY set_id, page ORDER BY x0, seq, line ROWS UNBOUNDED PRECEDING) AS strip FROM k)
SELECT set_id, page, CAST(strip AS BIGINT) AS strip, count(*) AS n, sum(x0) AS sx FROM s GROUP BY set_id, page, strip""")
def lay_column_strips(spark, d):
    s = L.column_strips(words(spark, d))
    return s.groupBy("set_id", "page", "strip").agg(F.count(F.lit(1)).alias("n"), F.sum("x0").alias("sx"))


def rows(spark, d, mark=None):
    w = words(spark, d)
    if mark:
        w = w.withColumn("text", F.regexp_replace("text", ",$", mark))
    return L.row_bands(w, 6.0)


JUNK = ("trim(regexp_replace(regexp_replace({}, '^[\\|\\[\\]\\{{\\}}<>_\\-—–\\.,;:\\s]+', ''), '[\\|\\[\\]\\{{\\}}<>_\\s]+$', ''))")


@query("lay_split_gap", DUCK_WORDS + """,
g AS (SELECT set_id, page, line, list(text ORDER BY x0) AS ts, list(x0 ORDER BY x0) AS xs, list(x1 ORDER BY x0) AS xe FROM a_words
      GROUP BY set_id, page, line HAVING count(*) >= 2),
h AS (SELECT *, list_transform(range(1, len(ts)), lambda i: xs[i + 1] - xe[i]) AS gs FROM g),
w AS (SELECT *, list_max(gs) AS wide, list_sort(gs, 'DESC')[len(gs) // 2 + 1] AS med,
        list_max(list_filter(range(1, len(ts)), lambda i: gs[i] = list_max(gs))) AS gap_at,
        list_min(list_filter(range(1, len(ts)), lambda i: ts[i] LIKE '%:')) AS colon FROM h),
a AS (SELECT *, CASE WHEN wide > 0 THEN coalesce(colon, CASE WHEN NOT (med > 0 AND wide < 1.8 * med) THEN gap_at END) END AS at_ FROM w),
o AS (SELECT set_id, page, line * 2 AS band, """ + JUNK.format("regexp_replace(array_to_string(ts[1:at_], ' '), ':+$', '')") + """ AS label,
        """ + JUNK.format("array_to_string(ts[at_ + 1:], ' ')") + """ AS value FROM a WHERE at_ IS NOT NULL)
SELECT * FROM o WHERE label <> '' AND value <> ''""")
def lay_split_gap(spark, d):
    return L.split_label_value(rows(spark, d)).select("set_id", "page", "band", "label", "value")


@query("lay_split_pairs", DUCK_WORDS + """,
g AS (SELECT set_id, page, line, list(regexp_replace(text, ',$', ':') ORDER BY x0) AS ts FROM a_words GROUP BY set_id, page, line HAVING count(*) >= 2),
m AS (SELECT *, list_filter(range(1, len(ts) + 1), lambda i: regexp_matches(ts[i], '[:?]$')) AS ms FROM g),
u AS (SELECT *, generate_subscripts(ms, 1) AS j, unnest(ms) AS mk FROM m),
s AS (SELECT set_id, page, line, ts, j, mk, CASE WHEN j = 1 THEN 1 ELSE ms[j - 1] + 2 END AS a,
             CASE WHEN j = len(ms) THEN len(ts) ELSE mk + 1 END AS e FROM u),
o AS (SELECT set_id, page, line * 2 AS band, CAST(j AS INTEGER) AS pos,
       """ + JUNK.format("regexp_replace(CASE WHEN a > mk THEN '' ELSE array_to_string(ts[a:mk], ' ') END, '[:?]+$', '')") + """ AS label,
       """ + JUNK.format("CASE WHEN mk + 1 > e THEN '' ELSE array_to_string(ts[mk + 1:e], ' ') END") + """ AS value FROM s)
SELECT *, value = '' AS unanswered FROM o WHERE length(label) >= 3 AND length(value) <= 120""")
def lay_split_pairs(spark, d):
    return L.split_pairs(rows(spark, d, ":"), 3, 120).select("set_id", "page", "band", "pos", "label", "value", "unanswered")


@query("lay_banner_fill", DUCK_LINES + """,
t AS (SELECT set_id, page, line_no, CASE WHEN line_no % 5 = 0 THEN 'PER TABLE ' || CAST(1000 + length(text) % 30 AS VARCHAR) || '.2' ELSE text END AS text,
             line_no % 5 = 0 AS b FROM a_lines),
f AS (SELECT *, last_value(CASE WHEN b THEN text END IGNORE NULLS) OVER (PARTITION BY set_id, page ORDER BY line_no) AS banner FROM t)
SELECT set_id, page, line_no, banner, replace(banner, 'PER TABLE ', '') AS sections FROM f WHERE NOT b""")
def lay_banner_fill(spark, d):
    t = lines(spark, d).withColumn("text", F.when(F.col("line_no") % 5 == 0, F.concat(
        F.lit("PER TABLE "), (1000 + F.length("text") % 30).cast("string"), F.lit(".2"))).otherwise(F.col("text")))
    out = L.banner_fill(t, ["set_id", "page"], "line_no")
    return out.select("set_id", "page", "line_no", "banner", F.array_join("sections", ",").alias("sections"))


@query("lay_block_window", DUCK_WORDS + """,
h AS (SELECT set_id, page, lower(text) AS header, arg_min(x0, ROW(-y0, seq)) AS x0, max(y0) AS y0 FROM a_words
      WHERE lower(text) IN ('the', 'und', 'les', 'of') GROUP BY set_id, page, header),
w AS (SELECT set_id, page, header, x0 - 65.0 AS wx0, y0 AS wy0, x0 + 310.0 AS wx1, y0 + 260.0 AS wy1 FROM h)
SELECT w.set_id, w.page, header, round(wx0, 4) AS wx0, round(wy1, 4) AS wy1, count(*) AS n FROM w JOIN a_words a ON a.set_id = w.set_id AND a.page = w.page
 AND a.x0 < wx1 AND a.x1 > wx0 AND a.y0 < wy1 AND a.y1 > wy0 GROUP BY ALL""")
def lay_block_window(spark, d):
    w = words(spark, d)
    hits = w.where(F.lower("text").isin("the", "und", "les", "of")).withColumn("header", F.lower("text"))
    pages = w.select("set_id", "page").distinct().select("*", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    inside = L.words_in_windows(w, L.block_windows(hits, pages))
    return inside.groupBy("set_id", "page", "header", F.round("wx0", 4).alias("wx0"), F.round("wy1", 4).alias("wy1")).agg(
        F.count(F.lit(1)).alias("n"))


CITED = DUCK_LINES + """,
t AS (SELECT set_id, page, line_no, length(text) AS n, substr(regexp_replace(text, '[^A-Za-z]', '', 'g'), 1, 9) AS lab FROM a_lines)
"""


def cited(spark, d):
    n = F.length("text")
    lab = F.substring(F.regexp_replace("text", "[^A-Za-z]", ""), 1, 9)
    shape = F.when(n % 4 == 0, F.concat(n.cast("string"), F.lit(" LF 12'-6\""))).when(
        n % 4 == 1, F.concat(n.cast("string"), F.lit('" 60"'))).when(n % 4 == 2, F.concat(n.cast("string"), F.lit(" 3"))).otherwise("for the")
    text = F.concat(lab, F.lit(" ("), (1000 + n % 30).cast("string"), F.lit("."), (n % 5).cast("string"), F.lit("): "), shape)
    return lines(spark, d).withColumn("text", text)


@query("lay_cited_rows", CITED + """
SELECT set_id, page, line_no, lab AS label, CAST(1000 + n % 30 AS VARCHAR) || '.' || CAST(n % 5 AS VARCHAR) AS section,
       CASE n % 4 WHEN 0 THEN 'ft' WHEN 1 THEN 'in' ELSE 'count' END AS unit, CAST(n AS DOUBLE) AS required,
       CASE n % 4 WHEN 0 THEN 12.5 WHEN 1 THEN 60.0 ELSE 3.0 END::DOUBLE AS provided FROM t WHERE n % 4 <> 3""")
def lay_cited_rows(spark, d):
    return L.cited_rows(cited(spark, d)).select("set_id", "page", "line_no", "label", "section", "unit", "required", "provided")


@query("lay_labelled_values", DUCK_LINES + """,
t AS (SELECT set_id, page, line_no, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.]$', '') ||
        CASE length(text) % 3 WHEN 0 THEN ' 1,436 YES' WHEN 1 THEN ' 32"' ELSE '' END AS text FROM a_lines WHERE trim(text) <> ''),
x AS (SELECT *, regexp_extract(text, '^(.*?)((?:\\s(?i:[\\d.,]+["'']?|LF|FT|IN|YES|NO|N/A))+)$', 1) AS l,
             regexp_extract(text, '^(.*?)((?:\\s(?i:[\\d.,]+["'']?|LF|FT|IN|YES|NO|N/A))+)$', 2) AS v FROM t)
SELECT set_id, page, line_no, regexp_replace(l, '^[ :.]+|[ :.]+$', '', 'g') AS label, trim(v) AS value FROM x
WHERE v <> '' AND l <> '' AND NOT regexp_full_match(text, '(?:(?i:[\\d.,]+["'']?|LF|FT|IN|YES|NO|N/A)(\\s|$))+')""")
def lay_labelled_values(spark, d):
    n = F.length("text") % 3
    text = F.concat(F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), "[.]$", ""),
                    F.when(n == 0, " 1,436 YES").when(n == 1, ' 32"').otherwise(""))
    t = lines(spark, d).where("trim(text) <> ''").withColumn("text", text)
    return L.labelled_values(t).select("set_id", "page", "line_no", "label", "value")


@query("lay_cited_once", CITED + """,
r AS (SELECT set_id, page, line_no, lab AS label, CAST(1000 + n % 30 AS VARCHAR) || '.' || CAST(n % 5 AS VARCHAR) AS section, CAST(n AS DOUBLE) AS required FROM t WHERE n % 4 <> 3)
SELECT set_id, section, label, 'S-' || CAST(page AS VARCHAR) AS sheet, min(line_no) AS band, arg_min(required, line_no) AS required FROM r GROUP BY ALL""")
def lay_cited_once(spark, d):
    """A row met twice on a sheet is one row, where it stands first."""
    rows = L.cited_rows(cited(spark, d)).select("set_id", "page", "label", "section", "required", F.col("line_no").alias("band"), F.concat(F.lit("S-"), F.col("page").cast("string")).alias("sheet"))
    return L.dedupe_cited(rows).select("set_id", "section", "label", "sheet", "band", "required")


@query("lay_asks", ORACLE["lay_find_value"].split("SELECT set_id, arg_min")[0] + "SELECT DISTINCT set_id FROM k WHERE contains(key, 'THE')")
def lay_asks(spark, d):
    """Sets that ask a question at all, answered or not."""
    return L.poses(L.inline_pairs(marked_lines(spark, d)), ["the"])
