"""Views that let the driver tables play the review's tables.

The driver tables hold no drawings. Each adapter is one SELECT over whole tables, written in the
SQL both engines read, so a query and its oracle start from the same rows and only the operator
under test is worked out twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from planlens.plans.registry import table

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

VIEWS: dict[str, str] = {
    # a claim per order line: the order is the set, the return flag the field
    "a_claims": """
        SELECT l_orderkey AS set_id, l_returnflag AS field, '' AS role, 'num' AS value_type,
               l_quantity AS value_num, CAST(NULL AS STRING) AS value_str,
               CAST(NULL AS BOOLEAN) AS value_bool, CAST(l_partkey AS STRING) AS raw,
               l_linenumber AS page,
               concat(CASE WHEN l_suppkey % 3 = 0 THEN 'G-' ELSE 'A-' END,
                      CAST(l_linenumber AS STRING)) AS sheet,
               l_linestatus AS method, l_returnflag AS label, round(1 - l_discount, 2) AS score,
               l_partkey * 1000000 + l_suppkey AS seq
        FROM {lineitem}""",
    "a_declared": """
        SELECT o_orderkey AS set_id, o_totalprice AS total,
               floor(o_totalprice / 100000) + 1 AS stories, o_orderpriority AS zoning
        FROM {orders}""",
    "a_drawn": """
        SELECT l_orderkey AS set_id,
               round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS total,
               CAST(count(*) AS DOUBLE) AS stories, max(l_returnflag) AS zoning,
               min(l_linenumber) AS page
        FROM {lineitem} GROUP BY l_orderkey""",
    # the order is the set, the part's brand the rule
    "a_findings": """
        SELECT l.l_orderkey AS set_id, p.p_brand AS rule_id,
               concat('F-', substr(p.p_brand, 7)) AS fid,
               CASE WHEN l.l_returnflag = 'A' THEN 'PASS'
                    WHEN l.l_returnflag = 'N' AND round(l.l_discount * 100) >= 7 THEN 'CONFLICT'
                    ELSE 'OPEN' END AS status,
               CASE WHEN l.l_returnflag = 'A' AND round(l.l_tax * 100) >= 6 THEN 'MEASURED'
                    WHEN l.l_returnflag = 'A' THEN 'VERIFIED'
                    WHEN round(l.l_discount * 100) >= 8 THEN 'CRITICAL'
                    WHEN round(l.l_discount * 100) >= 5 THEN 'HIGH'
                    WHEN round(l.l_discount * 100) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
               l.l_linenumber AS page, concat('S-', CAST(l.l_linenumber AS STRING)) AS sheet,
               p.p_type AS anchor, p.p_name AS title,
               CASE WHEN round(l.l_tax * 100) <= 2 THEN 'declaration'
                    WHEN round(l.l_tax * 100) <= 4 THEN 'both' ELSE 'drawings' END AS basis,
               CASE WHEN l.l_suppkey % 10 = 0 THEN 'as_declared'
                    WHEN l.l_suppkey % 10 = 1 THEN 'as_drawn' ELSE 'both' END AS scenario,
               l.l_quantity AS qty, l.l_extendedprice AS price, l.l_suppkey AS supp
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    # both readings of every set: the declared one changes some findings and lacks others
    "a_readings": """
        SELECT set_id, rule_id, fid, status, severity, page, sheet, anchor, title, basis,
               'as_drawn' AS scenario FROM {a_findings} WHERE qty > 5
        UNION ALL
        SELECT set_id, rule_id, fid, status,
               CASE WHEN basis = 'declaration' AND severity = 'HIGH' THEN 'MEDIUM' ELSE severity END,
               page, sheet, anchor, title, basis, 'as_declared' AS scenario
        FROM {a_findings} WHERE qty < 45""",
    "a_abstentions": """
        SELECT l_orderkey AS set_id, concat('Brand#', CAST(1 + l_suppkey % 25 AS STRING)) AS rule_id,
               CASE l_linenumber WHEN 1 THEN 'occupant load not extracted'
                    WHEN 2 THEN 'neither the drawings nor the declaration state this'
                    WHEN 3 THEN 'Table 504.4 row not carried in this build''s corpus'
                    WHEN 4 THEN 'no CAD layer matching the egress path'
                    WHEN 5 THEN 'rule raised'
                    WHEN 6 THEN 'no parseable 1017.2 datum'
                    ELSE 'so there is nothing to compare' END AS reason,
               l_linenumber AS page, l_returnflag AS detail
        FROM {lineitem}""",
    "a_profile": """
        SELECT p_brand AS rule_id, 'active' AS profile_id, 1 AS version,
               count(*) % 7 <> 0 AS enabled, CAST(sum(p_size) % 5 AS INT) - 2 AS severity_shift,
               CASE sum(p_size) % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' END AS severity_cap,
               CASE sum(p_size) % 9 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'LOW' END AS severity_floor,
               CASE WHEN count(*) % 4 = 0 THEN 'B' WHEN count(*) % 4 = 1 THEN 'M' END AS scope_occ,
               CASE WHEN count(*) % 5 = 0 THEN 'declaration' END AS scope_bas,
               count(*) % 3 = 0 AS drop_verified,
               1 + CAST(sum(p_size) % 5 AS DOUBLE) / 2 AS weight,
               CAST(sum(p_size) % 6 AS INT) AS confirmations
        FROM {part} GROUP BY p_brand""",
    # a second version of the profile, for diffs
    "a_profile2": """
        SELECT p_brand AS rule_id, 'active' AS profile_id, 2 AS version,
               count(*) % 6 <> 0 AS enabled, CAST(sum(p_size) % 3 AS INT) - 1 AS severity_shift,
               CASE sum(p_size) % 6 WHEN 0 THEN 'HIGH' WHEN 2 THEN 'LOW' END AS severity_cap,
               CASE sum(p_size) % 9 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'LOW' END AS severity_floor,
               CASE WHEN count(*) % 4 = 0 THEN 'B' END AS scope_occ,
               CASE WHEN count(*) % 5 = 0 THEN 'declaration' END AS scope_bas,
               count(*) % 3 = 0 AS drop_verified,
               1 + CAST(sum(p_size) % 5 AS DOUBLE) / 2 AS weight,
               CAST(sum(p_size) % 6 AS INT) AS confirmations
        FROM {part} WHERE p_retailprice > 905 GROUP BY p_brand""",
    "a_set_group": """
        SELECT o_orderkey AS set_id,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A-3' WHEN '2' THEN 'B'
                    WHEN '3' THEN 'M' WHEN '4' THEN 'S-1' ELSE '' END AS occupancy_group
        FROM {orders}""",
    "a_feedback": """
        SELECT conv_id * 1000 + turn AS id, conv_id AS set_id,
               concat('u', CAST(conv_id % 7 AS STRING)) AS uid,
               concat('Brand#', CAST(1 + length(text) % 25 AS STRING)) AS rule_id,
               CASE WHEN length(text) % 11 = 0 THEN 'nonsense' ELSE 'finding' END AS subject,
               CASE length(text) % 7 WHEN 0 THEN 'correct' WHEN 1 THEN 'false_positive'
                    WHEN 2 THEN 'not_applicable' WHEN 3 THEN 'right_wrong_reason'
                    WHEN 4 THEN 'duplicate' WHEN 5 THEN 'bogus' END AS a_conclusion,
               CASE length(text) % 5 WHEN 0 THEN 'right' WHEN 1 THEN 'overstated'
                    WHEN 2 THEN 'understated' WHEN 3 THEN 'not_a_finding' END AS a_severity,
               CASE length(text) % 13 WHEN 0 THEN 'wrong_section' WHEN 1 THEN 'right' END AS a_citation,
               CASE length(text) % 17 WHEN 0 THEN 'x' END AS a_colour,
               CASE WHEN length(text) % 3 = 0 THEN text ELSE '' END AS comment,
               CASE length(text) % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'new' END AS state,
               CASE length(text) % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'M' ELSE '' END AS occupancy_group,
               conv_id * 600 + turn * 7 AS created_at
        FROM {conversations} WHERE role = 'user'""",
    # every order as a building its applicant declared
    "a_building": """
        SELECT o_orderkey AS set_id,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A-3' WHEN '2' THEN 'B'
                    WHEN '3' THEN 'M' WHEN '4' THEN 'S-1' END AS occupancy_group,
               CASE o_custkey % 9 WHEN 0 THEN 'I-A' WHEN 1 THEN 'I-B' WHEN 2 THEN 'II-A' WHEN 3 THEN 'II-B'
                    WHEN 4 THEN 'III-A' WHEN 5 THEN 'III-B' WHEN 6 THEN 'IV' WHEN 7 THEN 'V-A' ELSE 'V-B' END
                    AS construction_type,
               CASE o_orderstatus WHEN 'F' THEN 'nfpa13' WHEN 'O' THEN 'none' ELSE 'nfpa13d' END AS sprinkler_system,
               round(o_totalprice / 5000, 1) AS height_ft,
               CAST(floor(o_totalprice / 100000) AS INT) + 1 AS stories,
               floor(o_totalprice / 5) AS building_area_sf,
               CAST(120 + o_custkey % 60 AS DOUBLE) AS wind_speed_mph,
               CASE o_custkey % 5 WHEN 0 THEN 'fbc2017' WHEN 1 THEN 'fbc2020' WHEN 2 THEN 'fbc2023'
                    WHEN 3 THEN 'fbc2026' END AS code_edition,
               CASE o_custkey % 6 WHEN 0 THEN 'III' WHEN 1 THEN 'II' END AS risk_category,
               CASE WHEN o_custkey % 4 <> 0 THEN CAST(floor(o_totalprice / 400) AS DOUBLE) END AS occupant_load,
               CAST(o_orderdate + INTERVAL '25' YEAR AS DATE) AS as_of
        FROM {orders}""",
    # the rows of every building's code block: the line number picks the section
    "a_code": """
        SELECT l_orderkey AS set_id,
               CASE l_linenumber WHEN 1 THEN '1006.2.1' WHEN 2 THEN '1017.2' WHEN 3 THEN '1020.5' WHEN 4 THEN '1020.3'
                    WHEN 5 THEN '1005.3.2' WHEN 6 THEN '1006.3.2' ELSE '1010.1.1' END AS section,
               CASE l_linenumber WHEN 1 THEN CASE WHEN l_quantity < 25 THEN 75 ELSE 100 END
                    WHEN 2 THEN CASE WHEN l_quantity < 20 THEN 200 WHEN l_quantity < 40 THEN 250 ELSE 300 END
                    WHEN 3 THEN CASE WHEN l_quantity < 30 THEN 20 ELSE 50 END
                    WHEN 4 THEN CASE WHEN l_quantity < 40 THEN 44 ELSE 36 END
                    WHEN 5 THEN 20 + l_quantity WHEN 6 THEN 2
                    ELSE CASE WHEN l_quantity < 40 THEN 32 ELSE 30 END END AS required,
               CASE l_linenumber WHEN 6 THEN CASE WHEN l_quantity < 30 THEN 2 ELSE 3 END ELSE 60 END AS provided,
               l_linenumber AS page, concat('G-', CAST(l_linenumber AS STRING)) AS sheet, 'ROW' AS label,
               'as printed' AS required_raw, l_partkey * 1000000 + l_suppkey AS ord
        FROM {lineitem}""",
    "a_jobs": """
        SELECT event_id AS job_id, user_id AS uid, ts, event_type, value, props FROM {events}""",
}


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS[name])


def adapter(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An adapter view as a DataFrame over one data folder."""
    if name in TABLES:
        return table(spark, folder, name)
    return spark.sql(VIEWS[name], **{n: adapter(spark, folder, n) for n in set(_needs(name))})


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` holding the named adapters, for an oracle."""
    done: list[str] = []

    def visit(n: str) -> None:
        if n in TABLES or n in done:
            return
        for m in _needs(n):
            visit(m)
        done.append(n)
    for n in names:
        visit(n)
    body = [f"{n} AS ({VIEWS[n].format(**{m: m for m in _needs(n)})})" for n in done]
    return "WITH " + ",\n".join(body)


# ---- text adapters: lines and positioned words of the documents ----------------------------------
# ten documents make a set, each is a page; a comma is a column break 30 points wide and every
# part before one ends in a number, so pages hold labels, values and columns

PAGE_TEXT = 2 << 20  # bytes of the files a task takes, so its words are sorted in memory


def lines(spark: SparkSession, folder: str, by_page: bool = False) -> DataFrame:
    from pyspark.sql import functions as F
    docs = table(spark, folder, "documents").select(
        F.floor(F.col("doc_id") / 10).alias("set_id"), (F.col("doc_id") % 10).cast("int").alias("page"), "text")
    if by_page:  # a task's words are some fifty times its share of the files
        size = int(table(spark, folder, "documents")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        docs = docs.repartition(max(spark.sparkContext.defaultParallelism, min(size // PAGE_TEXT, 20000)), "set_id", "page")
    return docs.select("set_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def words(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of a page with its place. A page's text moves once, before it is cut: what works by page or line finds its words together."""
    from pyspark.sql import Window as W, functions as F
    parts = lines(spark, folder, by_page=True).select(
        "set_id", "page", F.col("line_no").alias("line"),
        F.posexplode(F.split(F.regexp_replace("text", ", ", " 42, "), " ")).alias("pos", "text")).where("text <> ''")
    before = W.partitionBy("set_id", "page", "line").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    step = (F.length("text") + 1) * 6.0 + F.when(F.col("text").endswith(","), 30.0).otherwise(0.0)
    x0 = F.coalesce(F.sum(step).over(before), F.lit(0.0))
    return parts.select("set_id", "page", F.lit(0).alias("block"), "line", F.col("pos").alias("seq"),
                        x0.alias("x0"), (F.col("line") * 12.0).alias("y0"),
                        (x0 + F.length("text") * 6.0).alias("x1"), (F.col("line") * 12.0 + 10.0).alias("y1"), "text")


DUCK_LINES = """WITH a_lines AS (
  SELECT doc_id // 10 AS set_id, CAST(doc_id % 10 AS INTEGER) AS page, CAST(i - 1 AS INTEGER) AS line_no, t AS text
  FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS t
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""
DUCK_WORDS = DUCK_LINES + """,
w0 AS (SELECT set_id, page, line_no AS line, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS seq, unnest(l) AS text
       FROM (SELECT *, string_split(replace(text, ', ', ' 42, '), ' ') AS l FROM a_lines)),
a_words AS (
  SELECT set_id, page, 0 AS block, line, seq, x0, line * 12.0::DOUBLE AS y0, x0 + length(text) * 6.0::DOUBLE AS x1,
         line * 12.0::DOUBLE + 10.0 AS y1, text
  FROM (SELECT *, coalesce(sum((length(text) + 1) * 6.0::DOUBLE + CASE WHEN text LIKE '%,' THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END)
               OVER (PARTITION BY set_id, page, line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS x0
        FROM w0 WHERE text <> ''))"""
