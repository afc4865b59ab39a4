"""The register: merging two readings, ordering, keys, evidence, counts, edits and grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from planlens.functions import vocabulary as V
from planlens.operators.grounding import locate_words
from planlens.operators.helpers import name_of, numbered, rank_of
from planlens.session import cut_lineage

CONTENT = ["status", "severity", "discipline", "page", "title", "result", "code", "action", "basis"]


def merge_scenarios(findings: DataFrame, content: list[str] | None = None,
                    order: list[str] | None = None) -> DataFrame:
    """Fold the two readings of a set into one register.

    Findings pair up on (rule, sheet, anchor, fid) and their ordinal within it. A pair equal in
    everything else is one row ``both``; the rest keep the reading that produced them.
    """
    content = content or [c for c in CONTENT if c in findings.columns]
    key = ["set_id", "rule_id", "sheet", "anchor", "fid"]
    w = W.partitionBy(*key, "scenario").orderBy(*(order or content))
    f = findings.withColumn("_n", F.row_number().over(w))
    # one shuffle on the pairing key: the twin is looked up by a window, not a self join
    pair = W.partitionBy(*key, "_n")
    twins = F.count(F.lit(1)).over(pair) == 2
    same = F.size(F.collect_set(F.struct(*content)).over(pair)) == 1  # two rows at most
    merged = (f.withColumn("_both", twins & same)
              .where(~F.col("_both") | (F.col("scenario") == "as_drawn"))
              .withColumn("scenario", F.when(F.col("_both"), "both").otherwise(F.col("scenario"))))
    return merged.drop("_both", "_n")


def dedupe_abstentions(abstentions: DataFrame) -> DataFrame:
    return abstentions.dropDuplicates(["set_id", "rule_id", "reason", "page", "detail"])


def severity_floor(findings: DataFrame, options: DataFrame) -> DataFrame:
    """Keep what each set's options ask for: a floor on the ramp and two switches.

    ``options``: set_id, min_severity, include_verified, include_measured.
    """
    f = findings.join(options, "set_id", "left")
    ramp = rank_of(F.col("severity"), V.RAMP)
    floor = rank_of(F.coalesce("min_severity", F.lit("LOW")), V.RAMP)
    keep = (F.when(F.col("severity") == "VERIFIED", F.coalesce("include_verified", F.lit(True)))
            .when(F.col("severity") == "MEASURED", F.coalesce("include_measured", F.lit(True)))
            .otherwise((ramp == 9) | (ramp <= floor)))
    return f.where(keep).select(*findings.columns)


def order_register(findings: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """``ord`` per set: severity (verified before measured), page, fid, reading."""
    f = findings.withColumn("_rank", rank_of(F.col("severity"), V.RULE_ORDER))
    return numbered(f, ["set_id"], ["_rank", "page"], ["fid", "scenario", *(ties or [])]).drop("_rank")


def finding_keys(ordered: DataFrame) -> DataFrame:
    """A unique key per finding: fid, ``@as_declared`` for a twin, ``~n`` for a repeat."""
    base = F.when(F.col("scenario") == "as_declared",
                  F.concat("fid", F.lit("@as_declared"))).otherwise(F.col("fid"))
    n = F.row_number().over(W.partitionBy("set_id", "_base").orderBy("ord"))
    return (ordered.withColumn("_base", base).withColumn("_n", n)
            .withColumn("key", F.when(F.col("_n") == 1, F.col("_base")).otherwise(
                F.concat("_base", F.lit("~"), F.col("_n").cast("string"))))
            .drop("_base", "_n"))


def evidence(findings: DataFrame, resolved: DataFrame, rule_fields: DataFrame) -> DataFrame:
    """The facts each finding rests on, one row per fact in the rule's own order.

    ``rule_fields``: rule_id, ord, field, role. ``resolved``: set_id, field, role, value, quote,
    sheet, page, method, basis, confidence. The rows stay rows: a set with very many findings
    spreads over tasks.
    """
    wanted = findings.join(F.broadcast(rule_fields.withColumnRenamed("ord", "fact_ord")), "rule_id")
    facts = resolved.select("set_id", "field", "role", F.col("value").alias("fact_value"),
                            F.col("quote"), F.col("sheet").alias("fact_sheet"),
                            F.col("page").alias("fact_page"), F.col("method"),
                            F.col("basis").alias("fact_basis"), "confidence")
    printed = F.when(F.col("fact_basis").isin("measured", "computed"), "").otherwise(F.col("quote"))
    note = (F.when(F.col("fact_basis").isin("measured", "computed"), "not printed on the sheet")
            .when(F.col("method") == "ai", "proposed reading, verified on the sheet")
            .when(F.col("method") == "cad", "read from the drawing's own attribute").otherwise(""))
    return (wanted.join(facts, ["set_id", "field", "role"])
            .withColumn("quote", printed).withColumn("fact_note", note))


def viewer_rect(box: str, width: str, height: str, rotation: str) -> list[Column]:
    """x0..y1 of a box in the space a viewer draws the rotated page in, to a tenth."""
    x0, y0, x1, y1 = (F.col(f"{box}{c}") for c in ("x0", "y0", "x1", "y1"))
    w, h, r = F.col(width), F.col(height), F.pmod(F.col(rotation), F.lit(360))
    def turn(upright, quarter, half, three):
        return F.bround(F.when(r == 90, quarter).when(r == 180, half).when(r == 270, three)
                        .otherwise(upright), 1)
    return [turn(x0, h - y1, w - x1, y0).alias("vx0"), turn(y0, x0, h - y1, w - x1).alias("vy0"),
            turn(x1, h - y0, w - x0, y1).alias("vx1"), turn(y1, x1, h - y0, w - x0).alias("vy1")]


def summary(findings: DataFrame, scale_pages: DataFrame | None = None) -> DataFrame:
    """Counts per set: by severity, open, verified, conflicts, and pages with a scale."""
    sev, st = F.col("severity"), F.col("status")
    out = findings.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("findings_count"),
        *[F.count_if(sev == s).alias(f"n_{s.lower()}") for s in V.RULE_ORDER],
        F.count_if(st.isin(V.ACTIONABLE)).alias("n_open"),
        F.count_if(~st.isin(V.ACTIONABLE)).alias("n_passed"),
        F.count_if(st == "CONFLICT").alias("n_conflicts"))
    if scale_pages is not None:
        counted = scale_pages.groupBy("set_id").agg(
            F.count_if("scale_resolved").alias("scale_pages"))
        out = out.join(counted, "set_id", "left")
    return out


def sheet_rail(pages: DataFrame, findings: DataFrame, markups: DataFrame) -> DataFrame:
    """Every page with its open findings, worst open severity, markups and comments."""
    worst = rank_of(F.col("severity"), V.RULE_ORDER)
    f = (findings.where("status <> 'PASS'").groupBy("set_id", "page")
         .agg(F.count(F.lit(1)).alias("n_open"), F.min(worst).alias("_worst")))
    m = markups.groupBy("set_id", "page").agg(
        F.count(F.lit(1)).alias("n_marks"), F.count_if(F.trim("comment") != "").alias("n_comments"))
    out = pages.join(f, ["set_id", "page"], "left").join(m, ["set_id", "page"], "left")
    return (out.fillna(0, ["n_open", "n_marks", "n_comments"])
            .withColumn("severity", F.when(F.col("_worst").isNull(), "").otherwise(
                name_of(F.col("_worst"), V.RULE_ORDER)))
            .drop("_worst"))


def edit_state(edit_status: Column, edit_severity: Column, status: Column, severity: Column) -> Column:
    """struct(status, severity, why): where an edit leaves a finding, or why it cannot."""
    s, v = F.coalesce(edit_status, F.lit("")), F.coalesce(edit_severity, F.lit(""))
    status, severity = F.coalesce(status, F.lit("")), F.coalesce(severity, F.lit(""))
    new_v = F.when(v == "", severity).otherwise(v)
    on_ramp, passing = v.isin(V.RAMP), v.isin(V.PASSING)
    why = (F.when((s == "PASS") & on_ramp, "a passing check cannot carry a problem severity")
           .when((s == "OPEN") & passing, "an open finding needs a problem severity")
           .when((s == "OPEN") & ~new_v.isin(V.RAMP), "an open finding needs a severity")
           .otherwise(""))
    out_v = F.when((s == "PASS") & ~new_v.isin(V.PASSING), "VERIFIED").otherwise(new_v)
    acting = status.isin(V.ACTIONABLE)
    out_s = (F.when(s != "", s).when(on_ramp & ~acting, "OPEN").when(passing & acting, "PASS")
             .otherwise(status))
    return F.struct(F.when(why == "", out_s).otherwise(status).alias("status"),
                    F.when(why == "", out_v).otherwise(severity).alias("severity"), why.alias("why"))


def apply_edits(keyed: DataFrame, edits: DataFrame) -> DataFrame:
    """Findings after their edits, applied in (pass, ordinal) order per finding.

    ``keyed``: findings with their key. ``edits``: set_id, key, pass, ordinal, op (revise or
    withdraw), status, severity, title, reason, quote, quote_found. Edits of one finding form
    the ordered unit; edits of different findings never meet. Output keeps the final values, the
    previous status and severity, how many edits held, the rejections, and whether it was
    withdrawn. A row that an edit creates carries ``born`` (pass, ordinal): edits before it find no such key.
    """
    born = F.col("born") if "born" in keyed.columns else F.lit(None).cast("struct<pass:int,ordinal:int>")
    step = F.struct("pass", "ordinal", "op", "status", "severity", "title", "reason", "quote",
                    "quote_found")
    per = edits.groupBy("set_id", "key").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    f = keyed.join(per, ["set_id", "key"], "left")
    no_text = F.array().cast("array<struct<pass:int,ordinal:int,why:string>>")
    zero = F.struct(F.col("status"), F.col("severity"), F.col("title"), F.lit(0).alias("held"),
                    F.lit(0).cast("int").alias("last_pass"), F.lit(False).alias("gone"),
                    no_text.alias("rejected"))

    def merge(acc: Column, e: Column) -> Column:
        st = edit_state(e["status"], e["severity"], acc["status"], acc["severity"])
        moved = (st["status"] != acc["status"]) | (st["severity"] != acc["severity"])
        title = F.coalesce(F.nullif(F.trim(e["title"]), F.lit("")), acc["title"])
        quoted = F.trim(F.coalesce(e["quote"], F.lit(""))) != ""
        found = quoted & F.coalesce(e["quote_found"], F.lit(False))
        early = born.isNotNull() & (F.struct(e["pass"].alias("pass"), e["ordinal"].alias("ordinal")) < born)
        why = (F.when(acc["gone"] | F.coalesce(early, F.lit(False)), "no finding has the key")
               .when(F.trim(F.coalesce(e["reason"], F.lit(""))) == "", "an edit needs a reason")
               .when((e["op"] == "withdraw") & ~found, "withdrawing needs a quote printed on the sheet")
               .when(e["op"] == "withdraw", "")
               .when(st["why"] != "", st["why"])
               .when(moved & ~found, "changing a severity or status needs a quote printed on the sheet")
               .when(quoted & ~found, "the quote was not found on that page")
               .when(~moved & (title == acc["title"]), "the edit changes nothing").otherwise(""))
        ok = why == ""
        revise = ok & (e["op"] == "revise")
        note = F.struct(e["pass"].alias("pass"), e["ordinal"].alias("ordinal"), why.alias("why"))
        return F.struct(
            F.when(revise, st["status"]).otherwise(acc["status"]).alias("status"),
            F.when(revise, st["severity"]).otherwise(acc["severity"]).alias("severity"),
            F.when(revise, title).otherwise(acc["title"]).alias("title"),
            (acc["held"] + F.when(ok, 1).otherwise(0)).alias("held"),
            F.when(ok, e["pass"]).otherwise(acc["last_pass"]).alias("last_pass"),
            (acc["gone"] | (ok & (e["op"] == "withdraw"))).alias("gone"),
            F.when(ok, acc["rejected"]).otherwise(F.concat(acc["rejected"], F.array(note)))
            .alias("rejected"))

    empty = F.array().cast("array<struct<pass:int,ordinal:int,op:string,status:string,"
                           "severity:string,title:string,reason:string,quote:string,"
                           "quote_found:boolean>>")
    done = f.withColumn("_e", F.aggregate(F.coalesce("steps", empty), zero, merge))
    keep = [c for c in keyed.columns if c not in ("status", "severity", "title", "born")]
    return done.select(*keep, F.col("status").alias("was_status"), F.col("severity").alias("was_severity"),
                       "_e.*")


def judged_adds(edits: DataFrame) -> DataFrame:
    """``add`` edits with their status and severity, and why one does not hold ('' when it does)."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    st = edit_state(F.col("status"), F.col("severity"), F.lit(""), F.lit(""))
    why = (F.when(blank("reason"), "an edit needs a reason").when(blank("title"), "a new finding needs a title")
           .when(F.col("_s.why") != "", F.col("_s.why")).when(F.col("_s.status") == "", "a new finding needs a severity or a status")
           .when(blank("quote") | ~F.coalesce("quote_found", F.lit(False)), "the quote was not found on that page").otherwise(""))
    return edits.where("op = 'add'").withColumn("_s", st).withColumn("why", why)


def added_findings(edits: DataFrame) -> DataFrame:
    """``add`` edits that hold, as findings numbered in (pass, ordinal) order per set: their number is their key."""
    good = numbered(judged_adds(edits).where("why = ''"), ["set_id"], ["pass"], ["ordinal"], "_n")
    fid = F.format_string("AI-%02d", F.col("_n"))
    return good.select("set_id", fid.alias("fid"), fid.alias("key"), F.col("_s.status").alias("status"), F.col("_s.severity").alias("severity"), "title", "page",
                       F.struct(F.col("pass").cast("int").alias("pass"), F.col("ordinal").cast("int").alias("ordinal")).alias("born"))


def review_edits(keyed: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, rejected): the register after all edits of a review, and each edit that does not hold with why.

    Additions become keyed rows first, since whether one holds depends on nothing but itself; then
    the edits of every key, old and new, are applied in order. ``findings`` are as from
    ``apply_edits`` with ``added``; ``rejected``: set_id, key, pass, ordinal, why.
    """
    rest = edits.where("op <> 'add'")
    both = keyed.withColumn("added", F.lit(False)).unionByName(added_findings(edits).withColumn("added", F.lit(True)), allowMissingColumns=True)
    done = cut_lineage(apply_edits(both, rest))
    held_back = done.select("set_id", "key", F.explode("rejected").alias("r")).select("set_id", "key", "r.*")
    unknown = rest.join(both.select("set_id", "key"), ["set_id", "key"], "left_anti").select("set_id", "key", "pass", "ordinal", F.lit("no finding has the key").alias("why"))
    adds = judged_adds(edits).where("why <> ''").select("set_id", F.lit(None).cast("string").alias("key"), "pass", "ordinal", "why")
    return done, held_back.unionByName(unknown).unionByName(adds)


def prove_quotes(edits: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """``edits`` with ``quote_found`` and ``box``: whether their quote is printed on their page, and where."""
    edits = edits.drop("quote_found", "box").withColumn("prop_id", F.shiftleft(F.col("pass").cast("long"), 32) + F.col("ordinal"))
    asked = edits.where("trim(quote) <> ''").select("set_id", "page", "prop_id", "quote", F.lit("").alias("value"))
    at = locate_words(asked, words, pages).select("set_id", "page", "prop_id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    return edits.join(at, ["set_id", "page", "prop_id"], "left").withColumn("quote_found", F.col("box").isNotNull()).drop("prop_id")


def withdrawal_abstentions(edited: DataFrame) -> DataFrame:
    return edited.where("gone").select(
        "set_id", "rule_id", F.lit("withdrawn by the result review").alias("reason"), "page",
        F.col("fid").alias("detail"))


def fingerprint(findings: DataFrame, abstentions: DataFrame) -> DataFrame:
    """A content hash of each set's register that does not depend on row order.

    Row hashes are summed in two independent exact decimals, so sets of any size aggregate with
    map-side combine instead of collecting their rows.
    """
    def hashed(df: DataFrame, cols: list[str], tag: str) -> DataFrame:
        text = F.to_json(F.struct(F.lit(tag).alias("t"), *cols))
        return df.select("set_id", F.xxhash64(text).cast("decimal(38,0)").alias("h1"),
                         F.xxhash64(F.concat(F.lit("#"), text)).cast("decimal(38,0)").alias("h2"))
    rows = hashed(findings, [c for c in ("fid", "rule_id", "status", "severity", "sheet", "page", "title")
                             if c in findings.columns], "f").unionByName(
        hashed(abstentions, ["rule_id", "reason", "detail"], "a"))
    return rows.groupBy("set_id").agg(
        F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum("h1").cast("string"),
                           F.sum("h2").cast("string")), 256).alias("fingerprint"))


def plan_rereads(requests: DataFrame, pages: DataFrame, tried: DataFrame, fields: DataFrame, max_pages: int | None = None
                 ) -> DataFrame:
    """Requested (page, field) pairs that exist and were not tried, on the first ``max_pages`` pages of a set (None: all)."""
    ok = (requests.select("set_id", "page", "field").distinct()
          .join(pages.select("set_id", "page"), ["set_id", "page"], "left_semi")
          .join(F.broadcast(fields.select("field")), "field", "left_semi")
          .join(tried.select("set_id", "page", "field"), ["set_id", "page", "field"], "left_anti"))
    if max_pages is None:
        return ok.select("set_id", "page", "field")
    nth = F.row_number().over(W.partitionBy("set_id").orderBy("page"))
    first = ok.select("set_id", "page").distinct().withColumn("_n", nth).where(
        F.col("_n") <= max_pages).drop("_n")
    return ok.join(first, ["set_id", "page"]).select("set_id", "page", "field")


def scorecard(findings: DataFrame, abstentions: DataFrame, expected: DataFrame, rule_map: DataFrame
              ) -> DataFrame:
    """Each expected entry graded exact, partial or missed, with why it was missed.

    ``expected``: set_id, entry, severity. ``rule_map``: entry, rule_id, as small as the rules and checks are. The entries of
    a set meet what its rules said, one row per rule and outcome, and the map only says which pairs count: neither side is
    multiplied by the map, however many rules an entry has, and all of it stays where the set is.
    """
    passing = lambda c: c.isin(V.PASSING)
    got_status = F.when(passing(F.col("f.severity")), "PASS").otherwise(F.col("f.status"))
    want_status = F.when(passing(F.col("e.severity")), "PASS").otherwise("OPEN")
    exact = (got_status == want_status) & ((F.col("f.severity") == F.col("e.severity"))
                                           | (passing(F.col("f.severity")) & passing(F.col("e.severity"))))
    wanted = expected.select("set_id", "entry", "severity").distinct()
    said = findings.select("set_id", "rule_id", "status", "severity").distinct().unionByName(
        abstentions.groupBy("set_id", "rule_id").agg(F.min("reason").alias("reason")), allowMissingColumns=True)
    counts = rule_map.select("entry", "rule_id").distinct().withColumn("_counts", F.lit(True))
    rules = rule_map.groupBy("entry").agg(F.count("rule_id").alias("_rules"))
    pairs = wanted.alias("e").join(said.alias("f"), "set_id", "left").join(F.broadcast(counts), ["entry", "rule_id"], "left")
    grade = F.max(F.when(F.col("_counts").isNull() | F.col("f.status").isNull(), 0).when(exact, 2).otherwise(1)).alias("grade")
    graded = pairs.groupBy("set_id", "entry", F.col("e.severity").alias("severity")).agg(
        grade, F.min(F.when(F.col("_counts"), F.col("f.reason"))).alias("reason"))
    out = graded.join(F.broadcast(rules), "entry", "left").fillna(0, ["_rules"])
    names = F.element_at(F.array(F.lit("missed"), F.lit("partial"), F.lit("exact")), F.col("grade") + 1)
    why = F.when(F.col("grade") > 0, "").when(F.col("_rules") == 0, "no rule for this check").when(
        F.col("reason").isNotNull(), F.concat(F.lit("abstained: "), "reason")).otherwise("rule not registered")
    return out.select("set_id", "entry", "severity", names.alias("outcome"), why.alias("note"))


def scorecard_totals(rows: DataFrame) -> DataFrame:
    p = F.col("severity").isin(V.PASSING)
    o = F.col("outcome")
    return rows.groupBy("set_id").agg(
        F.count_if(~p).alias("open_total"), F.count_if(~p & (o == "exact")).alias("open_exact"),
        F.count_if(~p & (o == "partial")).alias("open_partial"), F.count_if(p).alias("verified_total"),
        F.count_if(p & (o == "exact")).alias("verified_exact"),
        F.count_if(p & (o == "partial")).alias("verified_partial"))


#: rule -> the facts its evidence shows, in order; fixed values
_OCC, _SPR = ("occupancy_group", ""), ("sprinkler_system", "")


def _audit(name: str) -> list[tuple[str, str]]:
    return [(f"egress.{name}", "required"), (f"egress.{name}", "provided")]


RULE_FACTS: dict[str, list[tuple[str, str]]] = {
    "EGRESS.COMMON_PATH": [*_audit("common_path"), _OCC, _SPR],
    "EGRESS.TRAVEL_DISTANCE": [*_audit("travel_distance"), _OCC, _SPR],
    "EGRESS.DEAD_END": [("egress.dead_end", "required"), _OCC],
    "EGRESS.CORRIDOR_WIDTH": [*_audit("corridor_width"), _OCC],
    "EGRESS.CAPACITY_FACTOR": [*_audit("width"), ("occupant_load", ""), _SPR],
    "EGRESS.EXIT_COUNT": [*_audit("exits"), ("occupant_load", "")],
    "EGRESS.FACTOR_CONSISTENCY": [("egress_width_factor", "")],
    "EGRESS.OCCUPANT_LOAD_POSTING": [_OCC, ("occupant_load", "")],
    "DOORS.CLEAR_WIDTH_REQUIREMENT": [("egress.door_clear_width", "required")],
    "XSHEET.RISK_CATEGORY": [("risk_category", ""), ("occupant_load", "")],
    "XSHEET.BUILDING_AREA": [("building_area_sf", ""), ("total_area_sf", ""),
                             ("area.tabulated_total_sf", "")],
    "HEIGHT_AREA.TABLE_504_HEIGHT": [("height_ft", ""), ("construction_type", ""), _OCC, _SPR],
    "HEIGHT_AREA.TABLE_504_STORIES": [("stories", ""), ("construction_type", ""), _OCC, _SPR],
    "HEIGHT_AREA.TABLE_506_AREA": [("building_area_sf", ""), ("construction_type", ""), _OCC, _SPR],
    "FIRE.TABLE_601": [("construction_type", "")],
    "STRUCT.WIND_STANDARD": [("wind_speed_mph", ""), ("exposure_category", ""), ("risk_category", ""),
                             ("code_edition", "")],
    "CODE.EDITION_CURRENT": [("code_edition", "")],
    "DECL.OCCUPANCY": [_OCC], "DECL.CONSTRUCTION_TYPE": [("construction_type", "")],
    "DECL.SPRINKLER": [_SPR], "DECL.BUILDING_AREA": [("building_area_sf", ""), ("total_area_sf", "")],
    "DECL.HEIGHT": [("height_ft", "")], "DECL.STORIES": [("stories", "")],
    "DECL.WIND_SPEED": [("wind_speed_mph", "")], "DECL.EXPOSURE": [("exposure_category", "")],
    "DECL.RISK_CATEGORY": [("risk_category", "")], "DECL.CODE_EDITION": [("code_edition", "")],
    "DECL.MIXED_OCCUPANCY": [("mixed_occupancy", "")],
}


def rule_facts(spark) -> DataFrame:
    rows = [(r, i, f, role) for r, facts in RULE_FACTS.items() for i, (f, role) in enumerate(facts)]
    return spark.createDataFrame(rows, "rule_id string, ord int, field string, role string")
