"""The review end to end: pairs to claims to facts to rules to a keyed register."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from planlens.operators import (calibration as C, claims as CL, facts as FX, geometry as G, layout as L, profile as P, reconcile as R, register as RG,
                                rules as RU, sweep as SW, tables as TB)
from planlens.session import cut_lineage
from planlens.sources.catalog import catalog, questions


def facts_from_pairs(pairs: DataFrame) -> DataFrame:
    """Label/value pairs to resolved facts."""
    claims = CL.claims_from_pairs(pairs, catalog(pairs.sparkSession)).withColumn("seq", F.col("ord")).withColumn(
        "source", F.array().cast("array<string>"))
    return cut_lineage(FX.resolved_facts(cut_lineage(claims)))  # each is read several times below


def drawn_from_facts(resolved: DataFrame) -> DataFrame:
    """Resolved facts that answer a declared question."""
    q = F.coalesce(*[F.when(F.col("field") == f, F.lit(k)) for f, k in FX.QUESTION_FOR.items()])
    return resolved.where("role = ''").withColumn("question", q).where("question is not null").select(
        "set_id", F.col("question").alias("field"), "value_num", "value_str", "value_bool", F.col("lead.sheet").alias("source"),
        F.col("lead.page").alias("page"), F.lit("").alias("note"))


def review(pairs: DataFrame, declarations: DataFrame, profile: DataFrame | None = None, only: list[str] | None = None, **tables: DataFrame
           ) -> tuple[DataFrame, DataFrame]:
    """(register, abstentions) of every set that has pairs or a declaration; see ``review_reports``."""
    out = review_reports(pairs, declarations, profile, only, **tables)
    return out["findings"], out["abstentions"]


def review_reports(pairs: DataFrame, declarations: DataFrame, profile: DataFrame | None = None, only: list[str] | None = None, **tables: DataFrame
                   ) -> dict[str, DataFrame]:
    """What a review hands out per set: findings, abstentions, summary, declaration and, with a profile, calibration.

    ``declarations`` is the wide row per set; ``tables`` are the other inputs the rules know;
    ``only`` names the rules to run (None: all). With ``text`` among the tables, questions that no fact answers are swept from it.
    """
    spark = pairs.sparkSession
    resolved = facts_from_pairs(pairs)
    sets = pairs.select("set_id").union(declarations.select("set_id")).distinct()
    said = drawn_from_facts(resolved)
    if tables.get("text") is not None:  # what no laid-out fact answers is looked for in the running text
        swept = SW.swept_values(SW.sweep_hits(tables["text"], tables.get("sheets")))
        said = R.drawn_values(said, said.where("false"), swept)
    drawn = cut_lineage(R.apply_implication(said))
    # Each expression of the next step names those of the one before many times over: without a cut they multiply.
    rec = cut_lineage(R.reconcile(R.long_declarations(declarations), drawn, questions(spark), sets=sets))
    rows = cut_lineage(R.scenarios(rec, keep_silent=True))
    out = cut_lineage(RU.run_rules(RU.Inputs(rows, resolved=resolved, **tables), spark, only))
    merged = RG.merge_scenarios(RU.findings(out))
    stood = RG.dedupe_abstentions(RU.abstentions(out))
    extra = {}
    if profile is not None:
        groups = drawn.where("field = 'occupancy_group'").select("set_id", F.col("value_str").alias("occupancy_group"))
        applied = C.apply_profile(merged.join(groups, "set_id", "left"), profile)
        quiet = C.silenced(applied).select("set_id", "rule_id", "reason", F.lit(None).cast("int").alias("page"), "detail")
        stood = stood.select("set_id", "rule_id", "reason", "page", "detail").unionByName(quiet)
        extra = {"calibration": C.adjustments(applied)}
        ordered = C.calibrated_order(C.kept(applied), ["title"])
    else:
        ordered = RG.order_register(merged, ["title"])
    keyed = cut_lineage(RG.finding_keys(ordered))  # read again by the summary
    return {"findings": keyed, "abstentions": stood, "summary": RG.summary(keyed), "declaration": R.declaration_report(rec)} | extra


def drawn(words: DataFrame, pages: DataFrame, paths: DataFrame | None = None, viewports: DataFrame | None = None) -> dict[str, DataFrame]:
    """What the pages say, from their positioned words.

    ``words``: set_id, page, block, line, seq, x0..y1, text; ``pages``: set_id, page, width, height.
    Gives segs, pairs (with sheet, context and heading), sheets, lines, and the row tables the
    rules read that words alone can fill. With ``paths`` (and ``viewports``, see ``geometry.egress_runs``)
    the egress layer is measured too.
    """
    page = ["set_id", "page"]
    segs = L.merge_segments(L.segments(words)).join(pages.select(*page, F.col("width").alias("page_width")), page)
    segs = cut_lineage(L.typed_segments(segs))  # read by every step below
    lines = L.reading_order(segs).select(*page, F.col("ord").alias("line_no"), "text")
    sheets = cut_lineage(P.sheet_titles(lines, P.sheet_index(pages, P.sheet_cells(words, pages))))
    pairs = L.assign_pairs(segs, headed=True)
    pairs = pairs.join(sheets.select(*page, F.col("code").alias("sheet")), page)
    pairs = cut_lineage(pairs.withColumn("box", F.col("label_box")))
    text = lines.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    measured = {} if paths is None else {"egress_runs": cut_lineage(G.egress_runs(paths, segs, pages, sheets, viewports))}
    return measured | {"segs": segs, "pairs": pairs, "sheets": sheets, "lines": lines, "text": pages.select(*page).join(text, page, "left"),
            "exits": TB.exit_blocks(pairs), "spaces": TB.occupancy_rows(pairs), "fixtures": TB.fixture_block(segs),
            "ceilings": TB.ceiling_tags(segs, sheets), "area_tally": TB.area_tally(lines, sheets)}


RULE_TABLES = ["sheets", "text", "exits", "spaces", "fixtures", "ceilings", "area_tally"]


def review_corpus(words: DataFrame, pages: DataFrame, declarations: DataFrame, profile: DataFrame | None = None,
                  only: list[str] | None = None, paths: DataFrame | None = None, viewports: DataFrame | None = None, **tables: DataFrame
                  ) -> tuple[DataFrame, DataFrame]:
    """(register, abstentions) of every set, from its words to its ranked findings.

    ``paths`` and ``viewports`` are the linework from which egress runs are measured.
    ``tables`` are inputs that words cannot fill, such as doors, ventilation or attrs; one named like a table read off the words replaces it.
    """
    said = drawn(words, pages, paths, viewports)
    return review(said["pairs"], declarations, profile, only, **{k: said[k] for k in [*RULE_TABLES, "egress_runs"] if k in said} | tables)
