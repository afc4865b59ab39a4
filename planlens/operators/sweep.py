"""Declared questions answered from running text, where no laid-out pair or structured value answers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planlens.functions import vocabulary as V
from planlens.functions.normalise import NORM_BOOL, canonical


def _stated(text: Column, pattern: str, groups: int) -> Column:
    """The first filled group of a pattern's first match, or the match; NULL without one."""
    parts = [F.nullif(F.regexp_extract(text, f"(?i){pattern}", g), F.lit("")) for g in [*range(1, groups + 1), 0]]
    return F.coalesce(*parts)


def sweep_hits(text: DataFrame, sheets: DataFrame | None = None, patterns: list[tuple[str, str, str, int]] = V.TEXT_SWEEP) -> DataFrame:
    """set_id, field, rank, page, sheet, stated: per pattern the first page of the set that matches it.

    ``text``: set_id, page, text (NULL: matches nothing); ``sheets``: set_id, page, code. General sheets come
    before all others, then pages count upward; repeated page rows are one. Each page is read once: a word that every match
    must hold is looked for before the pattern runs, and hits are reduced before they move.
    """
    if sheets is None:
        named = text.select("set_id", "page", "text", F.lit(None).cast("string").alias("sheet"))
    else:
        code = sheets.groupBy("set_id", "page").agg(F.min("code").alias("sheet"))
        named = text.select("set_id", "page", "text").join(code, ["set_id", "page"], "left")
    upper = F.upper("text")
    hits = F.array(*[
        F.struct(F.lit(field).alias("field"), F.lit(rank).alias("rank"),
                 F.when(upper.contains(word) & F.col("text").rlike(f"(?i){pattern}"), _stated(F.col("text"), pattern, groups)).alias("stated"))
        for rank, (field, word, pattern, groups) in enumerate(patterns)])
    found = named.select("set_id", "page", "sheet", F.explode(hits).alias("h")).select(
        "set_id", "page", "sheet", "h.*").where("stated is not null")
    general = F.coalesce(F.upper(F.substring("sheet", 1, 1)) == "G", F.lit(False))
    first = F.min_by(F.struct("page", "sheet", "stated"), F.struct((~general).alias("o"), F.col("page").alias("p"), F.col("stated").alias("s")))
    return found.groupBy("set_id", "field", "rank").agg(first.alias("h")).select("set_id", "field", "rank", "h.*")


def swept_values(hits: DataFrame) -> DataFrame:
    """The value of the first pattern per (set, field) whose hit reads as one, in the shape ``drawn_values`` takes.

    A hit that does not read as a value gives way to the next pattern, not to a later page.
    """
    c = canonical(F.col("field"), F.lit(None).cast("double"), F.col("stated"), F.lit(None).cast("boolean"))
    flag = F.col("field").isin(NORM_BOOL)
    read = hits.select("*", c["c_num"].alias("value_num"), c["c_str"].alias("_s")).where("value_num is not null or _s is not null")
    best = F.min_by(F.struct("value_num", "_s", "sheet", "page", "stated"), "rank").alias("b")
    out = read.groupBy("set_id", "field").agg(best).select("set_id", "field", "b.*")
    return out.select("set_id", "field", "value_num", F.when(~flag, F.col("_s")).alias("value_str"), F.when(flag, F.col("_s") == "true").alias("value_bool"),
                      F.col("sheet").alias("source"), "page", F.concat(F.lit("read from the live text of "), F.coalesce("sheet", F.lit("the page"))).alias("note"), "stated")
