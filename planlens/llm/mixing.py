"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order, NULL last, take the weights in turn and share all words by them.
A source's target stops at ``most`` times its own words; what is over goes to the others by
weight, until none is above. A target of e whole epochs and a rest takes every document e times,
then fills the rest with documents in the order of their exponential keys -ln(u) / w: u from a
seeded hash of the document, w its quality. A document whose middle the rest's end falls before
is not taken, so a source's words come within half a document of its target.

A source may hold most of the rows. Its rest is therefore found from sums: keys are cut into
cells, the cells' words are summed, and only in the one cell where the sum passes the rest are
documents put in order. What comes out is one cutting key per source; documents are then judged
one by one, without sorting or moving their texts. Per source, a single row of totals reaches the
driver, which works out the targets.

Quality: how near a text's characters per word are to ``PLAIN``, from 1 down to ``LEAST``.

Defined cases: NULL text has no words; a document without words is taken as often as whole epochs
say; NULL sources are one source; equal keys are ordered by id and text, and rows equal in both
are taken or left together; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from planlens.llm.common import Scratch

WEIGHTS, MOST = (5, 2, 1), 3
PLAIN, LEAST = 6.0, 0.2
CELL_ROWS = 20000


def words(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    per_word = F.length(text) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(LEAST), 1 / (1 + F.abs(per_word - PLAIN) / PLAIN))


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, most: int = MOST) -> dict[str | None, Fraction]:
    """Each source's words in the mix."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = Fraction(sum(sizes.values())), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not above:
            out.update({s: left * weight[s] / total for s in free})
            break
        for s in above:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in above)
        free -= set(above)
    return out


def weighed(docs: DataFrame, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with _size, _key and _tie."""
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), tie), 12).cast("double") + 0.5) / float(1 << 52)
    out = docs.withColumns({"_size": words(text_col), "_tie": tie}).withColumn("_u", u)
    w = F.when(F.col("_size") > 0, quality(F.col(text_col), F.col("_size"))).otherwise(F.lit(1.0))
    key = -F.log("_u") / w
    return out.withColumn("_key", key).drop("_u")


def plan(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 10, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): the documents' numbers (id, source, _size, _key, _tie) as a written table, and per source
    source_size, target, epochs and the last document of the fractional selection (cut_key, cut_id, cut_tie)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.store(weighed(docs.select(id_col, text_col, source_col), seed, id_col, text_col)
                         .select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).alias("_source"), "_size", "_key", "_tie"))
    per = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["_source"]: r["size"] for r in per}
    goal = targets(sizes, weights, most)
    table = []
    for r in per:
        epochs = int(goal[r["_source"]] // r["size"]) if r["size"] else 0
        table.append((r["_source"], r["size"], float(goal[r["_source"]]), epochs, float(goal[r["_source"]] - epochs * r["size"]), max(1, r["n"] // CELL_ROWS)))
    todo = spark.createDataFrame(table, "_source string, source_size long, target double, epochs int, rest double, cells long")
    same = F.col("r._source").eqNullSafe(F.col("t._source"))
    # Keys of weight w are exponential; 1 - exp(-key) spreads them over (0, 1), whatever the weights.
    cell = F.floor((1 - F.exp(-F.col("r._key"))) * F.col("t.cells"))
    open_ = (rows.alias("r").join(todo.alias("t"), same).where("rest > 0 and _size > 0")
             .select("r._source", "_id", "_size", "_key", "_tie", "rest", cell.alias("cell")))
    before = W.partitionBy("_source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sums = open_.groupBy("_source", "rest", "cell").agg(F.sum("_size").alias("words"))
    edge = (sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
            .where("before < rest and before + words >= rest").select("_source", "cell", "before"))
    edge = scratch.store(edge)
    inside = open_.alias("o").join(edge.alias("e"), F.col("o._source").eqNullSafe(F.col("e._source")) & (F.col("o.cell") == F.col("e.cell"))).select("o.*", "e.before")
    order = W.partitionBy("_source").orderBy("_key", "_id", "_tie").rowsBetween(W.unboundedPreceding, 0)
    # A document is taken when the rest reaches its middle. Others of the cell, and all of later cells, are not.
    ranked = inside.withColumn("_upto", F.col("before") + F.sum("_size").over(order)).where(F.col("_upto") - F.col("_size") / 2 <= F.col("rest"))
    last = ranked.groupBy("_source").agg(F.max(F.struct("_key", F.coalesce("_id", F.lit(-(1 << 63))).alias("id"), "_tie")).alias("cut"))
    # Where not one of the cell is taken, the selection ends with the cell before.
    ends = edge.alias("e").join(last.alias("l"), F.col("e._source").eqNullSafe(F.col("l._source")), "left").select("e._source", "cell", "cut")
    cuts = todo.alias("t").join(ends.alias("e"), F.col("t._source").eqNullSafe(F.col("e._source")), "left").select("t.*", "e.cell", "e.cut")
    return rows, scratch.store(cuts)


def taken(key: Column, ident: Column, tie: Column, size: Column) -> Column:
    """How often a document is taken, from its numbers and its source's row of ``cuts``."""
    own = F.struct(key.alias("_key"), F.coalesce(ident.cast("long"), F.lit(-(1 << 63))).alias("id"), tie.alias("_tie"))
    cell = F.floor((1 - F.exp(-key)) * F.col("c.cells"))
    part = F.when(F.col("c.cut").isNotNull(), own <= F.col("c.cut")).otherwise(F.coalesce(cell < F.col("c.cell"), F.lit(False)))
    return F.col("c.epochs") + F.when((size > 0) & part, F.lit(1)).otherwise(F.lit(0))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 10, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, times, taken (words)."""
    rows, cuts = plan(docs, weights, most, seed, id_col, text_col, source_col)
    both = rows.alias("r").join(cuts.alias("c"), F.col("r._source").eqNullSafe(F.col("c._source")))
    times = taken(F.col("_key"), F.col("_id"), F.col("_tie"), F.col("_size"))
    return both.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", times.alias("times"), (times * F.col("_size")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 10, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: rows repeated by epochs, all columns as they were."""
    _, cuts = plan(docs, weights, most, seed, id_col, text_col, source_col)
    row = docs.select(F.struct("*").alias("row"))  # as a whole, so that its own columns clash with nothing
    keyed = weighed(row.select("row", F.col(f"row.{id_col}").alias("_id"), F.col(f"row.{text_col}").alias("_text"), F.col(f"row.{source_col}").alias("_source")), seed, "_id", "_text")
    both = keyed.drop("_text").alias("d").join(cuts.alias("c"), F.col("d._source").eqNullSafe(F.col("c._source")))
    times = taken(F.col("d._key"), F.col("d._id"), F.col("d._tie"), F.col("d._size"))
    again = F.when(times > 0, F.sequence(F.lit(1), times))  # NULL explodes to no row
    return both.select("row", F.explode(again)).select("row.*")
