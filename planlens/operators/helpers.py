"""Join and ordering helpers the operators share."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window as W, functions as F

from planlens.functions import vocabulary as V
from planlens.session import cut_lineage

def numbered(df: DataFrame, keys: list[str], coarse: list[str], fine: list, name: str = "ord"
             ) -> DataFrame:
    """row_number over ``keys`` in the order (coarse, fine) without one task per key.

    Rows are numbered inside (keys, coarse); the running row count of the earlier coarse
    groups comes from a pre-aggregated count per group, so a key holding a third of all rows
    still spreads over its coarse groups. ``coarse`` columns must not be NULL.
    """
    group = [*keys, *coarse]
    before = W.partitionBy(*keys).orderBy(*coarse).rowsBetween(W.unboundedPreceding, -1)
    offsets = (df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .drop("_n"))
    inner = F.row_number().over(W.partitionBy(*group).orderBy(*fine))
    return (df.withColumn("_in", inner).join(offsets, group)
            .withColumn(name, F.col("_before") + F.col("_in")).drop("_before", "_in"))


def attach(df: DataFrame, few: DataFrame) -> DataFrame:
    """Every row with the rows of ``few``: one aggregate row, or the rows of one small profile."""
    return (df.withColumn("_one", F.lit(1)).join(F.broadcast(few.withColumn("_one", F.lit(1))), "_one")
            .drop("_one"))


def rank_of(c: Column, order: list[str]) -> Column:
    """Position of a value in a fixed order, 9 when it is not part of it."""
    out = F.lit(9)
    for i, value in reversed(list(enumerate(order))):
        out = F.when(c == value, F.lit(i)).otherwise(out)
    return out


def name_of(rank: Column, order: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in order]), rank.cast("int") + 1)


def _cells(df: DataFrame, prefix: str, cell: float, pad_x: Column | float, pad_y: Column | float
           ) -> DataFrame:
    """One row per grid cell a box (grown by the pads) touches, with its first cell kept."""
    def at(c: str, shift):
        return F.floor((F.col(f"{prefix}{c}") + shift) / cell).cast("int")
    px, py = F.lit(pad_x), F.lit(pad_y)
    return (df.withColumn(f"{prefix}cx0", at("x0", -px)).withColumn(f"{prefix}cy0", at("y0", -py))
            .withColumn("cx", F.explode(F.sequence(f"{prefix}cx0", at("x1", px))))
            .withColumn("cy", F.explode(F.sequence(f"{prefix}cy0", at("y1", py)))))


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], predicate: Column,
              cell: float = V.GRID_CELL, pad_x: Column | float = 0.0, pad_y: Column | float = 0.0
              ) -> DataFrame:
    """Pairs of boxes that share a grid cell and meet ``predicate``.

    ``left`` carries ``l_x0..l_y1`` and ``right`` ``r_x0..r_y1``; the left box is grown by the
    pads before cells are taken. A pair meeting in several cells is kept only in the first
    one, so no distinct is needed; the cell is part of the join key, so a crowded page spreads
    over its cells.
    """
    lc = _cells(left, "l_", cell, pad_x, pad_y)
    rc = _cells(right, "r_", cell, 0.0, 0.0)
    first = ((F.col("cx") == F.greatest("l_cx0", "r_cx0"))
             & (F.col("cy") == F.greatest("l_cy0", "r_cy0")))
    return (lc.join(rc, [*keys, "cx", "cy"]).where(first & predicate)
            .drop("cx", "cy", "l_cx0", "l_cy0", "r_cx0", "r_cy0"))


def sided(df: DataFrame, prefix: str, keys: list[str], *keep: str) -> DataFrame:
    """A frame ready for one side of ``grid_join``: keys as they are, the rest prefixed."""
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in keep])


def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str],
                         max_rounds: int = 60) -> DataFrame:
    """The smallest node id reachable from each node, by min-label rounds with pointer jumping.

    ``nodes(keys, id)``, ``edges(keys, a, b)`` in either direction. Labels are kept only for
    nodes with an edge; each round is checkpointed, so the plan stays flat and a lost executor
    costs one round. Rounds grow with the logarithm of the longest path.
    """
    both = (edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b"), F.col("a")))
            .where("a <> b").distinct())
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(*keys, F.col("a").alias("id"))
                         .agg(F.least(F.first("a"), F.min("b")).alias("label")))
    for _ in range(max_rounds):
        seen = both.join(labels.withColumnRenamed("id", "b"), [*keys, "b"])
        near = seen.groupBy(*keys, F.col("a").alias("id")).agg(F.min("label").alias("_near"))
        step = labels.join(near, [*keys, "id"]).select(
            *keys, "id", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        jump = step.select(*keys, F.col("id").alias("label"), F.col("label").alias("_root"))
        step = cut_lineage(step.join(jump, [*keys, "label"], "left").select(
            *keys, "id", "_old", F.least(F.col("label"), F.coalesce("_root", "label")).alias("label")))
        changed = step.where("label <> _old").limit(1).count()
        labels = step.drop("_old")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return nodes.join(labels, [*keys, "id"], "left").withColumn(
        "label", F.coalesce("label", "id"))


def islands(df: DataFrame, part: list[str], order: list, starts: Column, name: str = "island"
            ) -> DataFrame:
    """Running count of ``starts`` flags: the gaps-and-islands group of every row."""
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def merged_intervals(df: DataFrame, part: list[str], lo: str, hi: str, slack: float) -> DataFrame:
    """Union of intervals per key, joining those within ``slack`` of what came before."""
    w = W.partitionBy(*part).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = df.withColumn("_start", F.coalesce(F.col(lo) > reach + slack, F.lit(True)))
    grouped = islands(flagged, part, [lo, hi], F.col("_start"))
    return grouped.groupBy(*part, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi))


def full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join whose keys match NULL with NULL."""
    l, r = left.alias("l"), right.alias("r")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    cols = ([F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys]
            + [F.col(f"l.{c}") for c in left.columns if c not in keys]
            + [F.col(f"r.{c}") for c in right.columns if c not in keys])
    return l.join(r, cond, "full_outer").select(*cols)
