"""Neighbours on one page, inside the task that holds it.

A page is the unit of layout geometry and its boxes fit one task, so neighbours are looked up where the page is: its rows
move once, by page, and no pair of boxes is ever shuffled. Boxes meet in grid cells, so a page of n boxes costs what stands near
each other and not n times n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from planlens.functions import vocabulary as V

PAGE = ["set_id", "page"]
PAIRS_AT_ONCE = 1 << 19  # candidate pairs held at a time, some 60 MB; the pairs of one cell row of one box are held whole

Arrays = dict[str, np.ndarray]


class Picked:
    """Some rows of a page's columns, taken when a column is read."""

    def __init__(self, a: Arrays, at: np.ndarray):
        self.a, self.at = a, at

    def __getitem__(self, c: str) -> np.ndarray:
        return self.a[c][self.at]


def fields(df: DataFrame, *cols: str, **renamed: str) -> list[StructField]:
    """The named columns of a frame as fields of an output; ``new=old`` renames one."""
    return [StructField(c, df.schema[c].dataType) for c in cols] + [StructField(n, df.schema[o].dataType) for n, o in renamed.items()]


def flag(name: str) -> StructField:
    return StructField(name, BooleanType())


def number(name: str) -> StructField:
    return StructField(name, IntegerType())


def each_page(df: DataFrame, cols: list[str], out: list[StructField], work: Callable[[pa.Table], dict]) -> DataFrame:
    """``work`` on every page's rows; it gives the output columns after set_id and page, all of one length."""
    schema = StructType([*fields(df, *PAGE), *out])
    names = [f.name for f in out]

    def on_page(rows: pa.Table) -> pa.Table:
        said = work(rows)
        n = len(said[names[0]])
        # every row of a group names the same page
        here = np.zeros(n, np.int64)
        made = [rows.column(c).combine_chunks().take(pa.array(here)) for c in PAGE] + [
            said[c] if isinstance(said[c], pa.Array) else pa.array(said[c]) for c in names]
        return pa.table(made, names=[*PAGE, *names]).cast(to_arrow_schema(schema))
    return df.select(*PAGE, *cols).groupBy(*PAGE).applyInArrow(on_page, schema)


def arrays(rows: pa.Table, cols: list[str]) -> Arrays:
    """Numbers and flags of a page as numpy arrays; an unknown flag counts as false."""
    out = {}
    for c in cols:
        col = rows.column(c)
        if pa.types.is_boolean(col.type):
            col = col.fill_null(False)
        out[c] = col.to_numpy()
    return out


def text(rows: pa.Table, name: str, at: np.ndarray | None = None) -> pa.Array:
    col = rows.column(name).combine_chunks()
    return col if at is None else col.take(pa.array(at))


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated n times each, and the count within each."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _cells(a: Arrays, pad_x, pad_y, cell: float) -> tuple[np.ndarray, ...]:
    """Every (box, cell) of the boxes grown by the pads, and each box's first cell."""
    at = lambda v: np.floor(v / cell).astype(np.int64)
    cx0, cy0, cx1, cy1 = at(a["x0"] - pad_x), at(a["y0"] - pad_y), at(a["x1"] + pad_x), at(a["y1"] + pad_y)
    wide = np.maximum(cx1 - cx0, 0) + 1
    row, k = spread(wide * (np.maximum(cy1 - cy0, 0) + 1))
    return row, cx0[row] + k % wide[row], cy0[row] + k // wide[row], cx0, cy0


def near(a: Arrays, pad_x=0.0, pad_y=0.0, asks: np.ndarray | None = None, cell: float = V.GRID_CELL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (l, r) of different boxes that share a grid cell, each once; l's box is grown by its pads.

    ``asks`` keeps the l that are looked at.
    """
    rrow, rx, ry, rx0, ry0 = _cells(a, 0.0, 0.0, cell)
    lrow, lx, ly, lx0, ly0 = _cells(a, pad_x, pad_y, cell)
    if asks is not None:
        keep = asks[lrow]
        lrow, lx, ly = lrow[keep], lx[keep], ly[keep]
    if not len(lrow) or not len(rrow):
        return
    low, span = min(rx.min(), lx.min()), max(rx.max(), lx.max()) - min(rx.min(), lx.min()) + 1
    rkey, lkey = ry * span + (rx - low), ly * span + (lx - low)
    order = np.argsort(rkey, kind="stable")
    rkey, rrow = rkey[order], rrow[order]
    lo = np.searchsorted(rkey, lkey, "left")
    n = np.searchsorted(rkey, lkey, "right") - lo
    total, start = np.cumsum(n), 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        part, k = spread(n[start:stop])
        part += start
        l, r = lrow[part], rrow[lo[part] + k]
        # a pair that shares several cells counts in the first of them
        first = (l != r) & (lx[part] == np.maximum(lx0[l], rx0[r])) & (ly[part] == np.maximum(ly0[l], ry0[r]))
        yield l[first], r[first]
        start = stop


def meeting(a: Arrays, meets: Callable[[Arrays, Arrays], np.ndarray], pad_x=0.0, pad_y=0.0, asks: np.ndarray | None = None
            ) -> tuple[np.ndarray, np.ndarray]:
    """The near pairs that meet a condition on both boxes' columns."""
    ls, rs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for l, r in near(a, pad_x, pad_y, asks):
        ok = meets(Picked(a, l), Picked(a, r))
        ls.append(l[ok])
        rs.append(r[ok])
    return np.concatenate(ls), np.concatenate(rs)


def ranked(l: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of pairs by l, then the keys, and the place of each within its l, from 1."""
    order = np.lexsort((*reversed(keys), l))
    s = l[order]
    new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return order, np.arange(len(s)) - np.repeat(new, np.diff(np.r_[new, len(s)])) + 1


def nearest(n: int, l: np.ndarray, r: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each of n boxes the r that comes first by the keys, -1 where it has none."""
    order, place = ranked(l, *keys)
    out = np.full(n, -1, np.int64)
    top = order[place == 1]
    out[l[top]] = r[top]
    return out


def ends(onward: np.ndarray) -> np.ndarray:
    """Where following the pointers (-1: none) from each box comes to stand, by pointer doubling."""
    at = np.where(onward < 0, np.arange(len(onward)), onward)
    for _ in range(len(at).bit_length() + 1):
        further = at[at]
        if np.array_equal(further, at):
            break
        at = further
    return at
