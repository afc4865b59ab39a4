"""Fill-in-the-middle: a text's units are dealt to prefix, middle and suffix, and the middle is moved to the end.

A pyarrow.compute pipeline, a bounded slice of an Arrow batch at a time: the texts are split into
lists of units, the lists are flattened with the row each unit came from, a unit's ordinal in its
row gives its role, the units of one role are taken out and put into lists again, and the lists are
joined into pieces and the pieces into the outputs. There is no loop over rows and no shuffle. The
draws come from built-in hashes of the id, so that a rerun, another partitioning or a lost executor
gives the same output.

A unit is a line with its line end (the last one may lack it). With four draws h1..h4, n units are
cut after h1 % (n + 1) and h2 % (n + 1) of them, in order; h3 % 100 decides whether the text is
transformed (``rate``), h4 % 100 between the two forms (``spm_rate``):

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

No marker may occur in a text that is transformed, so the markers of an output are its only ones
and ``restore`` gets the text back exactly.

Defined cases: NULL text is an empty one; an empty text, or one that holds a marker, stays as it is
(``plain``, with NULL sizes). Every row is judged alone, so repeated rows give repeated rows; a NULL
id draws as the empty string. Columns that ``docs`` has besides are left out. An empty table gives
an empty one. A text of any length is one row of a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from planlens.llm.common import chunks

SEED, RATE, SPM_RATE = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<P>|<S>|<M>"
TEXT = pa.large_string()
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(id_col: str = "doc_id", seed: int = SEED) -> list[Column]:
    """h1..h4: the first four 8-digit groups of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _numbers(n: int) -> pa.Array:
    return pa.array(np.arange(n))


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, TEXT)


def _modulo(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Every unit, the row it came from, and how many units each row has."""
    lines = pc.split_pattern(texts, "\n")
    flat, row = pc.list_flatten(lines), pc.list_parent_indices(lines).cast(pa.int64())
    last = pc.equal(_numbers(len(flat)), pc.take(pc.subtract(lines.offsets.cast(pa.int64()).slice(1), 1), row))
    units = pc.binary_join_element_wise(flat, pc.if_else(last, _text(""), _text("\n")), _text(""))
    there = pc.or_(pc.invert(last), pc.not_equal(pc.binary_length(flat), 0))  # a text that ends with \n has no unit after it
    units, row = units.filter(there), row.filter(there)
    return units, row, _per_row(row, len(texts))


def _per_row(row: pa.Array, rows: int) -> pa.Array:
    """How many units of each row there are, rows without any included."""
    seen = pc.value_counts(row)
    place = pc.index_in(_numbers(rows), seen.field("values"))
    return pc.fill_null(pc.take(seen.field("counts"), place), 0)


def _starts(counts: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)])


def _piece(units: pa.Array, row: pa.Array, role: pa.Array, rows: int) -> pa.Array:
    """The units of one role, put into lists by row again and joined."""
    kept = row.filter(role)
    return pc.binary_join(pa.ListArray.from_arrays(_starts(_per_row(kept, rows)).cast(pa.int32()), units.filter(role)), _text(""))


def _transform(rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts, rows = pc.fill_null(part.column("text"), "").cast(TEXT), part.num_rows
            units, row, n = _units(texts)
            ordinal = pc.subtract(_numbers(len(units)), pc.take(_starts(n), row))
            ways = pc.add(n, 1)
            x, y = _modulo(part.column("h1"), ways), _modulo(part.column("h2"), ways)
            first, second = pc.take(pc.min_element_wise(x, y), row), pc.take(pc.max_element_wise(x, y), row)
            before, after = pc.less(ordinal, first), pc.greater_equal(ordinal, second)
            prefix, suffix = _piece(units, row, before, rows), _piece(units, row, after, rows)
            middle = _piece(units, row, pc.invert(pc.or_(before, after)), rows)
            hundred = pa.scalar(100, pa.int64())
            plain = pc.or_(pc.or_(pc.equal(n, 0), pc.match_substring_regex(texts, MARKER)),
                           pc.greater_equal(_modulo(part.column("h3"), hundred), rate))
            spm = pc.less(_modulo(part.column("h4"), hundred), spm_rate)
            p, s, m, nothing = map(_text, (PREFIX, SUFFIX, MIDDLE, ""))
            output = pc.if_else(plain, texts, pc.if_else(spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing),
                                                         pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)))
            form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
            none = pa.scalar(None, pa.int64())
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n": n, "form": form,
                                   "prefix_chars": pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
                                   "middle_chars": pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())),
                                   "output": output.cast(pa.string())})
    return run


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars (code points), output."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *draws(id_col, seed))
    return rows.mapInArrow(_transform(rate, spm_rate), OUT)


def restore(output: Column, form: Column) -> Column:
    """The text an output was made of: its pieces lie between its three markers."""
    pieces = F.split(output, MARKER, -1)
    return (F.when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2]))
            .when(form == "spm", F.concat(pieces[2], pieces[3], pieces[1])).otherwise(output))
