"""Line deduplication: lines that many documents share are dropped from all of them.

Built-in functions only. The lines of a text are normalised and hashed in place; only the
distinct hashes of a document travel. Their document counts are summed before the shuffle, so a
line that every document has costs one row per task. The frequent hashes go back to the
documents that hold them, and each document is put together again from its own lines in their
order. Texts are shuffled once; no line is.

Key of a line: ``[\\x20\\x09-\\x0D]`` stripped at both ends, A-Z lower-cased. Keys are told apart by
96 bits of hash.

Defined cases: NULL or empty text is one empty line, which is never dropped (a key needs
``min_chars`` code points); every row is a document of its own, also one that repeats another;
NULL ids are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planlens.llm.common import Scratch

MIN_DOCS, MIN_CHARS = 10, 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIPPED = " \t\n\x0b\x0c\r"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased. Where a text has one byte per character, lower() is that and quicker."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def _keys(lines: Column, min_chars: int) -> Column:
    """Each line's key hashes, or NULL for a line too short to count."""
    def key(line):
        bare = F.btrim(line, F.lit(STRIPPED))
        return F.when(F.length(bare) >= min_chars, F.struct(F.xxhash64(bare).alias("h"), F.hash(bare).alias("g")))
    return F.transform(lines, key)


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, and the text that is left."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tkey"))
    keyed = base.select("doc_id", "tkey", F.explode(F.array_compact(F.array_distinct(_keys(F.split(lower_ascii(F.col("text")), "\n", -1), min_chars)))).alias("k"))
    frequent = scratch.store(keyed.groupBy("k.h", "k.g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).drop("n"))
    marked = (keyed.select("doc_id", "tkey", "k.h", "k.g").join(frequent, ["h", "g"])
              .groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("h", "g")).alias("drop")))
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.tkey") == F.col("m.tkey"))
    both = base.alias("d").join(marked.alias("m"), same, "left").select("d.doc_id", "d.text", "m.drop")
    lines = F.split("text", "\n", -1)
    kept = F.filter(F.arrays_zip(lines.alias("line"), _keys(F.split(lower_ascii(F.col("text")), "\n", -1), min_chars).alias("k")),
                    lambda x: x["k"].isNull() | ~F.array_contains(F.col("drop"), x["k"]))
    judged = both.select("doc_id", "text", F.size(lines).cast("long").alias("n_lines"),
                         F.when(F.col("drop").isNull(), F.lit(None)).otherwise(F.transform(kept, lambda x: x["line"])).alias("kept"))
    return judged.select("doc_id", "n_lines", F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
                         F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("kept_text"))
