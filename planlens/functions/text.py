"""Small string helpers shared by every family of operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planlens.functions import vocabulary as V


def rx(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL (never '') when nothing matched."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def bind(c: Column, body) -> Column:
    """``body`` of a value worked out once, however often the body reads it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps read often, so the plan computes each once per row."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def squeeze(c: Column) -> Column:
    """Upper case, trimmed, inner whitespace runs collapsed to one space."""
    return F.regexp_replace(F.trim(F.upper(c)), r"\s+", " ")


def strip_chars(c: Column, chars_class: str) -> Column:
    return F.regexp_replace(c, rf"^[{chars_class}]+|[{chars_class}]+$", "")


def words(c: Column) -> Column:
    """Whitespace tokens of a text, an empty array for blank text."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def letters(c: Column) -> Column:
    """How many letters a text holds."""
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def normal_label(c: Column) -> Column:
    """A label without punctuation and without the section it cites."""
    t = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), V.CITED_IN_BRACKETS, " ")
    t = F.regexp_replace(t, r"[^A-Z0-9 ]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def phrase_in(phrase: Column, text: Column) -> Column:
    """Whole-word containment of a phrase in an already normal text."""
    pad = F.lit(" ")
    return F.contains(F.concat(pad, text, pad), F.concat(pad, phrase, pad))


# ---- what a printed segment looks like -------------------------------------------------

def value_token(t: Column) -> Column:
    """A token that can be (part of) an answer: number, dimension, unit or answer word."""
    return bind(strip_chars(F.upper(t), ",;"), lambda up: (
        up.rlike(V.NUMERIC_TOKEN)
        | up.rlike(V.DIMENSION_TOKEN)
        | up.isin(V.UNITS)
        | up.isin(V.VALUE_WORDS)
        | up.rlike(V.GROUP_TOKEN)
    ))


def marked(t: Column) -> Column:
    return F.rtrim(t).rlike(r"[:?]$")


def value_like(text: Column) -> Column:
    """Could this segment be an answer printed against a plain label?"""
    return bind(F.trim(text), _value_like)


def _value_like(t: Column) -> Column:
    few = lambda up: bind(words(up), lambda toks: ((F.size(toks) <= 6) & up.rlike(r"\d")) | (
        (F.size(toks) <= 4) & strip_chars(F.try_element_at(toks, F.lit(1)), ",;").isin(V.VALUE_WORDS)))
    answer = bind(F.upper(t), lambda up: up.isin(V.VALUE_WORDS) | up.rlike(V.TYPE_TEXT) | up.rlike(V.GROUP_TOKEN) | few(up))
    return F.when((t == "") | t.endswith(":"), False).otherwise(F.coalesce(answer, F.lit(False)))


def label_like(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.trim(text), r"[:?]+$", ""))
    return bind(t, lambda x: (letters(x) >= 2) & (~_value_like(x) | marked(F.trim(text))))


def inline_pair(text: Column) -> Column:
    """``LABEL: value`` as struct(label, value); NULL when the text is not one."""
    def cut(t: Column) -> Column:
        parts = F.struct(F.trim(rx(t, V.INLINE_SPLIT, 1)).alias("label"), F.trim(F.regexp_extract(t, V.INLINE_SPLIT, 3)).alias("value"))
        return bind(parts, lambda p: F.when(letters(p["label"]) >= 2, p))
    t = F.trim(text)
    return F.when(t.rlike("[:?]"), bind(t, cut))


def bare_label(text: Column) -> Column:
    p = inline_pair(text)
    return p.isNotNull() & (p["value"] == "")


def plain_label(text: Column) -> Column:
    t = F.trim(text)
    bare = F.regexp_replace(t, r"\(\s*\d[\d.]*\s*\)", "")
    return ~marked(t) & ~bare.rlike(r"\d") & (F.size(words(bare)) <= 7) & label_like(t)


def trailing_pair(text: Column) -> Column:
    """``OCCUPANT LOAD 70``: label words, then a run of value tokens reaching the end."""
    return bind(words(text), _trailing)


def _trailing(toks: Column) -> Column:
    # read from the end, so the run is met once and a line that ends in a word costs one token
    run = F.regexp_extract(F.upper(F.concat(F.array_join(F.reverse(toks), " "), F.lit(" "))), V.VALUE_RUN, 0)
    n = F.length(run) - F.length(F.replace(run, F.lit(" "), F.lit("")))
    return F.when(F.size(toks) >= 2, bind(F.size(toks) - n, lambda k: F.when(  # the first token is never a value
        k < F.size(toks), _label_and_run(toks, F.greatest(k, F.lit(1))))))


def _label_and_run(toks: Column, last_word: Column) -> Column:
    label = F.array_join(F.slice(toks, F.lit(1), last_word), " ")
    tail = F.slice(toks, last_word + 1, F.size(toks))
    pair = F.struct(label.alias("label"), F.array_join(tail, " ").alias("value"))
    real = F.exists(tail, lambda t: ~F.upper(t).isin(V.UNITS))
    return bind(pair, lambda p: F.when(real & ~p["label"].rlike(r"\d") & (letters(p["label"]) >= 2), p))
