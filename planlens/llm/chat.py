"""Chat formatting with prefix-target expansion. Built-in functions only.

A conversation becomes one text with marked turns. Every assistant turn is an example of its own:
its context is the text of all turns before it, and only its reply is trainable. ``expand`` explodes
the examples, one row per reply with its whole context. Until then an example points into the
conversation's text by offsets (code points): n turns are shuffled and kept as n turns, and the rows
that repeat contexts exist one at a time, in the task that holds the conversation.

Template: ``<s>[INST] role NEWLINE text [/INST]</s>`` and, for the assistant, ``<s> role NEWLINE
text </s>``. Inside a text, a backslash is put before each control string and each backslash, so
the reading side can undo it. Roles are URL-encoded. A marker that ends a turn follows a space or
a bracket; one inside a text follows a backslash.

Defined cases: NULL text is empty; NULL role is an empty role; rows are ordered by turn (NULL
first), then role, then text; repeated rows are turns of their own; rows with NULL conv_id form
one conversation; a conversation without an assistant has no example; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CONTROL = r"(\\|</?s>|\[/?INST\])"
OPEN, CLOSE = "<s>[INST] ", " [/INST]</s>"
OPEN_REPLY, CLOSE_REPLY = "<s> ", " </s>"
END = "</s>"
REPLY = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, and examples, an array of (turn: its place among the turns,
    context_chars, target_start, target_chars) with 0-based offsets into ``formatted``."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    reply, body = F.col("role") == REPLY, F.concat(F.url_encode("role"), F.lit("\n"))
    marked = F.when(reply, F.concat(F.lit(OPEN_REPLY), body, escape(F.col("text")), F.lit(CLOSE_REPLY))).otherwise(
        F.concat(F.lit(OPEN), body, escape(F.col("text")), F.lit(CLOSE)))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.select("*", marked.alias("marked"), (F.length(body) + len(OPEN_REPLY)).alias("head"))
    placed = turns.select("conv_id", F.row_number().over(order).alias("k"), "marked", reply.alias("reply"), "head",
                          F.coalesce(F.sum(F.length("marked")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("at"))
    example = F.struct((F.col("k") - 1).alias("turn"), F.col("at").alias("context_chars"), (F.col("at") + F.col("head")).alias("target_start"),
                       (F.length("marked") - F.col("head") - len(CLOSE_REPLY)).alias("target_chars"))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "marked"))), lambda x: x["marked"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("reply"), example))).alias("examples"))


def expand(formatted: DataFrame, keep: bool = False) -> DataFrame:
    """One row per assistant turn: conv_id, turn, context (the formatted text of all turns before, with the reply's
    opening marker), reply (the formatted target), example (both, what a model is shown) and loss_start: the code
    points of the example before its trainable ones.

    ``keep``: the other columns stay, and a conversation without a reply has one row without an example.
    """
    out = formatted.select("*", (F.explode_outer if keep else F.explode)("examples").alias("e"))
    cut = out.select("conv_id", *([c for c in formatted.columns if c not in ("conv_id", "examples")] if keep else []), "e.turn",
                     F.substring(F.col("formatted"), F.lit(1), F.col("e.target_start")).alias("context"),
                     F.substring(F.col("formatted"), F.col("e.target_start") + 1, F.col("e.target_chars")).alias("reply"))
    return cut.select("*", F.concat("context", "reply").alias("example"), F.length("context").alias("loss_start"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, an array of (role, text) as they were."""
    pieces = F.filter(F.split(formatted, r"(?<!\\)" + END, -1), lambda p: p != "")

    def turn(piece):
        other = F.startswith(piece, F.lit(OPEN))
        first = F.when(other, F.lit(len(OPEN))).otherwise(F.lit(len(OPEN_REPLY)))
        last = F.when(other, F.lit(len(CLOSE) - len(END))).otherwise(F.lit(len(CLOSE_REPLY) - len(END)))
        body = F.substring(piece, first + 1, F.length(piece) - first - last)
        role = F.substring_index(body, "\n", 1)
        return F.struct(F.url_decode(role).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))
    return F.transform(pieces, turn)


def read_loss(examples: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: the trainable text of the exploded examples, as it was, one after the other.

    ``examples``: ``expand(formatted, keep=True)``. Rows of a conversation are still where it was put together, so
    nothing moves.
    """
    said = unescape(F.expr("substring(example, loss_start + 1, length(example))"))
    return examples.groupBy("conv_id").agg(F.first("formatted").alias("formatted"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.when(F.col("turn").isNotNull(), F.struct("turn", said.alias("said"))))), lambda x: x["said"]), "").alias("loss"))
