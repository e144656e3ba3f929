r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by (turn, role, text). Adjacent turns of one
role share a block; a mark between them keeps them apart, so that reading back loses nothing:

    <|turn|>role<|text|>text<|part|>next text of that role<|end|><|turn|>...<|end|>

Inside roles and texts a backslash is doubled, and `\-` breaks every control string after its first
character, both its own marks and common ones of other templates; decode() undoes both in one pass.
Every piece is built on its own from its neighbour's role and pieces are joined once, so the work is linear in
the conversation; merging blocks by an aggregate that grows would be quadratic.

Edge cases: a null role or text counts as empty; a null turn sorts first; turns that tie are ordered by role,
then text; repeated rows are turns of their own; texts are kept whole, and a conversation must fit one string
(2 GB); a null conversation id is a conversation; an empty table gives no rows. Columns but the four named
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
#: Where a control string begins: <|...|>, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"


def encode(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$0\\-")


def decode(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:-|(\\))", "$1")


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row for each conversation: conv, formatted, segments (array of text and loss, in order; formatted is their texts joined)."""
    clean = rows.select(F.col(conv).alias("_conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("_t"))
    chats = clean.groupBy("_conv").agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
    turns = F.col("_turns")

    def pieces(x: Column, i: Column) -> Column:
        fresh = (i == 0) | (F.get(turns, i - 1)["role"] != x["role"])
        opening = F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(END)), F.lit(TURN), encode(x["role"]), F.lit(TEXT))
        mark = F.when(fresh, opening).otherwise(F.lit(PART))
        return F.array(F.struct(mark.alias("text"), F.lit(False).alias("loss")), F.struct(encode(x["text"]).alias("text"), (x["role"] == trained).alias("loss")))

    closing = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    chats = chats.select("_conv", F.concat(F.flatten(F.transform(turns, pieces)), closing).alias("segments"))
    return chats.select(F.col("_conv").alias(conv), F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text."""
    blocks = F.slice(F.split(formatted, r"<\|turn\|>"), F.lit(2), F.size(F.split(formatted, r"<\|turn\|>")))

    def turns(block: Column) -> Column:
        head = F.split(F.substring_index(block, END, 1), r"<\|text\|>")
        texts = F.split(F.get(head, 1), r"<\|part\|>")
        return F.transform(texts, lambda t: F.struct(decode(F.get(head, 0)).alias("role"), decode(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return decode(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
