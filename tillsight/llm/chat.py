"""Chat formatting with Spark expressions only: sort collected turns, merge runs of a role, concatenate.

Template: neighbouring turns of one role are merged into one block

    <|turn:role|>first text<|next|>second text<|end|>

followed by a line feed; the block of a single turn has no ``<|next|>``. Texts and roles are escaped, so
no control string occurs inside them: every backslash is doubled, then a backslash is put after
the first character of each control string. ``unescape`` undoes this in reverse order, so
reading gives back every single turn, merged or not.

The loss mask is a list of spans of code points of the output: the texts of assistant turns.

Defined results: rows of a conversation are ordered by turn (NULL first), then role and text, so
ties and repeated rows have one order and every row stays a turn; a NULL text or role is empty;
rows with a NULL ``conv_id`` form one conversation; an empty table gives an empty result. A
conversation is one output value, so its turns meet in one task by the nature of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "|>")
ASSISTANT = "assistant"
HEAD, HEAD_END, NEXT, END = "<|turn:", "|>", "<|next|>", "<|end|>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text: Column) -> Column:
    for control in reversed(CONTROL):
        text = F.replace(text, F.lit(control[0] + "\\" + control[1:]), F.lit(control))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _piece(turns: Column, turn: Column, i: Column) -> Column:
    """What stands between the previous turn's text and this one's, and the text."""
    head = F.concat(F.lit(HEAD), turn["role"], F.lit(HEAD_END))
    previous = F.get(turns, i - 1)["role"]
    before = F.when(i == 0, head).when(previous == turn["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(END), head))
    return F.struct(before.alias("before"), turn["text"].alias("text"), (turn["role"] == ASSISTANT).alias("learned"))


def _spans(state: Column, piece: Column) -> Column:
    """Move the write position behind a piece, noting the span of a learned text."""
    start = state["at"] + F.char_length(piece["before"])
    end = start + F.char_length(piece["text"])
    span = F.array(F.struct(start.alias("start"), end.alias("end")))
    return F.struct(end.alias("at"), F.when(piece["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans`` (array of start, end).

    ``turns`` has conv_id, turn, role and text; other columns are ignored.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    one = F.struct(F.col("turn").alias("turn"), escape(role).alias("role"), escape(text).alias("text"))
    collected = turns.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    pieces = collected.select("conv_id", F.transform("turns", lambda t, i: _piece(F.col("turns"), t, i)).alias("pieces"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(END))
    return pieces.select("conv_id", formatted.alias("formatted"), F.aggregate("pieces", start, _spans)["spans"].alias("loss_spans"))


def _turns_of(block: Column) -> Column:
    body = F.substr(block, F.lit(len(HEAD) + 1))
    role = F.substring_index(body, HEAD_END, 1)
    texts = F.split(F.substr(body, F.char_length(role) + len(HEAD_END) + 1), r"<\|next\|>")
    return F.transform(texts, lambda text: F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def read_chats(chats: DataFrame) -> DataFrame:
    """Read formatted conversations back: ``turns`` (array of role, text) and ``loss_text``, both unescaped."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda block: block != "")
    masked = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    return chats.select(
        "*", F.flatten(F.transform(blocks, _turns_of)).alias("turns"), F.array_join(masked, "").alias("loss_text")
    )
