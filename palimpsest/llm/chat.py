"""Chat formatting with typed content parts and a loss mask; DataFrame functions only.

A message is a list of parts. A visitor turns each into text: a text part into
itself, escaped; an image, audio clip or document into a placeholder, whose
reference and token count go to the list of attachments in the same order.

Every turn is ``<|start|>role<|sep|>content<|end|>`` and a line end. Texts cannot
forge a control string: ``&``, ``<`` and ``[`` are written as ``&amp;``, ``&lt;``
and ``&#91;``, so that each ``<`` of the output is the template's own, and the
instruction marks of other templates are spelt apart too. Reading undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The template's control strings and the escapes, in order of writing.
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
#: The kinds of parts with a placeholder.
ATTACHMENTS = ("image", "audio", "document")

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("n_tokens", T.LongType())])


def escape(col: Column) -> Column:
    for plain, written in ESCAPES:
        col = F.replace(col, F.lit(plain), F.lit(written))
    return col


def unescape(col: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        col = F.replace(col, F.lit(written), F.lit(plain))
    return col


def text_part(text: Column) -> Column:
    """A message of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("long").alias("n_tokens")))


def visit(part: Column) -> Column:
    """The output text of one part; a part of unknown or null type is text."""
    out = F.coalesce(escape(part["text"]), F.lit(""))
    for kind in ATTACHMENTS:
        out = F.when(part["type"] == kind, F.lit(f"<|{kind}|>")).otherwise(out)
    return out


def text_spans(parts: Column) -> Column:
    """(start, length) of the stretches of a message's content that are text, without placeholders."""
    lengths = F.transform(parts, lambda p: F.struct(F.length(visit(p)).cast("long").alias("n"), F.coalesce(p["type"].isin(*ATTACHMENTS), F.lit(False)).alias("placeholder")))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        more = F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), x["n"].alias("length")))
        return F.struct((acc["at"] + x["n"]).alias("at"), F.when(x["placeholder"], acc["spans"]).otherwise(more).alias("spans"))

    return F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def format_conversations(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation from rows (conv_id, turn, role, parts).

    Returns conv_id, n_turns, formatted, loss_mask (spans of code points, start
    from 0), attachments (ordered as their placeholders: turn, type, ref,
    n_tokens) and expanded_tokens (the sum of n_tokens). The mask covers the
    text of every turn of ``loss_role``, without control strings and placeholders.

    Turns sort by turn, then role, then text, nulls first; repeated rows stay.
    Null roles, texts and parts are empty; rows without a conv_id form one
    conversation; an empty table has none. Other columns are not read. A
    conversation is one value of the result, so it must fit in memory.
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("parts").cast(T.ArrayType(PART)), F.array().cast(T.ArrayType(PART))).alias("parts"))
    rows = rows.withColumn("content", F.array_join(F.transform("parts", visit), "")).withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)))
    rows = rows.withColumn("segment", F.concat("head", "content", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), ""), "parts")
    before = F.coalesce(F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = F.filter("parts", lambda p: p["type"].isin(*ATTACHMENTS))
    rows = rows.select(
        "conv_id", F.row_number().over(order).alias("at"), "segment", (F.col("role") == loss_role).alias("loss"),
        (before + F.length("head")).alias("start"), F.when(F.col("role") == loss_role, text_spans(F.col("parts"))).alias("spans"),
        F.transform(found, lambda p: F.struct(F.col("turn").cast("long").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), p["n_tokens"].alias("n_tokens"))).alias("attached"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "segment", "loss", "start", "spans", "attached"))).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
        F.flatten(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.transform(t["spans"], lambda s: F.struct((t["start"] + s["start"]).alias("start"), s["length"].alias("length"))))).alias("loss_mask"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + F.coalesce(a["n_tokens"], F.lit(0))).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, content) of a formatted conversation, unescaped."""
    segments = F.filter(F.split(formatted, r"<\|start\|>"), lambda _, i: i > 0)

    def turn(segment: Column) -> Column:
        at = F.instr(segment, SEP)
        return F.struct(
            unescape(F.substring(segment, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(segment, at + len(SEP), F.length(segment) - at - len(SEP) - len(END) + 1)).alias("content"),
        )

    return F.transform(segments, turn)


def read_loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
