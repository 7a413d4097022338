"""Chat formatting: turns become one marked text a conversation, with the spans
that a loss is taken over, by Spark expressions only.

A run of turns by one role is one block:

    <turn>role<text>first text<text>second text</turn>\\n

Inside texts and roles a backslash becomes \\b and the "<" of a control string
becomes \\l, so control strings never occur there and blocks split apart again
by plain string search; reading back undoes both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<turn>", "<text>", "</turn>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for control in (TURN, TEXT, END):
        out = F.replace(out, F.lit(control), F.lit("\\l" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """conv_id, formatted and spans (start, length of each learned text within
    formatted, from 0, in code points).

    Defined results: a null text or role is empty; a null conv_id is a
    conversation of its own; turns sort by turn (null first), then role, then
    text, so ties and repeated rows have one order and all stay; other columns
    are ignored; an empty table gives an empty table. One conversation has to
    fit one row, as its formatted text does.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    # escaped after sorting: escapes would change the order of ties
    sorted_turns = sorted_turns.withColumn("t", F.transform("t", lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text"))))
    n = F.size("t")
    # where runs of one role begin, and one past the end
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    runs = sorted_turns.withColumn("starts", F.concat(starts, F.array(n))).withColumn(
        "blocks",
        F.transform(
            F.sequence(F.lit(0), F.size("starts") - 2),
            lambda k: F.struct(
                F.get(F.col("t"), F.get("starts", k))["role"].alias("role"),
                F.transform(F.slice("t", F.get("starts", k) + 1, F.get("starts", k + 1) - F.get("starts", k)), lambda x: x["text"]).alias("texts"),
            ),
        ),
    )
    body = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(TURN), b["role"], F.array_join(F.transform(b["texts"], lambda x: F.concat(F.lit(TEXT), x)), ""), F.lit(END + "\n"))), "")
    span = "struct<start:bigint,length:bigint>"
    begun = lambda pos, b: pos + F.lit(len(TURN)) + F.char_length(b["role"])
    none = F.array().cast(f"array<{span}>")

    def one_block(acc: Column, b: Column) -> Column:
        def one_text(a: Column, x: Column) -> Column:
            size, at = F.char_length(x).cast("long"), a["pos"] + len(TEXT)
            new = F.array(F.struct(at.alias("start"), size.alias("length")))
            return F.struct((at + size).alias("pos"), F.when(b["role"] == learn_from, F.concat(a["spans"], new)).otherwise(a["spans"]).alias("spans"))

        inner = F.aggregate(b["texts"], F.struct(begun(acc["pos"], b).cast("long").alias("pos"), acc["spans"].alias("spans")), one_text)
        return F.struct((inner["pos"] + len(END) + 1).alias("pos"), inner["spans"].alias("spans"))

    spans = F.aggregate("blocks", F.struct(F.lit(0).cast("long").alias("pos"), none.alias("spans")), one_block)["spans"]
    return runs.select("conv_id", body.alias("formatted"), spans.alias("spans"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted text: array of (role, text)."""
    blocks = F.filter(F.split(formatted, F.lit(END + "\n")), lambda b: F.startswith(b, F.lit(TURN)))
    parts = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(TURN) + 1)), F.lit(TEXT)))
    return F.flatten(F.transform(parts, lambda p: F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(x).alias("text")))))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
