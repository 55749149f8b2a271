"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns
of one role are merged into one block, and the blocks are concatenated:

    <|im_start|>role
    text<|turn|>text<|im_end|>

Control strings inside roles and texts are escaped: every run of bars after a
``<`` gets one bar more, so ``<|`` followed by anything but a bar is always the
template's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TURN, LINE = "<|im_start|>", "<|im_end|>", "<|turn|>", "<|line|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\|+)", r"<|$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\|(\|+)", "<$1")


def _role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(LINE))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conv_id: ``formatted`` text and its loss ``mask``.

    ``mask`` covers the formatted text from its start, one entry for each turn:
    ``skip`` code points of template, then ``n`` code points of (escaped) text,
    under the loss if ``loss``; what is left at the end is template.

    A conversation is one output value, so its turns meet in one task, as the
    format itself demands; conversations are spread over all tasks.

    Defined cases: null texts and roles are empty; turns are sorted by turn (null
    first), then role, then text; equal rows are turns like any other; a null
    conv_id is a conversation; an empty table gives no rows; other columns are
    not read.
    """
    src = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    got = src.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def part(x: Column, i: Column) -> Column:
        before = F.get("t", i - 1)
        same = (i > 0) & before["role"].eqNullSafe(x["role"])
        opened = F.concat(F.lit(START), _role(x["role"]), F.lit("\n"))
        head = F.when(same, F.lit(TURN)).otherwise(F.concat(F.when(i > 0, F.lit(END + "\n")).otherwise(F.lit("")), opened))
        return F.struct(head.alias("head"), escape(x["text"]).alias("text"), (x["role"] == loss_role).alias("loss"))

    parts = got.select("conv_id", F.transform("t", part).alias("p"))
    return parts.select(
        "conv_id",
        F.concat(F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["text"])), ""), F.lit(END + "\n")).alias("formatted"),
        F.transform("p", lambda x: F.struct(F.length(x["head"]).alias("skip"), F.length(x["text"]).alias("n"), x["loss"].alias("loss"))).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of formatted conversations: conv_id, formatted_chars and ``turns`` (role, text, loss).

    Read from the formatted text alone, but for ``loss``, which is the mask's; a
    mask whose lengths differ from the text's is an error.
    """
    blocks = F.slice(F.split("formatted", r"<\|im_end\|>\n", -1), 1, F.size("mask"))  # the last one is empty

    def block(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        role = unescape(F.replace(F.substring(head, len(START) + 1, 1 << 30), F.lit(LINE), F.lit("\n")))
        body = F.substr(b, F.length(head) + 2)
        texts = F.split(body, r"<\|turn\|>", -1)
        return F.transform(texts, lambda x, i: F.struct(
            role.alias("role"), x.alias("text"),
            F.when(i > 0, F.lit(len(TURN))).otherwise(F.length(head) + 1).alias("skip"), i.alias("i")))

    filled = F.filter(blocks, lambda b: b != "")
    turns = F.flatten(F.transform(filled, lambda b, k: F.transform(
        block(b), lambda x: F.struct(x["role"], x["text"], (x["skip"] + F.when((k > 0) & (x["i"] == 0), len(END) + 1).otherwise(0)).alias("skip")))))
    zipped = F.zip_with("r", "mask", lambda r, m: F.when(
        r["skip"].eqNullSafe(m["skip"]) & F.length(r["text"]).eqNullSafe(m["n"]),
        F.struct(r["role"].alias("role"), unescape(r["text"]).alias("text"), m["loss"].alias("loss"))
    ).otherwise(F.raise_error(F.lit("the mask does not fit the text"))))
    return (formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), "mask", turns.alias("r"))
            .select("conv_id", "formatted_chars", zipped.alias("turns")))
