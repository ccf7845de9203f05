"""Chat formatting with Spark expressions only.

A conversation becomes one string. Turns are collected as structs, sorted, and adjacent turns of
one role share one header; the parts of such a block stay apart by a mark, so the original turns
can be read back. Texts and roles are escaped so that none of them can hold a control string.

Template (fixed values):

    <|begin|>                               once
    <|role|>ROLE<|text|>PART<|part|>PART<|end|>   for each block
    <|eos|>                                 once

Defined results: a null text or role is empty; turns are ordered by (turn, role, text), null
turns first; repeated rows are repeated turns; a null conv_id is a conversation of its own; no rows
give no conversations; only the four named columns are read, so others may be present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, ROLE, TEXT, PART, END, EOS = "<|begin|>", "<|role|>", "<|text|>", "<|part|>", "<|end|>", "<|eos|>"

#: Every control string of this and the usual templates holds one of these; undone in reverse order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _split(text: Column, mark: str) -> Column:
    return F.split(text, mark.replace("|", "\\|"), -1)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id and formatted.

    collect_list combines on the map side, so a conversation that holds a large share of the rows
    crosses the shuffle as a few partial lists.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Sorted before they are escaped: escapes would change the order of equal turns.
    collected = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    collected = collected.withColumn("t", F.transform("t", lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text"))))

    def rendered(x: Column, i: Column) -> Column:
        same = (i > 0) & (F.element_at("t", F.greatest(i, F.lit(1)))["role"] == x["role"])
        header = F.concat(F.when(i > 0, F.lit(END)).otherwise(""), F.lit(ROLE), x["role"], F.lit(TEXT))
        return F.concat(F.when(same, F.lit(PART)).otherwise(header), x["text"])

    body = F.array_join(F.transform("t", rendered), "")
    return collected.select("conv_id", F.concat(F.lit(BEGIN), body, F.lit(END), F.lit(EOS)).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_parts, the texts under the loss mask, all from formatted."""

    def block_turns(block: Column) -> Column:
        role = unescape(F.substring_index(block, TEXT, 1))
        inner = F.substring_index(F.substring_index(block, TEXT, -1), END, 1)
        return F.transform(_split(inner, PART), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    blocks = _split(F.col("formatted"), ROLE)
    out = formatted.withColumn("blocks", F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))))
    out = out.withColumn("turns", F.flatten(F.transform("blocks", block_turns))).drop("blocks")
    assistant = F.filter("turns", lambda t: t["role"] == "assistant")
    return out.withColumn("loss_parts", F.transform(assistant, lambda t: t["text"]))


def digest(read: DataFrame) -> DataFrame:
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.array_join("loss_parts", "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return loss.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
