"""Prefix-target chat examples, on DataFrame functions only (operator 4).

Every assistant turn becomes an example of its own: all earlier turns as context, only that reply under the loss mask. Null
texts and roles count as empty; turns are ordered by turn, role, text (nulls first), so ties and repeated rows have one
order. A conversation that does not end with an assistant turn has one more example that holds all turns and no mask, so no
turn is lost. A null conv_id is a conversation of its own; columns other than the four are ignored. A conversation is one
row here, as any reader of a whole example needs it in one piece; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of the template. No mark has "<" but at its start, so escaped texts cannot form one, alone or across a border.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Control strings of this and of other common templates, escaped inside texts by their first character.
CONTROL = r"<(?=\|im_start\||\|im_end\||\|endoftext\||s>|/s>)"
BRACKET = r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.regexp_replace(F.regexp_replace(text, CONTROL, "&lt;"), BRACKET, "&#91;")


def unescape(text: Column) -> Column:
    for mark, char in (("&lt;", "<"), ("&#91;", "["), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def format_prefix_targets(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant"
) -> DataFrame:
    """Examples: conv, example (from 1), target_turn, text, loss_start, loss_end (code points, end exclusive; -1 for no mask)."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    convs = turns.groupBy(F.col(conv).alias("conv")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body")))
    convs = convs.select("conv", parts.alias("parts"))
    n = F.size("parts")
    last = F.get("parts", n - 1)["role"]
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get("parts", i - 1)["role"] == trained) | ((i == n) & (last != trained)))
    examples = convs.select("conv", "parts", F.posexplode(ends).alias("nth", "end"))
    target = F.get("parts", F.col("end") - 1)
    joined = F.transform(F.slice("parts", F.lit(1), F.col("end")), lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE)))
    examples = examples.select("conv", "nth", "end", F.array_join(joined, "").alias("text"), target.alias("target"))
    stop = F.length("text") - len(CLOSE)
    masked = F.col("target.role") == trained
    return examples.select(
        F.col("conv").alias(conv), (F.col("nth") + 1).alias("example"), F.when(masked, F.col("end")).alias("target_turn"), "text",
        F.when(masked, stop - F.length("target.body")).otherwise(-1).alias("loss_start"), F.when(masked, stop).otherwise(-1).alias("loss_end"),
    )


def read_back(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests per conversation from the examples alone: turns from the longest text, loss text from the masks in order."""
    loss = F.when(F.col("loss_start") >= 0, F.struct("example", F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")).alias("body")))
    read = examples.groupBy(conv).agg(
        F.max(F.struct("example", "text"))["text"].alias("whole"), F.array_sort(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    pieces = F.split("whole", r"<\|im_end\|>\n<\|im_start\|>|^<\|im_start\|>|<\|im_end\|>\n$")
    turns = F.slice(pieces, F.lit(2), F.size(pieces) - 2)
    plain = F.transform(turns, lambda t: F.concat(unescape(F.substring_index(t, "\n", 1)), F.lit("\n"), unescape(F.substr(t, F.instr(t, "\n") + 1)), F.lit("\n")))
    told = F.array_join(F.transform("losses", lambda x: unescape(x["body"])), "")
    return read.select(
        conv, F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(plain, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(told).cast("long").alias("loss_chars"), F.sha2(told.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def planted(turns: DataFrame) -> DataFrame:
    """The turns and a conversation -1 whose texts hold another template's control strings."""
    extra = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)
