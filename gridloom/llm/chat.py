"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written as `[INST]role[/INST]text</s>`. Inside roles and texts every string that could be read as one of these
marks gets a backslash after its bracket (and one that already has backslashes gets one more), so reading back is exact.
Every assistant turn becomes an example of its own: all turns before it as context and its own text, and only that, under
the loss mask. A conversation that does not end with an assistant turn gets a last example without a target, so that no
turn is lost.

Defined cases: a null role or text is empty; turns are ordered by turn (nulls first), then role and text, and repeated rows
are turns of their own; rows without a conversation id form one conversation; an empty table gives no example; a text of any length stands in its row whole; other columns are not read, whatever their
names. The output
holds every prefix whole, so it grows with the square of the turns of a conversation, as the method asks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the marks of the template and the strings that must not be read as marks
OPEN, SHUT, END = "[INST]", "[/INST]", "</s>"
MARKS = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per example: `conv`, `example` (from 0, in order of its target), `formatted`, and the loss mask as
    `loss_start` and `loss_length` in characters of `formatted` (0 long where there is no target)."""
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    convs = turns.groupBy(F.col(conv).alias("conv")).agg(F.sort_array(F.collect_list(said)).alias("turns"))
    marked = convs.select("conv", F.transform("turns", lambda t: F.struct(
        (t["role"] == target).alias("own"),
        F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SHUT)).alias("head"), escape(t["text"]).alias("body"))).alias("turns"))
    parts = marked.select("conv", "turns", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))).alias("parts"))
    last = F.size("turns") - 1
    aims = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("turns", i)["own"] | (i == last))
    each = parts.select("conv", "turns", "parts", F.posexplode(aims).alias("example", "at"))
    aim = F.get("turns", F.col("at"))
    formatted = F.array_join(F.slice("parts", 1, F.col("at") + 1), "")
    length = F.when(aim["own"], F.length(aim["body"])).otherwise(0)
    return (each.select("conv", "example", formatted.alias("formatted"), length.alias("loss_length"), F.length(aim["body"]).alias("_body"))
            .select("conv", "example", "formatted", (F.length("formatted") - len(END) - F.col("_body")).alias("loss_start"), "loss_length"))


def read_back(out: DataFrame) -> DataFrame:
    """Turns and trained text recovered from `examples`: `conv`, `turns` (role and text), `loss` (all text under the mask, in
    order) and `formatted_chars`."""
    under = out.select("conv", "example", "formatted", unescape(F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_length"))).alias("loss"))
    convs = under.groupBy("conv").agg(
        F.max_by("formatted", "example").alias("whole"), F.sum(F.length("formatted")).alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"))
    pieces = F.split("whole", END)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substring_index(p, SHUT, 1).substr(F.lit(len(OPEN) + 1), F.length(p))).alias("role"),
        unescape(p.substr(F.length(F.substring_index(p, SHUT, 1)) + len(SHUT) + 1, F.length(p))).alias("text")))
    return convs.select("conv", turns.alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
