"""Chat formatting with Spark expressions alone.

Output of a conversation: blocks `<|turn|>role<|text|>text<|end|>`; texts of
adjacent turns of one role share a block, with `<|next|>` between them. Any
control string inside a role or text gets one `&` after its first character
(one that already has some gets one more), so no control string survives in a
text and taking one `&` away restores it exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Also escaped: the controls of common other templates.
CONTROL = r"([<\[])(&*)(/?s>|/?INST\]|\|[a-z_]+\|>)"
ESCAPED = r"([<\[])&(&*)(/?s>|/?INST\]|\|[a-z_]+\|>)"
LOSS_ROLE = "assistant"


def escape(text):
    return F.regexp_replace(text, CONTROL, "$1&$2$3")


def unescape(text):
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_mask array<struct<chars, loss>> of each conversation.

    Turns are ordered by turn (null first), then role, then text as they were
    given, so repeated turns have a defined order and all stay. Null role or text is empty; null
    conv_id is a conversation of its own. loss_mask gives the string's
    consecutive runs in code points; loss marks the assistant's texts alone. A
    conversation becomes one string, so it has to fit one row.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    grouped = grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))))
    # the turns that open a block, and one past the last turn
    opens = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    grouped = grouped.withColumn("opens", F.concat(opens, F.array(F.size("turns") + 1)))
    blocks = F.transform(F.slice("opens", F.lit(1), F.size("opens") - 1), lambda a, i: F.struct(F.element_at("turns", a)["role"].alias("role"), F.transform(F.slice("turns", a, F.get("opens", i + 1) - a), lambda t: t["text"]).alias("texts")))
    grouped = grouped.select("conv_id", blocks.alias("blocks"))
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(TURN), b["role"], F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(END))), "")
    run = lambda chars, loss: F.struct(chars.cast("bigint").alias("chars"), loss.alias("loss"))
    plain = lambda n: run(n, F.lit(False))
    runs = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(plain(F.length(b["role"]) + len(TURN) + len(TEXT))),
                F.flatten(F.transform(b["texts"], lambda t, i: F.array(plain(F.when(i > 0, len(NEXT)).otherwise(0)), run(F.length(t), b["role"] == LOSS_ROLE)))),
                F.array(plain(F.lit(len(END)))),
            ),
        )
    )
    return grouped.select("conv_id", whole.alias("formatted"), runs.alias("loss_mask"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_texts array<string>: the turns as they were, and what the mask covers, unescaped.

    The inverse of format_chat but for the turn numbers. An empty string has no turns.
    """
    parts = F.filter(F.split("formatted", r"<\|end\|>"), lambda b: b != "")
    pairs = F.transform(parts, lambda b: F.split(F.substring(b, F.lit(len(TURN) + 1), F.length(b)), r"<\|text\|>", 2))
    turns = F.flatten(F.transform(pairs, lambda p: F.transform(F.split(p[1], r"<\|next\|>"), lambda t: F.struct(unescape(p[0]).alias("role"), unescape(t).alias("text")))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<a:bigint,n:bigint>>").alias("cut"))
    cuts = F.aggregate("loss_mask", start, lambda acc, r: F.struct((acc["at"] + r["chars"]).alias("at"), F.when(r["loss"], F.array_append(acc["cut"], F.struct((acc["at"] + 1).alias("a"), r["chars"].alias("n")))).otherwise(acc["cut"]).alias("cut")))["cut"]
    loss = F.transform(cuts, lambda c: unescape(F.substring(F.col("formatted"), c["a"].cast("int"), c["n"].cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_texts"), "formatted")
