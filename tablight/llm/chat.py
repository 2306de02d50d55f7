"""Operator 10: chat formatting by prefix-target expansion, DataFrame functions only.

Every assistant turn becomes one example: all turns before it are the context
and only its reply is trainable.  Turns after the last reply (or a
conversation without one) form a closing example without a trainable part, so
the examples of a conversation hold all of its turns.

A turn is written as ``<|turn|>role<|text|>text<|end|>``.  Control strings
inside roles and texts are escaped reversibly: their first character becomes
an entity (``&lt;`` or ``&lb;``), and an ampersand that would read as one of
the three entities becomes ``&amp;``.

Defined cases: null role or text counts as empty; rows are ordered by turn,
then role, then text (nulls first), so ties and repeated rows have one order;
a null conv_id is a conversation of its own; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings that may not occur inside a text: the template's own marks
#: (all begin with ``<|``) and those of common instruction templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
ENTITY = {"<": "&lt;", "[": "&lb;"}
#: Turns that are joined before a conversation is put together, so that the
#: first step spreads a long conversation over many tasks.
BLOCK = 64


def escape(c: Column) -> Column:
    c = F.regexp_replace(c, r"&(?=(amp|lt|lb);)", "&amp;")
    for s in CONTROLS:
        c = F.replace(c, F.lit(s), F.lit(ENTITY[s[0]] + s[1:]))
    return c


def unescape(c: Column) -> Column:
    for plain, entity in ENTITY.items():
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its formatted turns in order, as an array of
    (role, segment); built from blocks of turns first."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select(
        "conv_id", "turn",
        F.concat(F.lit(TURN), escape(role), F.lit(TEXT)).alias("head"),
        escape(text).alias("body"), (role == "assistant").alias("reply"),
        F.col("role").alias("_r"), F.col("text").alias("_t"))
    item = F.struct("turn", F.col("_r"), F.col("_t"), "head", "body", "reply")
    blocks = (rows.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"))
              .agg(F.sort_array(F.collect_list(item)).alias("part")))
    slim = F.transform("part", lambda x: F.struct(x["head"].alias("head"), x["body"].alias("body"),
                                                  x["reply"].alias("reply")))
    whole = F.sort_array(F.collect_list(F.struct("block", slim.alias("part"))))
    return (blocks.groupBy("conv_id").agg(whole.alias("parts"))
            .select("conv_id", F.flatten(F.transform("parts", lambda p: p["part"])).alias("turns")))


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_chars.

    The trainable part is ``substring(formatted, loss_start, loss_chars)``
    (1-based code points); ``loss_start`` is 0 in a closing example.
    """
    conv = turns_of(conversations)
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")),
                    lambda i: F.element_at("turns", i)["reply"] | (i == F.size("turns")))
    per = conv.select("conv_id", "turns", F.posexplode(ends).alias("example", "upto"))
    seg = lambda t: F.concat(t["head"], t["body"], F.lit(END))
    last = F.element_at("turns", F.col("upto"))
    per = per.select(
        "conv_id", "example",
        F.concat(F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("upto") - 1), seg), ""),
                 last["head"]).alias("context"),
        last["body"].alias("body"), last["reply"].alias("reply"))
    return per.select(
        "conv_id", "example", F.concat("context", "body", F.lit(END)).alias("formatted"),
        F.when(F.col("reply"), F.length("context") + 1).otherwise(0).alias("loss_start"),
        F.when(F.col("reply"), F.length("body")).otherwise(0).alias("loss_chars"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: number and digest of the
    turns (of the longest example, which holds them all), length and digest of
    all trainable text in order, and the total length of the examples."""
    loss = F.when(F.col("loss_start") > 0,
                  unescape(F.expr("substring(formatted, loss_start, loss_chars)"))).otherwise(F.lit(""))
    per = examples.select("conv_id", "example", "formatted", F.length("formatted").cast("long").alias("_len"),
                          loss.alias("_loss"))
    agg = per.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", "_loss"))).alias("losses"),
        F.sum("_len").alias("formatted_chars"))
    turns = F.filter(F.split("whole", r"\Q" + END + r"\E"), lambda s: F.length(s) > 0)

    def plain(seg: Column) -> Column:
        body = F.substring_index(seg, TEXT, -1)
        head = F.substring_index(F.substring_index(seg, TEXT, 1), TURN, -1)
        return F.concat(unescape(head), F.lit("\n"), unescape(body), F.lit("\n"))

    text = F.array_join(F.transform("losses", lambda x: x["_loss"]), "")
    agg = agg.select("conv_id", "formatted_chars", turns.alias("segs"), text.alias("loss"))
    return agg.select(
        "conv_id", F.size("segs").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("segs", plain), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
