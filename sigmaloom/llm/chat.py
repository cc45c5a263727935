"""Operator 1, chat formatting: collapse of cumulative snapshots, then rendering.

Chat logs often hold one conversation many times, each snapshot a turn or two longer. A rolling hash over
the turns gives every prefix of every conversation a key; a conversation whose last key is also an inner key
of a longer one is a snapshot and goes. What stays is rendered.

Defined results
* turns sort by (turn, role, text), nulls first; repeated rows stay as turns of their own
* a null role reads ``user``, a null text is empty, rows with a null conv_id make one conversation
* of equal conversations the smallest conv_id stays, ``n_copies`` counts them
* an empty table gives no row; columns other than the four read are ignored

The prefix keys are two 64-bit hashes, combined by xor over (place, role, text); only they are shuffled.
The text moves once, and is gathered only for the conversations that stay. A rendered conversation is one row, so its turns meet
in one task; nothing else collects a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TEMPLATE = ("<|{role}|>\n", "\n<|end|>\n")


def prefix_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, place, last, p1, p2): the key of each conversation's first ``place`` turns."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    hashed = turns.select("conv_id", "turn", "role", F.xxhash64("text").alias("text"), F.hash("text").alias("h"))
    placed = hashed.withColumn("place", F.row_number().over(order)).withColumn("last", F.lead(F.lit(False), 1, True).over(order))
    return placed.select(
        "conv_id", "place", "last",
        F.bit_xor(F.xxhash64("place", "role", "text")).over(so_far).alias("p1"),
        F.bit_xor(F.xxhash64(F.lit("b"), "place", "role", "h", "text")).over(so_far).alias("p2"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no prefix of a longer one, one of each set of copies."""
    keys = prefix_keys(turns)
    whole = keys.filter("last").groupBy("place", "p1", "p2").agg(F.min(F.struct("conv_id")).alias("first"), F.count("*").alias("n_copies"))
    inner = keys.filter("not last").groupBy("place", "p1", "p2").agg(F.count("*").alias("n"))
    kept = whole.join(inner, ["place", "p1", "p2"], "left_anti")
    return kept.select("first.conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def render_chats(conversations: DataFrame, template: tuple[str, str] = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) for the maximal conversations."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = maximal_conversations(turns)
    head, tail = template
    before, after = head.split("{role}")
    # a struct is equal to itself even if the id in it is null, so join and grouping share one shuffle of the text
    lines = turns.select(F.struct("conv_id").alias("c"), F.struct("turn", "role", "text").alias("t"))
    lines = lines.join(kept.select(F.struct("conv_id").alias("c"), "n_turns", "n_copies"), "c")
    whole = lines.groupBy("c").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list("t")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(before), t["role"], F.lit(after), t["text"], F.lit(tail))), "")
    return whole.select("c.conv_id", "n_turns", "n_copies", text.alias("text"))
