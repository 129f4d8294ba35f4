"""Collapse logged snapshots of growing conversations, then render what remains as chat text.

A log often holds a conversation many times, each snapshot with some more turns. Turn by turn a rolling hash of
the prefix is kept; a conversation whose whole hash occurs as a prefix hash of a longer one is dropped by an
anti-join, and of equal ones the smallest id stays. The rolling hash is an exclusive or of hashes of (place,
role, text), so that blocks of a very long conversation can be hashed apart and joined by their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.llm.common import written

TURNS_PER_BLOCK = 256


def numbered_turns(
    turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, block, place from 1, role, text): the turns by turn number, ties by role and text.

    Turns of a conversation are numbered within blocks of turn numbers, and blocks by their sizes, so that no
    task needs a whole conversation.
    """
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )
    # turns without a number come first, in a block of their own
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / TURNS_PER_BLOCK), F.lit(-(2**62))))
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = rows.withColumn("inside", F.row_number().over(inside)).join(starts, ["conv_id", "block"])
    return placed.select("conv_id", "block", (F.col("start") + F.col("inside")).alias("place"), "role", "text")


def _hash(seed: int) -> Column:
    # null and empty are told apart: xxhash64 skips nulls
    flags = F.concat(F.isnull("role").cast("string"), F.isnull("text").cast("string"))
    return F.xxhash64(F.lit(seed), "place", flags, "role", F.lit(seed + 1), "text")


def prefix_hashes(numbered: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2): two rolling hashes of the turns up to each place."""
    hashed = numbered.select("conv_id", "block", "place", _hash(11).alias("a"), _hash(77).alias("b"))
    whole = hashed.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bases = whole.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), zero).alias(f"base_{c}") for c in "ab"])
    upto = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.select("conv_id", "block", "place", *[F.bit_xor(c).over(upto).alias(c) for c in "ab"]).join(bases, ["conv_id", "block"])
    return rolled.select(
        "conv_id", "place", F.col("a").bitwiseXOR(F.col("base_a")).alias("h1"), F.col("b").bitwiseXOR(F.col("base_b")).alias("h2")
    )


def maximal_conversations(numbered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, copy) of the conversations that no other one continues.

    ``copies`` counts the conversations equal to it, which it stands for.
    """
    prefixes = written(prefix_hashes(numbered), "prefixes")
    size = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("place", "h1", "h2"), "place").alias("last"))
    whole = size.select("conv_id", F.col("last.place").alias("n_turns"), F.col("last.h1").alias("h1"), F.col("last.h2").alias("h2"))
    distinct = whole.groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    ends = prefixes.join(whole.select("conv_id", "n_turns"), "conv_id").filter(F.col("place") < F.col("n_turns"))
    shorter = ends.select("h1", "h2").distinct()
    return distinct.join(shorter, ["h1", "h2"], "left_anti").select("conv_id", "n_turns", "copies")


def render_chats(
    turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    before: str = "<|im_start|>", after_role: str = "\n", after: str = "<|im_end|>\n",
) -> DataFrame:
    """(conv_id, part from 0, n_turns, copies, text): the maximal conversations as chat text, in parts of up to
    256 turn numbers, whose texts in order are the whole conversation.

    Each turn is ``before role after_role text after``. Turns go by number, ties by role and text; turns without
    a number come first. A null role or text reads as empty but differs from an empty one when conversations are
    compared. Rows without a conversation id belong to none and are left out. Repeated rows are turns each. An
    empty table gives no rows; other columns are left out.
    """
    numbered = numbered_turns(turns, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    kept = written(maximal_conversations(numbered), "conversations-kept")
    line = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit(after_role), F.coalesce("text", F.lit("")), F.lit(after))
    rows = numbered.join(kept, "conv_id").withColumn("part", F.floor((F.col("place") - 1) / TURNS_PER_BLOCK))
    parts = rows.groupBy("conv_id", "part").agg(
        F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"),
        F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"),
    )
    return parts.select("conv_id", "part", "n_turns", "copies", F.array_join(F.col("lines.line"), "").alias("text"))
