"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

Loggers that store a conversation after each turn leave many conversations that are
prefixes of longer ones. Each turn's hash covers its place, role and text; the hash
of a prefix is the exclusive-or of its turns' hashes, twice 64 bits, and rolls on
from turn to turn. A conversation goes if its whole hash is a longer conversation's
prefix hash, by an anti-join; of equal conversations the one with the smallest id
stays. What stays is rendered turn by turn.

A conversation may hold very many turns: places and rolling hashes are made in
blocks of turn numbers first, and only a block's count and hash go on to the next
level, so no window meets more rows than a block has, or blocks a conversation.
Prefix hashes collapse to distinct ones with map-side combining before they are
joined, so a common first turn is one row.

Defined results: a null role or text counts as empty; turns that repeat entirely
count once; turns of one number are ordered by role and text; a null turn number
comes first; a null conversation id is one conversation, below all others. Very long
texts are rendered whole. An empty table gives no rows. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Turn numbers in a block.
BLOCK = 256
_NO_ID = -(2**63)


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, pos, p1, p2): places from 1 and the hashes of the prefixes that end there."""
    none = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_NO_ID))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(none(conv_col).alias("conv"), none(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).dropDuplicates()
    rows = rows.withColumn("block", F.shiftright("turn", 8))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("rank", F.row_number().over(inside))
    counts = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("own")).select("conv", "block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    placed = placed.join(counts, ["conv", "block"]).withColumn("pos", F.col("base") + F.col("rank")).drop("base", "rank")
    hashed = placed.withColumns({"e1": F.xxhash64("pos", "role", "text"), "e2": F.xxhash64("text", "pos", "role", F.lit(1))})
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = hashed.withColumns({"r1": F.bit_xor("e1").over(upto), "r2": F.bit_xor("e2").over(upto)})
    whole = hashed.groupBy("conv", "block").agg(F.bit_xor("e1").alias("b1"), F.bit_xor("e2").alias("b2"))
    whole = whole.select("conv", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("b1", "b2")])
    return rolled.join(whole, ["conv", "block"]).select(
        "conv", "turn", "role", "text", "pos", F.col("r1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("p2")
    )


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv): the conversations that are no prefix of a longer one, one of each kind."""
    last = F.max(F.struct("pos", "p1", "p2")).alias("last")
    whole = rolled.groupBy("conv").agg(last).select("conv", "last.*")
    kinds = whole.groupBy("pos", "p1", "p2").agg(F.min("conv").alias("conv"))
    length = whole.select("conv", F.col("pos").alias("n"))
    proper = rolled.select("conv", "pos", "p1", "p2").join(length, "conv").filter("pos < n").select("pos", "p1", "p2").distinct()
    return kinds.join(proper, ["pos", "p1", "p2"], "left_anti").select("conv")


def render(conversations: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>", **columns: str) -> DataFrame:
    """(conv_id, place, rendered): each turn of the maximal conversations, from place 0.

    A conversation's text is its rows' ``rendered`` in order of place.
    """
    rolled = table(turns(conversations, **columns))  # read three times below
    kept = rolled.join(maximal(rolled), "conv", "left_semi")
    text = F.concat(F.lit(start), "role", F.lit("\n"), "text", F.lit(end + "\n"))
    return kept.select(F.when(F.col("conv") != _NO_ID, F.col("conv")).alias("conv_id"), (F.col("pos") - 1).alias("place"), text.alias("rendered"))
