"""Chat formatting after collapsing cumulative snapshots.

A conversation is often logged again after each turn. Every turn gets the hash
of the turns up to it (two lanes of 64 bits, each the XOR of hashes of place,
role and text, so that it rolls along a window). A conversation whose last hash
is the hash of a proper prefix of another one goes; of equal ones the least id
stays. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``pos``, ``n``, ``h1``, ``h2`` for each turn.

    Turns are ordered by (turn, role, text), nulls first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("pos", F.row_number().over(order))
    same = [F.col("pos"), F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    return rows.withColumn("h1", F.bit_xor(F.xxhash64(F.lit(1), *same)).over(upto)).withColumn("h2", F.bit_xor(F.xxhash64(F.lit(2), *same)).over(upto))


def maximal(rolled: DataFrame) -> DataFrame:
    """``conv_id``, ``n`` of the conversations that no longer one continues."""
    whole = rolled.filter("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    parts = rolled.filter("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(parts, ["n", "h1", "h2"], "left_anti").select("conv_id", "n")


def formatted(turns: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """``conv_id``, ``n_turns``, ``chat`` for each maximal conversation.

    A null role is rendered as ``user``, a null text as empty; rows without a
    conversation id are one conversation, whose id is null. Repeated rows are
    turns of their own. Other columns are not read. An empty table gives an
    empty one.
    """
    rolled = cut(prefixes(turns))
    kept = maximal(rolled).withColumnRenamed("conv_id", "kept_id")
    rows = rolled.select("conv_id", "pos", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    said = F.concat(F.lit(start), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end + "\n"))
    lines = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", said.alias("said")))).alias("t"))
    return lines.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.col("t.said"), "").alias("chat"))
