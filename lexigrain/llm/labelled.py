"""Bounded labelled samples, as the classifiers of this package are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_text, cut


def held_out(id_col: Column | str, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id, written as text, leaves ``remainder``; a null id is not held out."""
    return F.coalesce(crc_text(id_col) % mod == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], rows: int, parts: int = 8) -> DataFrame:
    """``text``, ``y`` of at most ``rows`` labelled documents of each class, outside the held-out fold.

    The rows are those whose ids hash least, so they don't depend on order or
    partitioning. Labels that are null, or neither 0 nor 1, are ignored; an id
    with both labels counts as 1. Only the sampled ids (2 x ``rows`` at most)
    are broadcast; each id gives one text, that of the least hash.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id", *fold))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(cut(picked)), "doc_id")
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return cut(one.select("t.text", "y").repartition(parts))
