"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: target weight x output size / source
size. A document's count is the inverse of that Poisson distribution at a
uniform number hashed from the seed and its id (where ids don't tell the rows
apart: from the whole row), so it needs no state and no coordination. The row is exploded by its count and all copies are
put in a global order by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, told_apart

#: Bytes of the sources' distributions that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, hashed from ``seed`` and the parts' texts (null is as empty)."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, size: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source``, ``weight``, ``rate`` per source; a null source is one of its own.

    ``weights`` are shares of the output in UTF-8 bytes, normalised; sources
    that it leaves out get 0. Without it a source's weight is its size to the
    power ``alpha``. ``size`` is the output's size as a multiple of the input's.
    """
    own = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("bytes"))
    if weights is None:
        own = own.withColumn("w", F.pow(F.col("bytes").cast("double"), F.lit(float(alpha))))
    else:
        given = F.lit(None).cast("double")
        for name, w in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(given)
        own = own.withColumn("w", F.coalesce(given, F.lit(0.0)))
    own = cut(own)
    total = own.agg(F.sum("w").alias("w"), F.sum("bytes").alias("bytes")).first()
    weight = F.col("w") / F.lit(total.w) if total.w else F.lit(0.0)
    return own.select("source", weight.alias("weight"), (weight * size * F.lit(float(total.bytes or 0)) / F.col("bytes")).alias("rate"))


def distribution(rate: DataFrame) -> DataFrame:
    """``rate`` with ``cdf``, its Poisson distribution function as far as doubles can tell it from 1."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    terms = rate.filter("rate > 0").select("source", "weight", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k")
    log_p = F.sum(F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log(F.col("k").cast("double")))).over(upto)
    terms = terms.withColumn("p", F.exp(log_p)).withColumn("c", F.sum("p").over(upto))
    return terms.groupBy("source", "weight", "rate").agg(F.sort_array(F.collect_list("c")).alias("cdf"))


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, size: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row per copy: all columns of ``docs`` and ``rate``, ``copies``, ``copy`` (from 1), ``shuffle_key``.

    Rows come in the global order of (``shuffle_key``) within hash partitions;
    sorting by it gives one total order. A null source is a source. In a table
    where ids are null or repeat, each row's draw and key are hashed from all its
    columns and its number among equal rows, so every row has draws of its own.
    Null, empty and long texts count by their bytes. Columns of those four names in
    ``docs`` are replaced. An empty table gives an empty one.
    """
    spread = cut(distribution(rates(docs, weights, alpha, size, source_col, text_col)))
    held = spread.agg(F.sum(F.size("cdf") * 8 + F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    key, cdf, rate, copies, copy, order, row = (free_name(docs, n) for n in ("mix_source", "cdf", "rate_", "copies_", "copy_", "order_", "row_"))
    spread = spread.select(F.col("source").alias(key), F.col("cdf").alias(cdf), F.col("rate").alias(rate))
    if held <= BROADCAST_BYTES:
        spread = F.broadcast(spread)
    names = {rate: "rate", copies: "copies", copy: "copy", order: "shuffle_key"}
    kept = [c for c in docs.columns if c not in names.values()]
    u = uniform(seed, F.col(row))
    made = told_apart(docs.select(kept), id_col, row)
    made = made.join(spread, made[source_col].eqNullSafe(spread[key]))
    made = made.withColumn(copies, F.size(F.filter(F.col(cdf), lambda c: c <= u))).filter(F.col(copies) > 0)
    made = made.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    made = made.withColumn(order, F.md5(F.concat_ws(":", F.lit(seed + "/order"), F.col(row), F.col(copy))))
    out = made.select(*kept, *[F.col(a).alias(b) for a, b in names.items()])
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
