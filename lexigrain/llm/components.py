"""Connected components by alternating stars; every step is an aggregate and a join.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): a
large star hangs the larger neighbours of each node on its least neighbour, a
small star hangs the smaller ones there. A star's centre is found by a partial
aggregate; what it hangs there is joined to it by a shuffle, and for the few hubs
with very many neighbours by a broadcast of the hubs.

A graph of few edges lies in one partition, so its rounds need no shuffle: dealt to
hundreds of partitions, each step would be as many tasks that the driver keeps account of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, joined, release

#: Neighbours from which on a node is a hub, whose star is joined by a broadcast.
HUB = 1000
#: Edges up to which a graph lies in one partition (16 bytes each).
FEW = 100_000


def _union(x: DataFrame, y: DataFrame, few: bool) -> DataFrame:
    both = x.unionByName(y)
    return both.coalesce(1) if few else both


def _both(edges: DataFrame, few: bool) -> DataFrame:
    return _union(edges, edges.select(F.col("b").alias("a"), F.col("a").alias("b")), few)


def _hung(edges: DataFrame, centre: DataFrame, total: int, hubs: bool) -> DataFrame:
    found = centre.select("a", "m")
    return joined(edges, found, "a", centre, total, hot=HUB) if hubs else edges.join(found, "a")


def _large_star(edges: DataFrame, total: int, hubs: bool, few: bool) -> DataFrame:
    both = _both(edges, few)
    centre = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return _hung(both.filter("b > a"), centre, 2 * total, hubs).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int, hubs: bool, few: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    centre = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hung = _hung(down, centre, total, hubs).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _union(hung, centre.select("a", F.col("m").alias("b")), few)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for all nodes of ``edges(a, b)``; root is the least node reachable.

    Nodes are longs. Null ends, loops and repeated edges are ignored. An empty
    edge table gives an empty result. Raises if ``rounds`` do not suffice (each
    round at least halves the depth, so 60 reach any table).
    """
    now = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
              .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, few = None, False
    for step in range(rounds):
        nodes = _both(now, few).groupBy("a").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"))
        total = nodes.agg(F.sum("n"), F.bit_xor(F.xxhash64("a", "h")), F.max("n")).first()
        if not total[0] or total == seen:
            return _union(now.select(F.col("a").alias("node"), F.col("b").alias("root")), now.select(F.col("b").alias("node"), F.col("b").alias("root")), few).distinct()
        seen = total
        if not few and total[0] // 2 <= FEW:  # rounds don't add edges
            now, few = now.coalesce(1), True
        hubs = not few and total[2] > HUB
        stars = _large_star(now, total[0] // 2, hubs, few)
        now = cut(_small_star(cut(stars) if hubs else stars, total[0] // 2, hubs, few).distinct())
        if step % 3 == 2:
            release(now.sparkSession)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
