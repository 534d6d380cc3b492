"""Resharding by minimum-cost flow.

Old shards supply their bytes, new shards take their capacities, and a byte
costs nothing where it stays and 1 where it moves (or what ``cost`` says). The
flow that meets all capacities at least cost is solved on the driver; its size
is the number of shards, never of rows. Each old shard is then a line of bytes,
size classes of large rows first, and the flow cuts the line: its beginning stays, the rest goes
to the shards that the flow names. Where a row lies on its line comes from the totals
of size classes, of blocks within a class, and a running sum within a block; each
class has as many blocks as its rows need. Within a new shard rows are in the order
of a hash, so that neighbours of the input, and copies, are not neighbours there.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dropped, free_name, told_apart

#: Rows of a block, about.
BLOCK_ROWS = 2048


def solve(supply: dict[int, int], capacity: dict[int, int], cost: dict[tuple[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """Bytes to send from each old to each new shard, at least cost (successive shortest paths).

    Raises ValueError if the capacities hold less than the supply.
    """
    if sum(capacity.values()) < sum(supply.values()):
        raise ValueError("the new shards hold less than the old ones")
    price = (lambda a, b: int(a != b)) if cost is None else (lambda a, b: cost[a, b])
    left, room = dict(supply), dict(capacity)
    flow: dict[tuple[int, int], int] = {}
    potential_old, potential_new = dict.fromkeys(supply, 0), dict.fromkeys(capacity, 0)
    while any(left.values()):
        dist: dict[tuple[str, int], int] = {}
        before: dict[tuple[str, int], tuple[str, int] | None] = {}
        heap = [(0, "old", a, None) for a in left if left[a]]
        heapq.heapify(heap)
        while heap:
            d, side, x, via = heapq.heappop(heap)
            if (side, x) in dist:
                continue
            dist[side, x], before[side, x] = d, via
            if side == "old":
                for b in capacity:
                    if ("new", b) not in dist:
                        heapq.heappush(heap, (d + price(x, b) + potential_old[x] - potential_new[b], "new", b, ("old", x)))
            else:
                for a in supply:
                    if ("old", a) not in dist and flow.get((a, x), 0):
                        heapq.heappush(heap, (d - price(a, x) + potential_new[x] - potential_old[a], "old", a, ("new", x)))
        end = min((b for b in capacity if room[b] and ("new", b) in dist), key=lambda b: (dist["new", b] + potential_new[b], b))
        far = max(dist.values(), default=0)
        path, at = [], ("new", end)
        while at is not None:
            path.append(at)
            at = before[at]
        path.reverse()
        amount = min([left[path[0][1]], room[end]] + [flow[b[1], a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "new"])
        for a, b in zip(path, path[1:], strict=False):
            pair = (a[1], b[1]) if a[0] == "old" else (b[1], a[1])
            flow[pair] = flow.get(pair, 0) + (amount if a[0] == "old" else -amount)
        left[path[0][1]] -= amount
        room[end] -= amount
        for a in supply:
            potential_old[a] += dist.get(("old", a), far)
        for b in capacity:
            potential_new[b] += dist.get(("new", b), far)
    return {k: v for k, v in flow.items() if v}


def even(total: int, shards: int) -> dict[int, int]:
    return {j: total * (j + 1) // shards - total * j // shards for j in range(shards)}


def cuts(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, from byte, to byte, new): each old shard's line, what stays first."""
    out = []
    for a in sorted({a for a, _ in flow}):
        at = 0
        for b in sorted((b for x, b in flow if x == a), key=lambda b: (b != a, b)):
            out.append((a, at, at + flow[a, b], b))
            at += flow[a, b]
    return out


def row_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def reshard(docs: DataFrame, old: Column, shards: int = 8, capacity: dict[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: str = "shard") -> DataFrame:
    """``docs`` with ``size``, ``old_shard``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``old`` gives the shard where a row lies now (an int; null is 0). Without
    ``capacity`` the new shards share the bytes evenly; sizes miss that by less
    than a row at each cut, and cuts lie among small rows. Slots are in the order of
    a hash of ``seed`` and the row. The same rows always get the same shards and
    slots; equal rows, and rows without an id, are told apart by their number among
    equal rows and are placed each by itself. A null text has no bytes but its one.
    Columns of those four names in ``docs`` are replaced. An empty table gives an
    empty one.
    """
    names = ["size", "old_shard", "shard", "slot"]
    size, shard_of, kind, block, mix, run, rank, base, place, new, n, first, lo, hi, home, many, row, after = (free_name(docs, f"_{x}") for x in ("size", "old", "class", "block", "mix", "run", "rank", "base", "place", "new", "n", "first", "lo", "hi", "home", "many", "row", "after"))
    kept = [c for c in docs.columns if c not in names]
    spark = docs.sparkSession
    sized = docs.withColumn(size, row_bytes(F.col(text_col))).withColumn(shard_of, F.coalesce(old.cast("int"), F.lit(0))).select(*kept, size, shard_of)
    sized = sized.withColumn(kind, -F.floor(2 * F.log2(F.col(size).cast("double"))).cast("int"))
    sums = sorted(tuple(r) for r in sized.groupBy(shard_of, kind).agg(F.sum(size), F.count("*")).collect())  # a row per old shard and size class, of which there are 130 at most
    supply: dict[int, int] = {}
    classes = []
    for a, k, held, rows_there in sums:
        classes.append((a, k, supply.get(a, 0), 1 + rows_there // BLOCK_ROWS))
        supply[a] = supply.get(a, 0) + held
    if not supply:
        return sized.select(*kept, F.col(size).alias("size"), F.col(shard_of).alias("old_shard"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    line = cuts(solve(supply, capacity or even(sum(supply.values()), shards)))
    starts = F.broadcast(spark.createDataFrame(classes, f"{shard_of} int, {kind} int, {base} long, {many} int"))  # as many rows as sums
    whole = told_apart(sized, id_col, row, again=True)
    rows = whole.select(row, size, shard_of, kind).join(starts, [shard_of, kind])  # texts stay where they are until the places are known
    rows = rows.withColumn(mix, F.xxhash64(F.lit(seed), row)).withColumn(block, F.pmod(F.xxhash64(F.lit(seed), mix), F.col(many)).cast("int"))
    key = [shard_of, kind, block]
    totals = cut(rows.groupBy(*key, base).agg(F.sum(size).alias(n)))
    before = Window.partitionBy(shard_of, kind).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*key, (F.col(base) + F.coalesce(F.sum(n).over(before), F.lit(0))).alias(after))
    inside = Window.partitionBy(*key).orderBy(mix, row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn(run, F.sum(size).over(inside)).join(totals, key)
    rows = rows.withColumn(place, F.col(after) + F.col(run) - F.floor((F.col(size) + 1) / 2))
    ways = spark.createDataFrame(line, f"{home} int, {lo} long, {hi} long, {new} int")
    rows = rows.join(F.broadcast(ways), (F.col(shard_of) == F.col(home)) & (F.col(place) >= F.col(lo)) & (F.col(place) < F.col(hi)))  # a row per pair of shards
    bits = max(1, (sum(x[3] for x in sums) // (BLOCK_ROWS * len({x[3] for x in line}))).bit_length())
    rows = cut(rows.select(row, mix, new, F.shiftright(mix, 64 - bits).alias(block)))
    counts = cut(rows.groupBy(new, block).agg(F.count("*").alias(n)))
    earlier = Window.partitionBy(new).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(new, block, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(first))  # one row per BLOCK_ROWS rows of a shard
    rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy(new, block).orderBy(mix, row))).join(firsts, [new, block])
    placed = rows.select(row, F.col(new), (F.col(first) + F.col(rank) - 1).alias(place))
    return whole.join(placed, row).select(*kept, F.col(size).alias("size"), F.col(shard_of).alias("old_shard"), F.col(new).alias("shard"), F.col(place).alias("slot"))


def rewrite(resharded: DataFrame, path: str) -> list[int]:
    """Write the shards whose rows change, one folder ``shard=N`` each; the numbers of those shards.

    A shard that neither loses nor takes a row keeps its files; the folder of one
    that has lost all its rows is removed. ``resharded`` may be read from ``path``.
    """
    spark = resharded.sparkSession
    changed = resharded.filter("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()
    moved = sorted(r.s for r in changed.collect())  # shard numbers only
    if moved:
        rows = cut(resharded.filter(F.col("shard").isin(moved)))  # nothing is read from the folder while it changes
        filled = {r.shard for r in rows.select("shard").distinct().collect()}  # shard numbers only
        rows.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
        for n in moved:
            if n not in filled:
                dropped(spark, f"{path}/shard={n}")
    return moved
