import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexigrain.llm import resharding


def test_flow_is_cheapest():
    rng = random.Random(2)
    for _ in range(60):
        old, new = rng.randrange(1, 4), rng.randrange(1, 4)
        supply = {i: rng.randrange(0, 4) for i in range(old)}
        capacity = {j: rng.randrange(0, 5) for j in range(new)}
        if sum(capacity.values()) < sum(supply.values()):
            with pytest.raises(ValueError):
                resharding.solve(supply, capacity)
            continue
        cost = {(a, b): rng.randrange(0, 6) for a in supply for b in capacity}
        flow = resharding.solve(supply, capacity, cost)
        assert all(sum(v for (a, _), v in flow.items() if a == x) == supply[x] for x in supply)
        assert all(sum(v for (_, b), v in flow.items() if b == x) <= capacity[x] for x in capacity)
        units = [a for a in supply for _ in range(supply[a])]
        best = min((sum(cost[a, b] for a, b in zip(units, to)) for to in itertools.product(capacity, repeat=len(units)) if all(to.count(b) <= capacity[b] for b in capacity)), default=0)
        assert sum(cost[k] * v for k, v in flow.items()) == best


def test_moves_only_the_surplus():
    supply = {0: 900, 1: 20, 2: 80}
    flow = resharding.solve(supply, resharding.even(1000, 4))
    assert sum(v for (a, b), v in flow.items() if a != b) == 900 - 250 + 0


def frame(spark, n=900):
    rng = random.Random(6)
    data = [(i, "ä" * int(rng.paretovariate(0.9) * 5 % 4000), rng.choice("aaab")) for i in range(n)] + [(None, None, None), (4, "same", "b"), (4, "same", "b")]
    return data, spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("slot", F.lit("own")).withColumn("_run", F.lit(1)).withColumn("lo", F.lit(5))


def test_even_bytes_and_gapless_slots(spark):
    data, df = frame(spark)
    old = F.when(F.col("source") == "a", 0).when(F.col("source") == "b", 5)
    got = resharding.reshard(df, old, 8).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((i or -1, t or "") for i, t, _ in data)
    assert all(r.size == len((r.text or "").encode()) + 1 for r in got) and got[0]._run == 1 and got[0].lo == 5
    size, slots, kept = defaultdict(int), defaultdict(list), 0
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        kept += r.size * (r.shard == r.old_shard)
    total = sum(size.values())
    row = max(r.size for r in got)
    assert set(size) == set(range(8)) and all(abs(s - total / 8) <= row for s in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert abs(kept - 2 * total / 8) <= 2 * row
    again = resharding.reshard(df.repartition(7), old, 8).collect()
    key = lambda r: (r.doc_id or -1, r.text or "", r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rewrite_touches_affected_shards_only(spark, tmp_path):
    _, df = frame(spark, 200)
    df = df.drop("slot")
    size = df.agg(F.sum(resharding.row_bytes(F.col("text")))).first()[0]
    old = F.when(F.col("doc_id") < 100, 0).otherwise(1)
    mine = df.filter("doc_id < 100").agg(F.sum(resharding.row_bytes(F.col("text")))).first()[0]
    same = resharding.reshard(df, old, capacity={0: mine, 1: size - mine})
    assert resharding.rewrite(same, str(tmp_path / "none")) == []
    grown = resharding.reshard(df, old, capacity={0: mine, 1: (size - mine) // 2, 2: size})
    assert resharding.rewrite(grown, str(tmp_path / "out")) == [1, 2]
    assert spark.read.parquet(str(tmp_path / "out")).count() == grown.filter("shard > 0").count()


def test_rewrite_in_a_folder_that_holds_the_old_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = [(i, "x" * (i % 7), i % 4) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumn("slot", F.col("doc_id")).write.partitionBy("shard").parquet(path)
    files = lambda n: sorted(p.name for p in (tmp_path / "shards" / f"shard={n}").glob("*.parquet"))
    kept = files(0)
    old = spark.read.parquet(path)
    size = {r.shard: r.n for r in old.groupBy("shard").agg(F.sum(resharding.row_bytes(F.col("text"))).alias("n")).collect()}
    moved = resharding.reshard(old.select("doc_id", "text", F.col("shard").alias("was")), F.col("was"), capacity={0: size[0], 1: size[1] + size[3], 2: size[2] // 2, 5: size[2]})
    want = sorted((r.doc_id, r.text, r.shard, r.slot) for r in moved.collect())
    assert resharding.rewrite(moved, path) == [1, 2, 3, 5]
    got = spark.read.parquet(path)
    untouched = {i for i, _, n in rows if n == 0}
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted((i, t) for i, t, _ in rows)
    assert sorted((r.doc_id, r.text, r.shard, r.slot) for r in got.filter("shard <> 0").collect()) == [w for w in want if w[0] not in untouched]
    assert files(0) == kept and not (tmp_path / "shards" / "shard=3").exists()


def test_slots_are_shuffled(spark):
    df = spark.createDataFrame([(i // 4, f"t{i // 4 % 50}" * (1 + i // 4 % 90), "a") for i in range(4000)] + [(None, "none", "a")] * 3000, "doc_id long, text string, source string")
    got = resharding.reshard(df, F.lit(0), 4).collect()
    at = {(r.shard, r.slot): r for r in got}
    assert len(at) == len(got) == 7000
    rows = [r for r in got if r.doc_id is not None]
    twins = sum((o := at.get((r.shard, r.slot + 1))) is not None and o.doc_id == r.doc_id for r in rows)
    assert twins <= 20  # by chance: 4000 x 3 / 7000
    for n in range(4):
        own = sorted((r for r in got if r.shard == n), key=lambda r: r.slot)
        mean = sum(r.size for r in own) / len(own)
        half = sum(r.size for r in own[: len(own) // 2]) / (len(own) // 2)
        assert abs(half - mean) < 0.2 * mean


def test_very_long_texts_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(resharding, "BLOCK_ROWS", 5)
    df = spark.createDataFrame([(i, "x" * (200_000 if i % 97 == 0 else i % 13), "a") for i in range(700)], "doc_id long, text string, source string")
    got = resharding.reshard(df, F.col("doc_id") % 3, 5).collect()
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert sorted(r.doc_id for r in got) == list(range(700)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(s - sum(size.values()) / 5) <= 200_001 for s in size.values())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert resharding.reshard(df, F.lit(0)).count() == 0
