import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexigrain.llm import components as components_of
from lexigrain.llm import simhash
from lexigrain.llm.components import components


def slow_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n\x0b\x0c\r", "One", "a B", "Ä É x\x1cy Z\x85 Q", "the cat sat on the mat " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == signed(slow_print(text))
    assert simhash.fingerprint(text, block=5) == signed(slow_print(text))


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for x in list(prints)[:120]:
        for flips in (1, 2, 3, 4):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), flips)))
    base = rng.getrandbits(64)
    prints |= {base ^ sum(1 << b for b in rng.sample(range(40, 64), 3)) for _ in range(150)}
    prints |= {0, 1, (1 << 64) - 1}
    rows = sorted(map(signed, prints))
    a = np.array(rows).astype(np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    want = {(rows[i], rows[j]) for i, j in zip(*np.nonzero(near)) if i > j}
    df = spark.createDataFrame([(x,) for x in rows], "fp long")
    for hot in (1000, 3):
        got = [tuple(r) for r in simhash.links(df, hot).collect()]
        assert set(got) == want and len(got) == len(want)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)] + [(7, 7), (None, 3), (3, 2)]
    df = spark.createDataFrame(edges, "a long, b long")
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = roots({x for e in real for x in e}, real)
    assert {r.node: r.root for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(900)]
    texts = [" ".join(rng.choices(words, k=150)) for _ in range(40)]
    texts += [t.replace(" ", "\n", 2) for t in texts[:10]] + [t + " tail" for t in texts[:20]] + [None, "", " ", "x", "x"] + [" ".join(words * 12)]
    rows = [(i + 5, t, "z") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = {i: slow_print(t) for i, t, _ in rows}
    pairs = [(i, j) for i in prints for j in prints if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3]
    want = roots(prints, pairs)
    assert got == {i: (signed(prints[i]), want[i]) for i in prints}
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == set(want.values())


def test_hard_rows(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "lone words here"), (None, "lone words here")], "doc_id long, text string")
    kept = simhash.keep_one(df.withColumn("root", F.lit(1)).withColumn("component_id", F.lit(2)))
    assert kept.columns == ["doc_id", "text", "root", "component_id"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "lone words here"), (1, "a b c d")]
    assert simhash.near_duplicates(df).count() == 5
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.keep_one(df.limit(0)).count()


def test_repeated_ids_of_different_texts(spark):
    one, two = "the first text of this id", "words of quite another kind here"
    df = spark.createDataFrame([(1, one), (1, two), (1, two), (2, one), (3, "third thing"), (4, "fourth thing"), (4, "third thing")], "doc_id long, text string")
    for parts in (1, 5):
        got = sorted((r.doc_id, r.text) for r in simhash.keep_one(df.repartition(parts)).collect())
        assert got == [(1, one), (1, two), (3, "third thing"), (4, "fourth thing")]


def test_components_in_one_partition_and_dealt_out(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(1000 + i, 1001 + i) for i in range(70)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(9)
    stages = spark.sparkContext.statusTracker()
    tasks = {}
    for few in (components_of.FEW, 0):
        monkeypatch.setattr(components_of, "FEW", few)
        spark.sparkContext.setJobGroup(f"few {few}", "")
        got = {r.node: r.root for r in components(df).collect()}
        nodes = {x for p in pairs if p[0] != p[1] for x in p}
        assert got == {x: y for x, y in roots(nodes, pairs).items()}
        jobs = [stages.getJobInfo(j) for j in stages.getJobIdsForGroup(f"few {few}")]
        tasks[few] = sum(stages.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if stages.getStageInfo(s))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks[100_000] < 0.6 * tasks[0]
