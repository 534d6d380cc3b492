import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrain.llm import mixing


def rows():
    out = [(i, "x" * (i % 50), "big") for i in range(600)] + [(1000 + i, "y" * 400, "mid") for i in range(90)] + [(2000 + i, "z" * 30, None) for i in range(25)]
    return out


def slow_count(seed, doc, rate):
    u = int(hashlib.md5(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while c <= u and k < 10_000:
        k += 1
        p *= rate / k
        c += p
    return k


@pytest.mark.parametrize("weights", [None, {"big": 1, "mid": 3, "absent": 9}])
def test_counts_equal_brute_force(spark, weights):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("copy", F.lit("own")).withColumn("cdf", F.lit(1))
    size = Counter()
    for _, t, s in data:
        size[s] += len(t or "") + 1
    w = {s: weights.get(s, 0) if weights else n**0.5 for s, n in size.items()}
    rate = {s: w[s] / sum(w.values()) * 2 * sum(size.values()) / size[s] for s in size}
    got = mixing.replicated(df, weights, size=2.0).collect()
    want = Counter()
    for i, t, s in data:
        for k in range(slow_count("mix", i, rate[s])):
            want[i, t, s, k + 1] += 1
    assert Counter((r.doc_id, r.text, r.source, r.copy) for r in got) == want
    assert all(abs(r.rate - rate[r.source]) < 1e-9 * r.rate for r in got)
    assert "cdf" in got[0].asDict()


def test_mean_meets_the_rate_and_order_mixes(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "'t' as text", "if(id % 4 = 0, 'a', 'b') as source")
    got = mixing.replicated(df, {"a": 0.5, "b": 0.5}).cache()
    share = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert all(abs(n - 10000) < 400 for n in share.values())
    first = got.orderBy("shuffle_key").limit(1000).groupBy("source").count().collect()
    assert all(abs(r["count"] - 500) < 80 for r in first)


def test_rows_without_an_id_and_repeats_draw_each_for_itself(spark):
    data = [(None, "same text", "a")] * 6000 + [(None, f"text {i}", "a") for i in range(2000)] + [(5, "again", "a")] * 3000 + [(i, "w " * 9000, "b") for i in range(3)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.replicated(df, {"a": 1.0, "b": 0.5}, size=2.0).cache()
    rate = {r.source: r.rate for r in got.select("source", "rate").distinct().collect()}
    for where, n in (("text = 'same text'", 6000), ("text LIKE 'text %'", 2000), ("doc_id = 5", 3000)):
        mean = got.filter(where).count() / n
        assert abs(mean - rate["a"]) < 5 * (rate["a"] / n) ** 0.5
    spread = got.filter("text = 'same text'").groupBy("copies").count().collect()
    assert len(spread) >= 4
    assert got.select("shuffle_key").distinct().count() == got.count()
    key = lambda r: (r.doc_id or -1, r.text, r.source, r.copies, r.copy, r.shuffle_key)
    assert sorted(map(key, got.collect())) == sorted(map(key, mixing.replicated(df.repartition(7), {"a": 1.0, "b": 0.5}, size=2.0).collect()))


def test_shuffled_distributions_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    a = sorted(r.shuffle_key for r in mixing.replicated(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(r.shuffle_key for r in mixing.replicated(df).collect()) == a


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.replicated(df).count() == 0
