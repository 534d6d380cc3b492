import random
import time

from pyspark.sql import functions as F

from lexigrain.llm import common, decontam


def slow_tiles(doc, item, least):
    """Greedy string tiling straight from its definition."""
    used_d, used_t, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for t in range(len(item)):
                n = 0
                while d + n < len(doc) and t + n < len(item) and doc[d + n] == item[t + n] and d + n not in used_d and t + n not in used_t:
                    n += 1
                if n > best[0]:
                    best = (n, d, t)
        n, d, t = best
        if n < least:
            return out / len(item)
        used_d.update(range(d, d + n))
        used_t.update(range(t, t + n))
        out += n


def test_coverage_equals_brute_force():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(9)]
    for least in (2, 3, 5):
        for _ in range(40):
            item = rng.choices(vocabulary, k=rng.randrange(least, 20))
            doc = rng.choices(vocabulary, k=30)
            a, b = sorted(rng.sample(range(len(item) + 1), 2))
            doc[5:5] = item[b:] + item[:a]
            doc += item[a:b]
            got = decontam.covered(" ".join(doc), " ".join(item), least)
            assert abs(got[0] - slow_tiles(doc, item, least)) < 1e-9, (doc, item)


def test_repeated_words_cost_no_product():
    began = time.perf_counter()
    assert decontam.covered("same " * 20_000, "same " * 2_000) == (1.0, 1, 2000)
    assert decontam.covered("a b " * 10_000, "b a " * 900 + "x")[0] > 0.99
    assert time.perf_counter() - began < 10


def frames(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    items = [(i, " ".join(word() for _ in range(rng.randrange(20, 50)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "Tiny One")]
    text = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], set()
    for i in range(60):
        body = [text(40), text(30)]
        if i % 3 == 0:
            k = rng.randrange(30)
            ws = items[k][1].upper().split()
            half = len(ws) // 2
            body.insert(1, " ".join(ws[half:]) + ".\n" + text(9) + " " + ", ".join(ws[:half]) if i % 2 else " ".join(ws))
            want.add((i, k))
        rows.append((i, " ".join(body)))
    rows += [(900, None), (901, ""), (902, "so a tiny, one-off"), (903, text(30000) + " " + items[3][1]), (None, items[4][1]), (None, items[4][1])]
    want |= {(902, 102), (903, 3), (None, 4)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("coverage", F.lit(1))
    return docs, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(2)), want


def test_leaks(spark, monkeypatch):
    docs, items, want = frames(spark)
    for most in (common.BROADCAST_BYTES, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
        monkeypatch.setattr(decontam, "LEAST_BITS", 20 if most else 8)
        monkeypatch.setattr(decontam, "BITS", 64 if most else 1)
        got = decontam.leaks(docs, items).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) + 1
        kept = decontam.clean(docs, items)
        assert kept.columns == docs.columns
        assert kept.count() == docs.count() - len(got)
    assert decontam.leaks(docs, items.limit(0)).count() == 0 == decontam.leaks(docs.limit(0), items).count()
    assert decontam.clean(docs, items.limit(0)).count() == docs.count()
