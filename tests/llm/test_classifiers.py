import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from lexigrain.llm import labelled, quality, toxicity


def corpus(rng, n, bad_words, junk):
    good = ["w%s%s" % (a, b) for a in "abcdefghij" for b in "klmnopqr"]
    rows = []
    for i in range(n):
        y = i % 3 == 0
        words = rng.choices(good, k=rng.randrange(30, 200))
        if y:
            words = junk(words) if junk else words
            for _ in range(len(words) // 30 + 1 if bad_words else 0):
                words[rng.randrange(len(words))] = rng.choice(bad_words)
        rows.append((i, " ".join(words), int(y)))
    return rows


def frames(spark, rows, label):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows], "doc_id long, text string, score string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {label} int")
    return docs, labels


def test_held_out(spark):
    rows = [(i,) for i in range(50)] + [(None,)]
    got = spark.createDataFrame(rows, "doc_id long").select("doc_id", labelled.held_out("doc_id", 4, 2).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_sample_is_bounded_and_held_out(spark):
    rows = [(i, f"t{i}", i % 2) for i in range(200)]
    docs, labels = frames(spark, rows, "toxic")
    labels = labels.unionByName(spark.createDataFrame([(1, 0), (None, 1), (3, None), (9999, 1)], labels.schema))
    got = labelled.sample(docs.unionByName(docs), labels, "toxic", (4, 2), 30).collect()
    assert len(got) == 60 and all(zlib.crc32(r.text[1:].encode()) % 4 != 2 and int(r.text[1:]) % 2 == r.y for r in got)


def test_quality_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = corpus(rng, 300, [], lambda ws: [w + rng.choice(["!!", "&&&"]) for w in ws] if rng.random() < 0.5 else [w for w in ws[:8] for _ in range(9)])
    docs, labels = frames(spark, [(i, t, 1 - y) for i, t, y in rows], "quality")
    model = quality.fit(docs, labels, rows=200)
    hard = spark.createDataFrame([(1000, None, "x", "y"), (1001, "", "x", "y"), (None, "waK wbL", "x", "y"), (1003, "wak " * 60000, "x", "y")], docs.schema)
    got = quality.scored(docs.unionByName(hard), model, name="p").collect()
    assert len(got) == 304 and all(0 <= r.p <= 1 for r in got)
    truth = {i: 1 - y for i, _, y in rows}
    seen = [(r.p >= 0.3, truth[r.doc_id]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(seen) > 30 and sum(a == b for a, b in seen) >= 0.95 * len(seen)
    assert {round(r.p, 12) for r in got if r.text in (None, "")}.__len__() == 1
    assert quality.scored(docs.limit(0), model).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, quality.DIM))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    model = quality.fit_network(x, y, np.zeros((1, quality.DIM)))
    p = model.scores(x[:600])
    assert abs(p.mean() - y[:600].mean()) < 0.15 and model.temperature > 1


@pytest.mark.parametrize("kind,label", [(quality, "quality"), (toxicity, "toxic")])
def test_no_or_one_class(spark, kind, label):
    docs, labels = frames(spark, [(1, "a b", 1), (2, "c", 1), (3, "d", 1)], label)
    for some in (labels, labels.limit(0)):
        rows = kind.scored(docs, kind.fit(docs, some), name="p").collect()
        assert len(rows) == 3 and all(0 <= r.p <= 1 for r in rows)


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(5)
    rows = corpus(rng, 360, ["zum%s" % c for c in "abcdefgh"], None)
    docs, labels = frames(spark, rows, "toxic")
    model = toxicity.fit(docs, labels, rows=300)
    hard = spark.createDataFrame([(1000, None, "x", "y"), (1001, "", "x", "y"), (None, "wak zumz", "x", "y"), (1003, "wak " * 60000, "x", "y")], docs.schema)
    got = toxicity.scored(docs.unionByName(hard), model, name="p").collect()
    assert len(got) == 364 and all(0 <= r.p <= 1 for r in got)
    truth = {i: y for i, _, y in rows}
    seen = [(r.p >= 0.3, truth[r.doc_id]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(seen) > 40 and sum(a == b for a, b in seen) >= 0.95 * len(seen)
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_counterfactual_penalty_spares_groups(spark):
    """One group is named in most toxic texts; with the penalty its name alone no longer counts."""
    rng = random.Random(9)
    rows = []
    for i, t, y in corpus(rng, 360, ["zumpf"], None):
        ws = t.split()
        if y and rng.random() < 0.9:
            ws[0] = "muslim"
        elif not y and rng.random() < 0.3:
            ws[0] = "christian"
        rows.append((i, " ".join(ws), y))
    docs, labels = frames(spark, rows, "toxic")
    score = {}
    for penalty in (0.0, 50.0):
        model = toxicity.fit(docs, labels, rows=300, penalty=penalty)
        neutral = "wak wbl wcm muslim wdn wek wfl"
        score[penalty] = [model.score(neutral.replace("muslim", g)) for g in ("muslim", "christian", "hindu")]
        assert model.score("wak wbl zumpf wcm " * 3) > 0.5
    assert score[0.0][0] - score[0.0][1] > 0.15
    assert max(score[50.0]) - min(score[50.0]) < 0.05 and score[50.0][0] < 0.3
    assert toxicity.swaps(["a", "men", "men"])[0] == ["a", "women", "women"]


def test_neutral_terms_and_their_kinds(spark):
    """Terms that stand in for each other in both classes are found, and a swap of them changes the score less with the penalty."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        y = i % 2
        ws = []
        for _ in range(40):
            ws += ["the", rng.choice(["reds", "blues", "greens"]), "came", rng.choice(["zumpf", "zumpe"]) if y and rng.random() < 0.2 else rng.choice(["today", "often", "then"])]
        rows.append((i, " ".join(ws), y))
    docs, labels = frames(spark, rows, "toxic")
    sample = labelled.sample(docs, labels, "toxic", (4, 2), 300)
    kinds = [set(k) for k in toxicity.neutral_kinds(sample)]
    assert {"reds", "blues", "greens"} in kinds and not any("zumpf" in k for k in kinds)
    free, held = (toxicity.fit(docs, labels, rows=300, penalty=p) for p in (0.0, 20.0))
    assert free.swapped == held.swapped > 300 and held.moved < 0.5 * free.moved
    assert held.score("the reds came zumpf " * 5) > 0.6 > 0.3 > held.score("the reds came today " * 5)


def test_swaps_of_a_text_are_bounded():
    kinds = (tuple(f"t{i}" for i in range(30)),)
    counts = {"t1": 2, "t5": 1}
    some = toxicity.options(counts, kinds, "x")
    assert len(some) == toxicity.SWAPS and some == toxicity.options(counts, kinds, "x") != toxicity.options(counts, kinds, "y")
    cache = toxicity._Words(lambda w: [int(w[1:])])
    assert toxicity.change(counts, (["t1", "t5"], "t9"), cache, 10) == pytest.approx({9: 3 / 0.6, 1: -2 / 0.6, 5: -1 / 0.6})


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_scores_equal_brute_force(spark, kind):
    """The query's scores, by a plain reading of the model: equal texts alike, word order and repeats as stated."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = kind.fit(docs, labels)
    got = kind.scored(docs, model, name="p").select("doc_id", "text", "p").collect()
    for r in got:
        if kind is toxicity:
            found = [w for i, w in enumerate(ws) if not i or ws[i - 1] != w] if (ws := re.findall(r"\w+", r.text.lower())) else []
            x = model.bias
            for w in found:
                x += sum(model.weights[model.slots[f]] for f in toxicity.word_features(w) if model.slots[f] >= 0) / (toxicity.SHARE * (toxicity.GROWN + len(found)))
            want = 1 / (1 + math.exp(-max(-30, min(30, x))))
        else:
            tokens = re.findall(r"\w+|[^\w\s]+", r.text)
            ids = []
            for t in tokens:
                b = xxhash.xxh32_intdigest(("\x00loud" if len(t) > 1 and t.isupper() else t.lower()).encode()) % quality.BUCKETS
                again = bool(ids) and ids[-1][0] == b
                ids.append((b, again))
            flat = [v for b, again in ids for v in ([b, xxhash.xxh32_intdigest(b"\x00same") % quality.BUCKETS] if again else [b])]
            mean = model.vectors[flat].astype(float).sum(0) / max(1, len(flat)) if flat else np.zeros(quality.DIM)
            h = np.tanh((mean - model.mean) / model.scale @ model.w1 + model.b1)
            want = 1 / (1 + math.exp(-max(-30, min(30, float(h @ model.w2 + model.b2) / model.temperature))))
        assert r.p == pytest.approx(want, abs=2e-4), r.doc_id
    assert len({(r.text, r.p) for r in got}) == len({r.text for r in got})
