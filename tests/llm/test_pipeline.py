from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrain.llm import decontam, quality
from lexigrain.llm.common import saved, shared_folder, table

from .test_decontam import slow_tiles
from .test_mixing import slow_count
from .test_shingles import slow_kept

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    folder = shared_folder(spark, "test")
    kept = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = saved(stage(spark, docs, SF), f"{folder}/{i}")
        assert docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1
        kept.append(docs.collect())
    ids = [[r.doc_id for r in rows] for rows in kept]
    text = {r.doc_id: r.text for r in kept[0]}

    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert set(ids[1]) == {i for i in ids[0] if model.scores(quality.pooled(text[i], model.vectors)[None])[0] >= 0.3}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert sum(labels.get(i) == 1 for i in ids[1]) >= 0.95 * sum(labels.get(i) == 1 for i in ids[0])

    assert sorted(ids[2]) == slow_kept({i: text[i] for i in ids[1]})

    items = [decontam.words(r.text) for r in table(spark, SF, "benchmark").collect()]
    grams = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in items]
    clean = []
    for i in ids[2]:
        ws = decontam.words(text[i])
        own = {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)}
        if not any(own & g and slow_tiles([w if w in t else None for w in ws], t, 5) >= 0.6 for t, g in zip(items, grams)):
            clean.append(i)
    assert sorted(ids[3]) == sorted(clean)

    size = defaultdict(int)
    for r in kept[3]:
        size[r.source] += len(r.text.encode()) + 1
    root = {s: n**0.5 for s, n in size.items()}
    rate = {s: root[s] / sum(root.values()) * sum(size.values()) / size[s] for s in size}
    assert Counter(ids[4]) == Counter({r.doc_id: n for r in kept[3] if (n := slow_count("mix", r.doc_id, rate[r.source]))})

    assert Counter(ids[5]) == Counter(ids[4])
    shards = defaultdict(list)
    for r in kept[5]:
        assert r.size == len(r.text.encode()) + 1
        shards[r.shard].append(r)
    total, row = sum(r.size for r in kept[5]), max(r.size for r in kept[5])
    assert set(shards) == set(range(8))
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows))) and abs(sum(r.size for r in rows) - total / 8) <= row

    at = {(r.shard, r.slot): r.doc_id for r in kept[5]}
    twins = sum(at.get((s, n + 1)) == i for (s, n), i in at.items())
    there = Counter((s, i) for (s, _), i in at.items())
    chance = sum(n * (n - 1) / len(shards[s]) for (s, _), n in there.items())
    assert twins <= chance + 4 * chance**0.5 + 1


def test_run_equals_stages(spark):
    a = corpus_pipeline.run(spark, SF)
    assert a.count() > 50 and {"shard", "slot", *table(spark, SF, "documents").columns} <= set(a.columns)


HARD = [(1, None, "en", "a", None), (2, "", None, None, 0), (2, "", None, None, 0), (None, "some words of a text without an id", "en", "a", 3), (None, "some words of a text without an id", "en", "a", 3), (None, "quite other words that nobody else has said", "en", "b", 3),
        (7, "an id that repeats with a text of its own kind", "de", "b", 1), (7, "an id that repeats, and this is another text", "de", "b", 1), (8, "same " * 30_000, "fr", "b", 9), (9, " \n ", "fr", None, 9)]


def hard(spark, n=None):
    return spark.createDataFrame(HARD[:n], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(4) for c in EXTRA})


EXTRA = ("shard", "slot", "size", "copies", "h", "id", "fp", "key", "_new", "score")


@pytest.mark.parametrize("step", range(5))
def test_stages_with_hard_rows(spark, step):
    name, stage = corpus_pipeline.STAGES[step]
    docs = hard(spark)
    got = stage(spark, docs, SF)
    rows = got.collect()
    last = step == len(corpus_pipeline.STAGES) - 1
    assert got.columns == docs.columns or last and set(docs.columns) <= set(got.columns)
    assert stage(spark, hard(spark, 0), SF).count() == 0
    texts = Counter((r.doc_id, r.text) for r in rows)
    assert set(texts) <= {(x[0], x[1]) for x in HARD}
    if name == "SimHash near-dedup":
        assert texts == Counter({(1, None): 1, (7, HARD[6][1]): 1, (7, HARD[7][1]): 1, (8, HARD[8][1]): 1, (None, HARD[3][1]): 1, (None, HARD[5][1]): 1})
    if name == "benchmark decontamination" or last:
        assert sum(texts.values()) == len(HARD)
    if last:
        assert Counter(r["size"] for r in rows) == Counter(len((x[1] or "").encode()) + 1 for x in HARD)
        assert len({(r["shard"], r["slot"]) for r in rows}) == len(HARD)
