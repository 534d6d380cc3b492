import random

from pyspark.sql import functions as F

import corpus_pipeline
from lexigrain.llm import shingles, simhash
from lexigrain.llm.common import table

from .test_simhash import roots

SF = "/root/testdata/sf0.001"


def slow_set(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset([tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else []))


def slow_kept(texts):
    """Ids that stay of ``{id: text}``, by comparing all pairs."""
    sets = {i: slow_set(t) for i, t in texts.items()}
    alike = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    return sorted(set(roots(sets, [(i, j) for i in sets for j in sets if i < j and alike(sets[i], sets[j])]).values()))


def test_stage_finds_all_similar_documents(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = sorted(r.doc_id for r in corpus_pipeline.near_distinct(spark, docs, SF).collect())
    assert got == slow_kept(texts)
    assert {1, 6} <= set(got) and not {177, 145} & set(got)  # 11 and 7 of 64 bits apart


def test_groups_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for n in (1, 2, 3, 4, 6) * 30:
        words = list(base)
        for i in rng.sample(range(120), n):
            words[i] = f"x{rng.randrange(3)}"
        texts.append(" ".join(words))
    chain = [f"c{i}" for i in range(100)]
    texts += [" ".join(chain[i : i + 70]) for i in range(0, 30, 5)] + [None, "", " \n", "One two", "one  TWO", "one two three", "a b c d e", "a b c d f"]
    for order in range(2):
        rng.shuffle(texts)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert sorted(r.doc_id for r in simhash.keep_one(df, words=5, threshold=(4, 5)).collect()) == slow_kept(dict(enumerate(texts)))


def test_rows_that_repeat_an_id_and_empty(spark):
    data = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words than these ones here"), (2, "other words than these ones here"), (None, "a b c d e f"), (None, "lone"), (None, "lone")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(df, words=5, threshold=(4, 5)).collect())
    assert got == [(0, "lone"), (1, "a b c d e f"), (1, "other words than these ones here")]
    assert simhash.keep_one(df.limit(0), words=5, threshold=(4, 5)).count() == 0


def test_fingerprints_find_the_close_pairs(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(30)]
    texts += [t + " and a tail" for t in texts] + texts[:5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    made = df.select(shingles.sketch_udf(shingles.rarity(df), 5, (4, 5))("text").alias("s")).select("s.fp", "s.sim").distinct()
    pairs = {tuple(r) for r in shingles.near_prints(made).collect()}
    assert len(pairs) >= 25 and all(a > b for a, b in pairs)


def test_pairs_of_a_group_come_out_of_the_join_once(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(80):
        words = list(base)
        for j in rng.sample(range(400), rng.choice([2, 4, 8, 12])):
            words[j] = f"x{i}y{j}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    each = df.select("id", shingles.sketch_udf(shingles.rarity(df), 5, (4, 5))("text").alias("s")).select("id", "s.*").cache()
    postings = each.select("fp", F.posexplode("first").alias("i", "word"))
    label = spark.createDataFrame([], "fp long, label long")
    rows = [tuple(r) for r in shingles.meetings(postings, label, each.select("fp", "n", "parity")).collect()]
    sets = {r.fp: slow_set(texts[r.id]) for r in each.collect()}
    first = {r.fp: set(r["first"]) for r in each.collect()}
    assert all(a > b for a, b in rows)
    want = {(a, b) for a in sets for b in sets if a > b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(want) > 200 and want <= set(rows)
    shared = sum(len(first[a] & first[b]) for a, b in set(rows))  # the rows of a join on words alone
    assert len(rows) < 1.2 * len(set(rows)) < 0.1 * shared


def test_sets_larger_than_the_finer_map(spark):
    rng = random.Random(6)
    texts = []
    for n in (3900, 4090, 4110, 9000):
        base = [f"{n}w{i}" for i in range(n)]
        texts.append(" ".join(base))
        texts.append(" ".join(base + [f"{n}t{i}" for i in range(n // 10)]))  # on the other side of a power of two for 3900 and 4090
        for k in (n // 60, n // 30):
            words = list(base)
            for i in rng.sample(range(n), k):
                words[i] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(words))
        texts.append(" ".join(base[:40] + [f"z{rng.randrange(10**9)}" for _ in range(n)]))  # a passage, else nothing
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = df.select(shingles.sketch_udf(shingles.rarity(df), 5, (4, 5))("text").alias("s")).select("s.*").cache()
    assert all(64 * len(r.fine) >= max(2048, r.n) for r in made.collect())
    links = made.alias("x").join(made.alias("y"), (F.col("x.fp") > F.col("y.fp")) & shingles._alike_fine("x", "y", (4, 5))).select("x.n", "y.n").collect()
    assert 8 <= len(links) <= 16
    assert sorted(r.doc_id for r in simhash.keep_one(df, words=5, threshold=(4, 5)).collect()) == slow_kept(dict(enumerate(texts)))
