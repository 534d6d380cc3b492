import random
import re

import pytest
from pyspark.sql import functions as F

from lexigrain.llm import secrets

KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(2)) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24),
)


def slow(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m)]
    return sorted(spans)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, "the orderly reading of ordinary-words and other_identifiers in running text " * 3) for i in range(30)], "doc_id long, text string")
    return secrets.train(secrets.samples(docs, rows=20))


def rows():
    rng = random.Random(12)
    bits = ["token", "Api_Key", "APIKEY", "secret", "pass", "password", "passwd", '"', "'", ":", "=", " ", "  ", "\n", "AKIA", "AKIAAKIA", "abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOP", "é😀", "x.y/z+w=-_", "ſecret", "toKen", "12345"]
    out = [(i, "".join(rng.choices(bits, k=rng.randrange(1, 60)))) for i in range(400)]
    return out + [(900, None), (901, ""), (None, "token=token:abcdefgh"), (902, "secret = 'abcde' " * 3000), (903, "é" * 70000 + "password==a.b-c/d"), (900, None)]


def test_base_spans_equal_brute_force(spark, model):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("base_spans", F.lit(1)).withColumn("ratios", F.lit(2))
    got = secrets.scanned(df, model).collect()
    assert len(got) == len(data) and got[0].ratios == 2
    for r in got:
        assert [tuple(s) for s in r.base_spans] == slow(r.text)
    text = secrets.scanned(df.filter("doc_id < 50"), model).select("text", secrets.written(F.col("base_spans")).alias("w"), secrets.count_of(F.col("base_spans"), "hex").alias("n")).collect()
    for r in text:
        assert r.w == ",".join(f"{k}:{a}:{b}" for a, _, b, k in slow(r.text)) and r.n == sum(s[3] == "hex" for s in slow(r.text))


def test_models_tell_random_from_ordinary(spark, model):
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_ = ["".join(rng.choices(alphabet, k=rng.randrange(32, 60))) for _ in range(60)]
    plain = ["the_running_text_of_other_ordinary_words", "reading-and-other-identifiers-in-words", "=" * 60, "-" * 40, "internationalization_of_the_reading"]
    df = spark.createDataFrame([(i, f"so {w} é, here") for i, w in enumerate(random_ + plain)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scanned(df, model).collect()}
    caught = sum(len(got[i].added_spans) == 1 for i in range(60))
    assert caught >= 55 and all(not got[60 + i].added_spans for i in range(len(plain)))
    s = next(r.added_spans[0] for r in got.values() if r.added_spans)
    assert (s.start, s.number, s.kind) == (3, 3, "markov") and "".join(got[0].text[3 : 3 + len(random_[0])]) == random_[0]


def test_added_spans_keep_off_base_spans(spark, model):
    key = "Zq7Xw9Kp2Vr5Tn8Ym3Jd6Hf1Gs4"
    df = spark.createDataFrame([(1, f"token={key} {key}")], "doc_id long, text string")
    r = secrets.scanned(df, model).first()
    assert [s.kind for s in r.base_spans] == ["assign"] and [(s.start, s.end) for s in r.added_spans] == [(7 + len(key), 7 + 2 * len(key))]


def test_empty_tables(spark, model):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.scanned(df, model).count() == 0
    untrained = secrets.train(spark.createDataFrame([], "text string, label int"))
    one = spark.createDataFrame([(1, "token=abcdefgh x" + "a" * 30)], "doc_id long, text string")
    assert secrets.scanned(one, untrained).first().added_spans == []
    assert secrets.samples(df).filter("label = 1").count() == 4 * secrets.GENERATED
