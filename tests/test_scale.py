"""What shows only on larger or odd tables: a case per finding."""

from pyspark.sql import functions as F

from lexigrain import plans
from lexigrain.functions import text as X
from lexigrain.operators import corpus as C
from lexigrain.operators import convert as V
from lexigrain.operators import langid as L
from lexigrain.operators import lookup as K
from lexigrain.operators import resolve as R
from lexigrain.operators import spans as S

SF = "/root/testdata/sf0.001"


def test_accents_are_composed_in_many_tasks(spark):
    assert plans.QUERIES["accents_composed"](spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    texts = ["´a¨´e", "ˇˇs", "´ˆa ´½ ˘A", "", None, "plain ´"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", X.compose_accents("t").alias("c"))
    assert [r.c for r in rows.orderBy("n").collect()] == ["á¨é", "ˇˇs", "´ˆa ´½ Ă", "", None, "plain ´"]


def test_rows_are_numbered_though_wide_rows_lie_in_more_tasks(spark):
    rows = spark.range(0, 40_000, 1, 8).select(((F.col("id") * 7919) % 40_000).alias("k"), F.concat(*[F.md5((F.col("id") * 9 + i).cast("string")) for i in range(9)]).alias("t"))  # with the text it is many tasks, without it few
    found = C.mix_in(spark.range(200).select(F.col("id").alias("key")), C.numbered(rows, ["k"]).select("n", F.col("k").alias("other"), "t"), 3).persist()
    assert found.count() == 600
    assert found.filter("n <> other").count() == 0


def test_head_that_ends_with_a_line(spark):
    lines = spark.createDataFrame([(1, 0, "abc"), (1, 1, "de"), (2, 0, "abcd"), (2, 1, "e"), (3, 0, "abcde"), (3, 1, "")], "key int, ix int, text string")
    assert sorted((r.key, r.head) for r in C.heads(lines, "key", "ix", most=4).collect()) == [(1, "abc\n"), (2, "abcd"), (3, "abcd")]


def test_held_places_meet_as_equals(spark):
    texts = ["Ein Haus am See und dann noch ein kleines Haus am See.", "Haus", "x² Haus am See, y", "lang davor " * 6 + "kleines Haus am See."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    noted = [("Haus", "in kleines ", " am "), ("Haus", "Ein ", " am See und"), ("Haus", "", ""), ("See", "am ", None), ("Haus", "x" * 40, " am See, y")]
    rejects = spark.createDataFrame(noted, "word string, before string, after string")
    words = S.word_spans(docs, "doc_id", around=30)
    want = set()
    for d, start, end, word, l, r in ((x.doc_id, x.start, x.end, x.word, x.before, x.after) for x in words.collect()):
        assert texts[d][start:end] == word and texts[d][max(0, start - 30) : start] == l and texts[d][end : end + 30] == r
        for w, before, after in noted:
            if w == word and after is not None:
                a, b = min(len(l), len(before)), min(len(r), len(after))
                if l[len(l) - a :] == before[len(before) - a :] and r[:b] == after[:b] and (a + b >= 12 or (a, b) == (len(before), len(after))):
                    want.add((d, start, end, word))
    found = K.held(words, rejects)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 3
    assert "Join [word" not in found._jdf.queryExecution().toString()  # all pairs of a common word


def test_word_places_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "Er ist² da."), (2, None), (2, ""), (3, "Ü")], "doc_id long, text string")
    words = S.word_spans(docs, "doc_id")
    assert sorted(map(tuple, words.collect())) == [(1, 0, 2, "Er"), (1, 3, 6, "ist"), (1, 8, 10, "da"), (3, 0, 1, "Ü")]
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def query_plan(spark, name):
    return plan(plans.QUERIES[name](spark, SF))


def test_texts_are_costed_where_they_lie(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = L.build(docs, 300, 200)
    costs = L.text_costs(docs, "doc_id", tables)
    assert "Join" not in plan(costs) and "Join" not in plan(L.prior_of(costs, "doc_id"))
    words = C.words_of(docs, "doc_id").withColumn("word", F.lower("word"))
    want = words.join(L.word_costs(words, tables), "word").groupBy("doc_id", "lang").agg(F.sum("cost").alias("cost"), F.count("*").alias("words"))
    assert sorted(map(tuple, costs.select("doc_id", "lang", "cost", "words").collect())) == sorted(map(tuple, want.collect()))


def test_runs_keep_a_texts_tokens_together(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = L.foreign_runs(docs.select(F.col("doc_id").alias("key"), "text"), "key", L.build(docs, 300, 200))
    assert plan(found).count("Join") == 1  # with the texts, for the words of each run


def test_walks_over_tokens_have_no_window(spark):
    for name in ("token_offsets", "stops_and_clauses"):
        assert "Window" not in query_plan(spark, name)
    assert "Aggregate" not in query_plan(spark, "resolve_choices") and "Join" not in query_plan(spark, "resolve_choices")


def test_small_parts_are_many_tasks(spark):
    for name in ("numbers_and_prices", "convert_documents"):
        assert plans.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert "candidates" not in query_plan(spark, "convert_documents")


def test_words_meet_few_forms_unshuffled(spark):
    words = spark.createDataFrame([(1, "Haus"), (1, "haus"), (2, "Haus")], "k int, word string")
    factors = spark.createDataFrame([("haus", True, 3), ("haus", False, 2)], "form string, rare_variant boolean, factor int")
    out = C.row_repeats(words.select("k").distinct(), "k", words, C.CASE, factors)
    assert sorted((r.k, r.factor) for r in out.collect()) == [(1, 3), (2, 2)]
    assert "Aggregate [k#" not in plan(out) or "form#" not in plan(out).split("Aggregate [k#")[1].split("\n")[0]
    forms = C.settled(C.variant_counts(words, C.CASE), least=1, share=0.4)
    assert "Aggregate [lower" not in plan(C.against(words.select(F.col("k").alias("doc_id"), F.col("word").alias("text")), C.CASE, forms))


def test_choices_are_settled_as_over_tables(spark):
    from lexigrain.plans.text_queries import SENTENCES, _maker

    texts = [" ".join(SENTENCES), "Ein kleiner Entscheid. " * 30, *SENTENCES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    done = V.converted(docs, _maker).select("doc_id", "converted").persist()
    for wanted in ("Fahr", "ß", "e"):
        score = lambda x, wanted=wanted: [float(t.count(wanted)) for t in x]
        want = {r.doc_id: r.text for r in R.rendered(done, "doc_id", R.resolved(done, "doc_id", score)).collect()}
        assert {i: R.settled(_maker().convert(t, ""), score) for i, t in enumerate(texts)} == want


def test_nearest_cue_and_swiss_places_on_long_texts(spark):
    text = "xß ing " * 3000 + "tion" + " ing" * 3000
    row = spark.createDataFrame([(text,)], "t string").select(K.nearest(F.col("t"), F.lit("tion"), "ing").alias("n"), X.swissify_offsets("t", 100).alias("p")).first()
    assert row.n == 4
    assert row.p == [len(text[:i].replace("ß", "ss")) for i in range(0, len(text) + 1, 100)]
