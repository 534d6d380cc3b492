"""Queries on sources and sinks: what is written is read again and held against the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import tables as T
from ..sources.tables import table, work_folder
from .corpus_queries import SQL_SENTENCES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("SELECT doc_id, md5(text) AS text_md5, lang, source FROM documents")
def json_round_trip(spark, sf):
    path = work_folder(spark, "json")
    T.write_json(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path)
    back = T.json_lines(spark, path, "doc_id long, text string, lang string, source string")
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source")


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.' || k) AS VARCHAR) AS value, k AS name FROM events, (SELECT DISTINCT unnest(json_keys(props)) AS k FROM events) WHERE json_extract_string(props, '$.' || k) IS NOT NULL")
def json_properties(spark, sf):
    """Each property of the events' JSON as a row."""
    rows = table(spark, sf, "events").select("event_id", "event_type", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
    return rows.filter("value IS NOT NULL")


@query("WITH " + SQL_SENTENCES + " SELECT sentence, count(*) AS n FROM sentences GROUP BY 1")
def conllu_round_trip(spark, sf):
    """The documents' sentences as comment lines of treebank files."""
    path = work_folder(spark, "conllu")
    sentences = table(spark, sf, "documents").select(F.explode(X.sentences("text")).alias("s"))
    sentences.select(F.concat(F.lit("# text = "), "s", F.lit("\n1\t_\t_\n")).alias("value")).write.text(path)
    return T.conllu_sentences(spark, path).groupBy("sentence").agg(F.count("*").alias("n"))


@query("WITH " + SQL_SENTENCES + ", named AS (SELECT DISTINCT sentence, CASE WHEN length(sentence) % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM sentences) SELECT split, sentence FROM named")
def split_sink(spark, sf):
    """One folder per split, each sentence once; a second writer of the same key changes nothing."""
    rows = table(spark, sf, "documents").select(F.explode(X.sentences("text")).alias("sentence")).withColumn("split", F.when(F.length("sentence") % 5 == 0, "test").otherwise("train"))
    path = work_folder(spark, "splits")
    T.write_splits(rows, path)
    target = T.write_once(spark.read.parquet(path), f"{path}-once", "key")
    T.write_once(rows.limit(0).select("sentence", "split"), f"{path}-once", "key")
    return spark.read.parquet(target).select("split", "sentence")


@query("SELECT p_partkey AS key, p_name AS word, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS place FROM part WHERE p_size % 7 <> 0")
def issue_forms(spark, sf):
    part = table(spark, sf, "part")
    body = F.concat(F.lit("### Word\n\n"), F.when(F.col("p_size") % 7 == 0, "_No response_").otherwise(F.col("p_name")), F.lit("\n\n### Seen at\n\n"), F.when(F.col("p_size") % 3 == 0, "_No response_").otherwise(F.col("p_type")), F.lit("\n"))
    return T.issue_forms(part.select(F.col("p_partkey").alias("key"), body.alias("body")), {"Word": "word", "Seen at": "place"}, needed="word").drop("body")


@query("WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '\\p{L}+') AS ws FROM conversations) SELECT conv_id, turn, CAST(i AS INTEGER) AS ix, ws[i + 1] AS token, length(ws[i + 1]) % 4 AS tag FROM (SELECT *, unnest(range(0, len(ws))) AS i FROM w)")
def tagged_words(spark, sf):
    words = table(spark, sf, "conversations").select("conv_id", "turn", X.letter_words("text").alias("tokens"))
    tagged = words.withColumn("ner_tags", F.transform("tokens", lambda w: (F.length(w) % 4).cast("long")))
    return T.tagged_tokens(tagged)


@query("SELECT doc_id, round(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text), 9) AS score FROM documents WHERE length(text) > 0 AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text) >= 0.8")
def confident_rows(spark, sf):
    """Rows that a score lets pass; here the share of letters."""
    docs = table(spark, sf, "documents").filter(F.length("text") > 0).select("doc_id", (X.letters("text") / F.length("text")).alias("score"))
    return T.confident(docs, "score", 0.8).select("doc_id", F.round("score", 9).alias("score"))


@query("WITH " + SQL_SENTENCES + ", named AS (SELECT *, lang AS split, row_number() OVER (PARTITION BY lang ORDER BY doc_id, ix) AS r FROM sentences) SELECT split, doc_id, CAST(ix AS INTEGER) AS ix, sentence FROM named WHERE r <= 50")
def first_of_split(spark, sf):
    """An early stop per split: the first 50 sentences of each, by document and place."""
    rows = table(spark, sf, "documents").select(F.col("lang").alias("split"), "doc_id", F.posexplode(X.sentences("text")).alias("ix", "sentence"))
    return T.first_per_split(rows, "split", ["doc_id", "ix"], 50)


@query("SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS found, round(count(*) FILTER (WHERE quality = 1 AND toxic = 0 AND length(text) % 2 = n_chars % 2) / greatest(count(*) FILTER (WHERE quality = 1 AND toxic = 0), 1), 9) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def type_accuracy(spark, sf):
    from ..operators import corpus as C

    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    found = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return rows.groupBy("lang").agg(F.count_if(found).alias("found"), C.type_accuracy(F.length("text") % 2, F.col("n_chars") % 2, found).alias("accuracy"))
