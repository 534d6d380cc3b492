"""Language identification queries; the tables are built from the documents themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..operators import langid as L
from ..sources.tables import table
from .corpus_queries import SQL_SENTENCES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LISTED, CUT = L.LISTED, L.CUT


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


SQL_TABLES = f"""
freq AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents) GROUP BY 1, 2),
total AS (SELECT lang, sum(n) AS total FROM freq GROUP BY 1),
ranked AS (SELECT *, n / total AS f, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM freq JOIN total USING (lang)),
lwords AS (SELECT lang, word, n, CAST(round_even(-10 * log10(f), 0) AS INTEGER) AS cost, rank FROM ranked WHERE rank <= {LISTED}),
seen AS (SELECT lang, gram, count(*) AS n FROM (SELECT lang, substr(m, i, 3) AS gram FROM (SELECT lang, '^^' || word || '$' AS m, unnest(range(1, length(word) + 2)) AS i FROM lwords)) GROUP BY 1, 2),
alpha AS (SELECT lang, count(DISTINCT substr(gram, 3, 1)) AS alphabet FROM seen GROUP BY 1),
wide AS (SELECT s.lang, substr(gram, 1, 2) AS context, sum(n) AS in_all, any_value(alphabet) AS alphabet FROM seen s JOIN alpha USING (lang) GROUP BY 1, 2),
contexts AS (SELECT lang, context, CAST(round_even(-10 * log10(1 / (in_all + alphabet)), 0) AS INTEGER) AS cost FROM wide),
grams AS (SELECT s.lang, gram, CAST(round_even(-10 * log10((n + 1) / (in_all + alphabet)), 0) AS INTEGER) AS cost FROM seen s JOIN wide w ON s.lang = w.lang AND substr(gram, 1, 2) = context WHERE n > 1),
meta AS (SELECT l.lang, max(cost) FILTER (WHERE rank <= {CUT}) AS cut, CAST(round_even(-10 * log10(greatest(1e-6, (any_value(total) - sum(n)) / any_value(total))), 0) AS INTEGER) AS oov, CAST(round_even(10 * log10(any_value(alphabet)), 0) AS INTEGER) AS base
  FROM lwords l JOIN total USING (lang) JOIN alpha USING (lang) GROUP BY 1)"""
SQL_COSTS = SQL_TABLES + """,
asked AS (SELECT DISTINCT lower(word) AS word FROM texts_words),
crossed AS (SELECT a.word, m.*, w.cost AS own FROM asked a CROSS JOIN meta m LEFT JOIN lwords w ON w.lang = m.lang AND w.word = a.word),
spelled AS (SELECT word, lang, oov, base, substr('^^' || word || '$', i, 3) AS gram FROM (SELECT *, unnest(range(1, length(word) + 2)) AS i FROM crossed WHERE own IS NULL OR own > cut)),
wcosts AS (SELECT word, lang, own AS cost FROM crossed WHERE own <= cut UNION ALL
  SELECT word, s.lang, any_value(oov) + sum(coalesce(g.cost, c.cost, base)) FROM spelled s LEFT JOIN grams g ON g.lang = s.lang AND g.gram = s.gram LEFT JOIN contexts c ON c.lang = s.lang AND c.context = substr(s.gram, 1, 2) GROUP BY 1, 2),
tcosts AS (SELECT key, lang, CAST(sum(n * cost) AS BIGINT) AS cost, CAST(sum(n) AS BIGINT) AS words FROM (SELECT key, lower(word) AS word, count(*) AS n FROM texts_words GROUP BY 1, 2) JOIN wcosts USING (word) GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cost, CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'fr' THEN 3 WHEN 'it' THEN 4 ELSE 5 END, lang) AS place FROM tcosts),
detected AS (SELECT key, max(lang) FILTER (WHERE place = 1) AS best, max(words) AS words,
  CASE WHEN max(lang) FILTER (WHERE place = 1) = 'de' THEN -min(cost) + coalesce(max(cost) FILTER (WHERE place = 2), min(cost)) ELSE -min(cost) + max(cost) FILTER (WHERE lang = 'de') END AS margin FROM placed GROUP BY key)"""
SQL_DOC_WORDS = "texts_words AS (SELECT doc_id AS key, unnest(regexp_extract_all(text, '\\p{L}+')) AS word FROM documents)"


def _tables(spark, sf):
    return L.build(table(spark, sf, "documents"), LISTED, CUT)


@query("WITH " + SQL_TABLES + " SELECT lang, word, cost, CAST(rank AS INTEGER) AS rank FROM lwords")
def lang_word_costs(spark, sf):
    return _tables(spark, sf).words


@query("WITH " + SQL_TABLES + " SELECT * FROM grams")
def lang_trigrams(spark, sf):
    return _tables(spark, sf).grams


@query("WITH " + SQL_TABLES + " SELECT lang, context, cost FROM contexts")
def lang_contexts(spark, sf):
    return _tables(spark, sf).contexts


@query("WITH " + SQL_TABLES + " SELECT * FROM meta")
def lang_meta(spark, sf):
    return _tables(spark, sf).meta


def _detected(spark, sf):
    docs = table(spark, sf, "documents")
    return L.detect(L.text_costs(docs, "doc_id", _tables(spark, sf)), "doc_id")


@query("WITH " + SQL_DOC_WORDS + "," + SQL_COSTS + " SELECT key AS doc_id, best, CAST(margin AS BIGINT) AS margin, words FROM detected")
def lang_detect(spark, sf):
    return _detected(spark, sf)


@query("WITH " + SQL_DOC_WORDS + "," + SQL_COSTS + ", v AS (SELECT d.lang AS gold, CASE WHEN best = 'de' OR (margin >= 10 AND words > 0) THEN best ELSE 'de' END AS lang FROM detected JOIN documents d ON d.doc_id = key) SELECT gold, lang, count(*) AS n FROM v GROUP BY 1, 2")
def lang_confusion(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("gold"))
    return L.verdict(_detected(spark, sf)).join(docs, "doc_id").groupBy("gold", "lang").agg(F.count("*").alias("n"))


@query("WITH " + SQL_SENTENCES + """, keyed AS (SELECT doc_id || ':' || ix AS key, lang AS gold, sentence FROM sentences),
texts_words AS (SELECT key, unnest(regexp_extract_all(sentence, '\\p{L}+')) AS word FROM keyed),""" + SQL_COSTS + """,
r AS (SELECT gold, CASE WHEN words <= 3 THEN '1-3' WHEN words <= 8 THEN '4-8' ELSE '9+' END AS bucket, best <> gold AS wrong FROM detected JOIN keyed USING (key))
SELECT gold, coalesce(bucket, 'all') AS bucket, count(*) AS n, count(*) FILTER (WHERE wrong) AS wrong FROM r GROUP BY GROUPING SETS ((gold, bucket), (gold))""")
def lang_error_rollup(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("gold"), F.posexplode(X.sentences("text")).alias("ix", "sentence"))
    rows = rows.select(F.concat_ws(":", "gold", "doc_id", "ix").alias("key"), "sentence")  # the key carries the truth along
    found = L.detect(L.text_costs(rows, "key", _tables(spark, sf), "sentence"), "key").withColumn("gold", F.substring_index("key", ":", 1))
    found = found.withColumn("bucket", C.length_bucket(F.col("words")))
    counted = found.groupingSets([["gold", "bucket"], ["gold"]], "gold", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("best") != F.col("gold")).alias("wrong"))
    return counted.withColumn("bucket", F.coalesce("bucket", F.lit("all")))


@query("WITH " + SQL_DOC_WORDS + "," + SQL_COSTS + """, base AS (SELECT key, cost AS own FROM tcosts WHERE lang = 'de') SELECT key AS doc_id, lang, CAST(greatest(-30, least(30, own - cost)) AS BIGINT) AS odds FROM tcosts JOIN base USING (key) WHERE words >= 3""")
def lang_prior(spark, sf):
    docs = table(spark, sf, "documents")
    return L.prior_of(L.text_costs(docs, "doc_id", _tables(spark, sf)), "doc_id").withColumn("odds", F.col("odds").cast("long"))


@query("WITH " + SQL_TABLES + """, e AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM conversations)
SELECT conv_id, turn, count(*) AS words, count(*) FILTER (WHERE word IN (SELECT word FROM lwords WHERE lang = 'de')) AS listed FROM e GROUP BY 1, 2""")
def lang_listed_share(spark, sf):
    german = _tables(spark, sf).words.filter("lang = 'de'").select("word", F.lit(1).alias("hit"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.letter_words(F.lower("text"))).alias("word"))
    return rows.join(german, "word", "left").groupBy("conv_id", "turn").agg(F.count("*").alias("words"), F.count("hit").alias("listed"))


@query("WITH texts_words AS (SELECT word AS key, word FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM conversations))," + SQL_COSTS + " SELECT key AS word, best, CAST(margin AS BIGINT) AS margin FROM detected")
def word_verdicts(spark, sf):
    words = table(spark, sf, "conversations").select(F.explode(X.letter_words("text")).alias("word"))
    return L.word_verdicts(words, _tables(spark, sf)).withColumn("margin", F.col("margin").cast("long"))


@query("WITH texts_words AS (SELECT word AS key, word FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM conversations))," + SQL_COSTS + """,
lists AS (SELECT conv_id || ':' || turn AS doc, regexp_extract_all(text, '\\p{L}+|[^\\p{L}]+') AS p FROM conversations),
toks AS (SELECT doc, p, unnest(p) AS s, unnest(range(0, len(p))) AS ix FROM lists),
gapped AS (SELECT *, lag(s) OVER (PARTITION BY doc ORDER BY ix) AS gap FROM toks),
kinds AS (SELECT g.*, margin, CASE WHEN best <> 'de' THEN best END AS kind FROM gapped g JOIN detected d ON d.key = lower(s) WHERE regexp_matches(s, '^\\p{L}')),
joined AS (SELECT *, coalesce(kind = lag(kind) OVER w AND NOT coalesce(regexp_matches(gap, '[^ \t''’-]'), FALSE), FALSE) AS same FROM kinds WINDOW w AS (PARTITION BY doc ORDER BY ix)),
islands AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY ix) AS island FROM joined),
found AS (SELECT doc, any_value(p) AS p, min(ix) AS first, max(ix) AS last, any_value(kind) AS lang FROM islands WHERE kind IS NOT NULL GROUP BY doc, island HAVING count(*) >= 2 AND sum(margin) >= 20)
SELECT doc AS key, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, lang, array_to_string(p[first + 1:last + 1], '') AS words FROM found""")
def foreign_runs(spark, sf):
    rows = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    return L.foreign_runs(rows, "key", _tables(spark, sf))
