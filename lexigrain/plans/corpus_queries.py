"""Queries on tokens, filters and corpus statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..sources.tables import dealt, page_texts, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Fixed values, in the dialect of DuckDB: sentences, and words of letters, of the documents.
SQL_SENTENCES = """
broken AS (SELECT *, string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+([A-ZÄÖÜ"„])', '\\1' || chr(1) || '\\2', 'g'), '\\n+', chr(1), 'g'), chr(1)) AS parts FROM documents),
numbered AS (SELECT doc_id, lang, source, unnest(parts) AS sentence, unnest(range(0, len(parts))) AS n FROM broken),
sentences AS (SELECT doc_id, lang, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS ix, sentence FROM numbered WHERE trim(sentence) <> '')"""
SQL_WORDS = "words AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '\\p{L}+')) AS word FROM documents)"
SQL_COUNTS = SQL_WORDS + """,
counts AS (SELECT lower(word) AS form, count(*) FILTER (WHERE word <> lower(word)) AS n_plain, count(*) FILTER (WHERE word = lower(word)) AS n_variant FROM words GROUP BY 1)"""
SQL_SETTLED = SQL_COUNTS + """,
settled AS (SELECT *, n_variant > n_plain AS is_variant FROM counts WHERE greatest(n_plain, n_variant) >= 30 AND least(n_plain, n_variant) <= 0.03 * (n_plain + n_variant))"""
SQL_BUCKET = """
horner AS (SELECT *, md5(key) AS d FROM keys),
bucketed AS (SELECT *, (((((CAST('0x' || substr(d, 1, 8) AS BIGINT) % 100) * 96 + CAST('0x' || substr(d, 9, 8) AS BIGINT)) % 100) * 96 + CAST('0x' || substr(d, 17, 8) AS BIGINT)) % 100 * 96 + CAST('0x' || substr(d, 25, 8) AS BIGINT)) % 100 AS bucket FROM horner)"""
SQL_HOST = "coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '')"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.variant_counts(C.words_of(_docs(spark, sf)), C.CASE)


# ---- tokens


@query("WITH " + SQL_SENTENCES + " SELECT doc_id, ix, sentence FROM sentences")
def sentence_split(spark, sf):
    return C.sentences(_docs(spark, sf))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\\p{L}+|[^\\p{L}]+') AS parts, text FROM documents),
e AS (SELECT doc_id, unnest(parts) AS s, unnest(range(0, len(parts))) AS ix FROM t),
o AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e)
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE regexp_matches(s, '^\\p{L}')) AS n_words, CAST(sum(start * (ix + 1)) AS BIGINT) AS place_sum, md5(string_agg(s, '' ORDER BY ix)) AS joined FROM o GROUP BY doc_id""")
def token_offsets(spark, sf):
    docs = _docs(spark, sf).filter(F.length("text") > 0).select("doc_id", "text", X.tokens("text").alias("t"))

    def step(seen, s):
        return F.struct((seen["start"] + F.length(s)).alias("start"), (seen["nr"] + 1).alias("nr"), (seen["total"] + seen["start"] * seen["nr"]).alias("total"))

    first = F.struct(F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("nr"), F.lit(0).cast("long").alias("total"))
    walked = docs.select("doc_id", F.regexp_count("text", F.lit(r"\p{L}+")).cast("long").alias("n_words"), F.aggregate("t", first, step).alias("x"), F.md5(F.array_join("t", "")).alias("joined"))
    return walked.select("doc_id", (F.col("x.nr") - 1).alias("n_tokens"), "n_words", F.col("x.total").alias("place_sum"), "joined")


@query("""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{L}+|\\d+(?:[''’.,]\\d+)*|\\s+|(?s:.)')) AS s FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(s, '^\\p{L}') THEN 'letters' WHEN regexp_matches(s, '^\\d') THEN 'number' WHEN regexp_matches(s, '^\\s') THEN 'space' ELSE 'other' END AS kind, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM e GROUP BY 1, 2""")
def diff_token_kinds(spark, sf):
    s = F.col("s")
    kind = F.when(s.rlike(r"^\p{L}"), "letters").when(s.rlike(r"^\d"), "number").when(s.rlike(r"^\s"), "space").otherwise("other")
    return _docs(spark, sf).select("doc_id", F.explode(X.diff_tokens("text")).alias("s")).groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("n_chars"))


@query("""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+')) AS word FROM documents)
SELECT doc_id, word, count(*) AS n FROM e WHERE contains(word, 'ss') OR contains(word, 'ß') GROUP BY 1, 2""")
def ss_words(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(X.ss_words("text")).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+')) AS word FROM documents),
p AS (SELECT word, string_split(word, 'ss') AS parts FROM e WHERE contains(word, 'ss'))
SELECT word, list_transform(range(1, len(parts)), lambda i: CAST(length(array_to_string(parts[1:i], 'ss')) AS INTEGER)) AS places FROM p""")
def ss_pair_places(spark, sf):
    words = _docs(spark, sf).select(F.explode(X.ss_words("text")).alias("word")).distinct().filter(F.col("word").contains("ss"))
    return words.select("word", X.ss_pairs("word").alias("places"))


@query("""SELECT doc_id, replace(text, 'ß', 'ss') AS swiss, length(text) - length(replace(text, 'ß', '')) AS n_eszett,
list_transform(range(0, length(text) + 1, 100), lambda i: CAST(length(replace(substr(text, 1, i), 'ß', 'ss')) AS INTEGER)) AS places FROM documents""")
def swissified(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", X.swissify(t).alias("swiss"), (F.length(t) - F.length(F.replace(t, F.lit("ß"), F.lit("")))).cast("long").alias("n_eszett"), X.swissify_offsets(t, 100).alias("places"))


@query("WITH " + SQL_WORDS + """, forms AS (SELECT DISTINCT word FROM words WHERE NOT contains(word, 'ß'))
SELECT word, CASE WHEN length(word) > 1 AND word = upper(word) AND word <> lower(word) THEN 'ABENDROT' WHEN left(word, 1) <> lower(left(word, 1)) THEN 'Abendrot' ELSE 'abendrot' END AS cased FROM forms""")
def case_transfer(spark, sf):
    words = C.words_of(_docs(spark, sf)).distinct().filter(~F.col("word").contains("ß"))
    return words.select("word", X.match_case("word", F.lit("abendrot")).alias("cased"))


@query("""WITH t AS (SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '\\p{L}+|[^\\p{L}\\s]'), ' ') AS spaced FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(spaced, ' ([.,;:!?)\\]}»“])', '\\1', 'g'), '([(\\[{«„]) ', '\\1', 'g') AS text FROM t""")
def detokenised(spark, sf):
    words = F.regexp_extract_all("text", F.lit(r"(\p{L}+|[^\p{L}\s])"), F.lit(1))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.detokenise(words).alias("text"))


@query("WITH " + SQL_SENTENCES + """,
threes AS (SELECT doc_id, ix // 3 AS nr, sentence, ix FROM sentences)
SELECT doc_id, CAST(nr AS BIGINT) AS nr, string_agg(sentence, ' ' ORDER BY ix) AS passage FROM threes GROUP BY 1, 2 HAVING count(*) = 3 AND length(string_agg(sentence, ' ')) <= 1000""")
def passages3(spark, sf):
    rows = C.sentences(_docs(spark, sf)).withColumn("nr", F.floor(F.col("ix") / 3))
    made = rows.groupBy("doc_id", "nr").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ix", "sentence"))), lambda x: x["sentence"]), " ").alias("passage"), F.count("*").alias("n"))
    return made.filter((F.col("n") == 3) & (F.length("passage") <= 1000)).select("doc_id", "nr", "passage")


@query()
def model_chunks(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(X.model_chunks("text")).alias("ix", "chunk"))


@query("""WITH p AS (SELECT doc_id, text, string_split(text, 'ss') AS parts FROM documents WHERE contains(text, 'ss')),
q AS (SELECT doc_id, text, CAST(length(array_to_string(parts[1:i], 'ss')) AS INTEGER) AS place FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM p))
SELECT doc_id, place, substr(text, greatest(0, place - 30) + 1, place + 32 - greatest(0, place - 30)) AS around FROM q""")
def context_windows(spark, sf):
    hit = _docs(spark, sf).select("doc_id", "text", F.explode(X.ss_pairs("text")).alias("place"))
    return hit.select("doc_id", "place", X.around("text", F.col("place"), F.col("place") + 2, 30).alias("around"))


SQL_TYPED = """w AS (SELECT p_partkey AS key, p_name || ' ' || a || l || substr(p_type, 2) || ' ' || a || ' x^e `a`' AS typed FROM part,
  (SELECT unnest(['´', '¨', 'ˆ', '˜', '¸', '˚', 'ˇ', '˘', '˙', '˝', '¯', '˛']) AS a), (SELECT unnest(['a', 'E', 'c', 'n', 'u', 'ß', 'z', 'O']) AS l))"""


@query("WITH " + SQL_TYPED + """, m AS (SELECT key, typed, unnest(regexp_extract_all(typed, '[´¨ˆ˜¸˚ˇ˘˙˝¯˛]\\p{L}|[^´¨ˆ˜¸˚ˇ˘˙˝¯˛]+|[´¨ˆ˜¸˚ˇ˘˙˝¯˛]')) AS s, unnest(range(0, len(regexp_extract_all(typed, '[´¨ˆ˜¸˚ˇ˘˙˝¯˛]\\p{L}|[^´¨ˆ˜¸˚ˇ˘˙˝¯˛]+|[´¨ˆ˜¸˚ˇ˘˙˝¯˛]')))) AS i FROM w),
n AS (SELECT *, nfc_normalize(substr(s, 2, 1) || translate(left(s, 1), '´¨ˆ˜¸˚ˇ˘˙˝¯˛', '\u0301\u0308\u0302\u0303\u0327\u030a\u030c\u0306\u0307\u030b\u0304\u0328')) AS c FROM m)
SELECT key, typed, string_agg(CASE WHEN length(s) = 2 AND left(s, 1) IN ('´', '¨', 'ˆ', '˜', '¸', '˚', 'ˇ', '˘', '˙', '˝', '¯', '˛') AND length(c) = 1 THEN c ELSE s END, '' ORDER BY i) AS composed FROM n GROUP BY 1, 2""")
def accents_composed(spark, sf):
    accents, letters = (F.explode(F.array(*map(F.lit, x))) for x in ("´¨ˆ˜¸˚ˇ˘˙˝¯˛", "aEcnußzO"))
    part = dealt(table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_name", "p_type"), "key")  # 96 rows each
    part = part.select("*", accents.alias("a")).select("*", letters.alias("l"))
    typed = F.concat("p_name", F.lit(" "), "a", "l", F.substring("p_type", 2, 1000), F.lit(" "), "a", F.lit(" x^e `a`"))
    return part.select("key", typed.alias("typed")).select("key", "typed", X.compose_accents("typed").alias("composed"))


@query("SELECT doc_id, md5(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))) AS text_md5 FROM documents")
def nfc_texts(spark, sf):
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    return _docs(spark, sf).select("doc_id", F.md5(X.normalised(apart)).alias("text_md5"))


SQL_PRICES = """p AS (SELECT p_partkey AS key, CAST(floor(p_retailprice) AS BIGINT) AS francs, lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS cents, p_size FROM part)"""


@query("WITH " + SQL_PRICES + """ SELECT key, 'Teil ' || key || ': CHF ' || CASE WHEN francs >= 1000 THEN (francs // 1000) || '.' || lpad(CAST(francs % 1000 AS VARCHAR), 3, '0') ELSE CAST(francs AS VARCHAR) END || ',' || cents || ' oder ' || p_size || ',– Franken, Fassung 1.2.3, Lager 1.' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ' von 12''34 zu 12.50 m' AS german FROM p""")
def numbers_and_prices(spark, sf):
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    francs, rest = F.floor(F.col("p_retailprice")), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = F.when(francs >= 1000, F.concat(F.floor(francs / 1000).cast("string"), F.lit("'"), F.lpad((francs % 1000).cast("string"), 3, "0"))).otherwise(francs.cast("string"))
    swiss = F.concat(F.lit("Teil "), F.col("p_partkey").cast("string"), F.lit(": CHF "), grouped, F.lit("."), rest, F.lit(" oder "), F.col("p_size").cast("string"), F.lit(".– Franken, Fassung 1.2.3, Lager 1'"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" von 12'34 zu 12.50 m"))
    return dealt(table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size"), "p_partkey").select(F.col("p_partkey").alias("key"), X.prices(X.thousands(swiss)).alias("german"))


# ---- filters


@query("WITH " + SQL_SENTENCES + """ SELECT doc_id, ix, sentence FROM sentences WHERE length(sentence) BETWEEN 25 AND 300 AND (contains(sentence, 'ss') OR contains(sentence, 'ß')) AND NOT contains(sentence, 'ẞ')
AND replace(upper(replace(sentence, 'ß', 'ss')), 'ẞ', 'SS') <> sentence AND len(regexp_extract_all(sentence, '\\S+')) >= 4 AND 10 * length(regexp_replace(sentence, '[^\\p{L}]', '', 'g')) >= 7 * length(regexp_replace(sentence, '\\s', '', 'g'))""")
def usable_sentences(spark, sf):
    return C.sentences(_docs(spark, sf)).filter(C.usable_sentence("sentence"))


@query("WITH " + SQL_SENTENCES + """ SELECT doc_id, ix, sentence FROM sentences WHERE length(sentence) BETWEEN 25 AND 300 AND (contains(sentence, 'ss') OR contains(sentence, 'ß')) AND NOT contains(sentence, 'ẞ') AND upper(replace(sentence, 'ß', 'ss')) <> sentence""")
def plain_sentences(spark, sf):
    return C.sentences(_docs(spark, sf)).filter(C.plain_sentence("sentence"))


@query("SELECT page_id, " + SQL_HOST + " AS host, " + SQL_HOST.join(["", " LIKE '%.org'"]) + " AS dropped FROM pages")
def site_drop(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.host("url").alias("host"), C.site_of("url", [".org"], ["de-ch", "de_ch"]).alias("dropped"))


@query("""WITH c AS (SELECT doc_id, text, len(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: w IN ('der', 'die', 'und', 'the', 'and'))) AS n FROM documents)
SELECT doc_id FROM c WHERE NOT contains(text, 'ß') AND n >= 2""")
def other_spelling_docs(spark, sf):
    return _docs(spark, sf).filter(C.other_spelling("text", ["der", "die", "und", "the", "and"])).select("doc_id")


@query("WITH " + SQL_SENTENCES + """ SELECT doc_id, ix, sentence FROM sentences WHERE length(sentence) BETWEEN 30 AND 260 AND len(regexp_extract_all(sentence, '\\S+')) >= 5 AND NOT contains(sentence, 'ß') AND source = 'src1'""")
def example_sentences(spark, sf):
    rows = _docs(spark, sf).select("doc_id", "source", F.posexplode(X.sentences("text")).alias("ix", "sentence"))
    return rows.filter(C.example_sentence("sentence", F.col("source") == "src1")).select("doc_id", "ix", "sentence")


@query("WITH " + SQL_SENTENCES + """ SELECT doc_id, ix, replace(sentence, 'und', '&') AS rewritten FROM sentences WHERE length(sentence) BETWEEN 30 AND 260 AND len(regexp_extract_all(sentence, '\\S+')) >= 5 AND NOT contains(sentence, 'ẞ') AND contains(sentence, 'und')
AND regexp_matches(sentence, 'ing|keit') AND NOT regexp_matches(sentence, 'tion')""")
def changing_sentences(spark, sf):
    new = F.replace("sentence", F.lit("und"), F.lit("&"))
    rows = C.sentences(_docs(spark, sf)).filter(C.changing_sentence("sentence", new) & C.topic("sentence", "ing|keit", "tion"))
    return rows.select("doc_id", "ix", new.alias("rewritten"))


_META = {"strong": "(?i)license|copyright", "clear": "(?i)reserved|permission", "weak": "(?i)ing tion|the and"}


@query("""WITH m AS (SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '(?i)license|copyright'), lambda x: lower(x)))) AS s, len(list_distinct(list_transform(regexp_extract_all(text, '(?i)reserved|permission'), lambda x: lower(x)))) AS c,
len(list_distinct(list_transform(regexp_extract_all(text, '(?i)ing tion|the and'), lambda x: lower(x)))) AS w FROM documents)
SELECT doc_id, s + c >= 1 AS sentence, s >= 1 OR c >= 2 OR (c >= 1 AND w >= 1) AS block, c >= 3 OR (s >= 1 AND s + c + w >= 2) AS page FROM m""")
def meta_levels(spark, sf):
    return _docs(spark, sf).select("doc_id", C.meta_level("text", **_META).alias("m")).select("doc_id", "m.*")


# ---- statistics


@query("WITH " + SQL_COUNTS + " SELECT * FROM counts")
def form_variant_counts(spark, sf):
    return _counts(spark, sf)


@query("WITH " + SQL_SETTLED + " SELECT * FROM settled")
def settled_forms(spark, sf):
    return C.settled(_counts(spark, sf))


@query("WITH " + SQL_COUNTS + ", asked AS (SELECT DISTINCT lower(word) AS form FROM words WHERE length(word) = 5) SELECT counts.* FROM counts SEMI JOIN asked USING (form)")
def coverage_forms(spark, sf):
    asked = C.words_of(_docs(spark, sf)).filter(F.length("word") == 5).select(F.lower("word").alias("form")).distinct()
    return _counts(spark, sf).join(asked, "form", "left_semi")


@query("WITH " + SQL_COUNTS + " SELECT * FROM counts WHERE least(n_plain, n_variant) >= greatest(10, 0.03 * (n_plain + n_variant))")
def ambiguous_forms(spark, sf):
    return C.ambiguous(_counts(spark, sf))


@query("WITH " + SQL_COUNTS + " SELECT * FROM counts WHERE n_plain >= 3 AND n_variant >= 3")
def collision_forms(spark, sf):
    return C.collisions(_counts(spark, sf))


SQL_FACTORS = SQL_COUNTS + """,
factors AS (SELECT form, n_variant < n_plain AS rare_variant, CAST(least(8, round_even(greatest(n_plain, n_variant) / least(n_plain, n_variant), 0)) AS INTEGER) AS factor FROM counts WHERE least(n_plain, n_variant) >= 10 AND n_plain <> n_variant)"""


@query("WITH " + SQL_FACTORS + " SELECT * FROM factors WHERE factor > 1")
def repeat_factors(spark, sf):
    return C.repeat_factors(_counts(spark, sf))


@query("WITH " + SQL_FACTORS + """, own AS (SELECT DISTINCT doc_id, lower(word) AS form, word = lower(word) AS rare_variant FROM words),
best AS (SELECT doc_id, max(factor) AS factor FROM own JOIN factors USING (form, rare_variant) WHERE factor > 1 GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(factor, 1) AS factor FROM documents LEFT JOIN best USING (doc_id))
SELECT doc_id, factor, CAST(unnest(range(1, factor + 1)) AS INTEGER) AS copy FROM f""")
def row_repeat(spark, sf):
    docs = _docs(spark, sf)
    out = C.row_repeats(docs.select("doc_id"), "doc_id", C.words_of(docs, "doc_id"), C.CASE, C.repeat_factors(_counts(spark, sf)))
    return C.repeated(out)


SQL_AGAINST = SQL_SETTLED + """,
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\\p{L}+') AS ws FROM documents)),
hits AS (SELECT doc_id, pos, word, is_variant FROM placed JOIN settled ON lower(word) = form WHERE (word = lower(word)) <> is_variant),
against AS (SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, arg_min(word, pos) AS word, arg_min(is_variant, pos) AS is_variant FROM hits GROUP BY doc_id)"""


@query("WITH " + SQL_AGAINST + " SELECT * FROM against")
def docs_against_settled(spark, sf):
    return C.against(_docs(spark, sf), C.CASE, C.settled(_counts(spark, sf)))


@query("WITH " + SQL_AGAINST + " SELECT doc_id FROM documents ANTI JOIN against USING (doc_id)")
def docs_clean(spark, sf):
    docs = _docs(spark, sf)
    return docs.select("doc_id").join(C.against(docs, C.CASE, C.settled(_counts(spark, sf))), "doc_id", "left_anti")


@query("WITH " + SQL_AGAINST + """, reasons AS (SELECT CASE WHEN d.source IN ('src3', 'src7') THEN 'site' WHEN d.lang = 'es' THEN 'language' WHEN a.is_variant THEN 'against_variant' WHEN NOT a.is_variant THEN 'against_plain' ELSE 'kept' END AS reason, d.doc_id, d.text
FROM documents d LEFT JOIN against a USING (doc_id)) SELECT reason, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM reasons GROUP BY reason""")
def filter_cascade(spark, sf):
    """The flagship: documents by the first reason to drop them, spelling against settled forms included."""
    docs = _docs(spark, sf)
    hits = C.against(docs, C.CASE, C.settled(_counts(spark, sf)))
    v = F.col("is_variant")
    reason = C.cascade([("site", F.col("source").isin("src3", "src7")), ("language", F.col("lang") == "es"), ("against_variant", v), ("against_plain", ~v)])
    return docs.join(hits.select("doc_id", "is_variant"), "doc_id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query("WITH " + SQL_SENTENCES + " SELECT sentence, min(doc_id) AS doc_id, CAST(arg_min(ix, (doc_id, ix)) AS INTEGER) AS ix FROM sentences GROUP BY sentence")
def dedup_sentences(spark, sf):
    return C.distinct_sentences(C.sentences(_docs(spark, sf)), ["doc_id", "ix"])


@query("WITH " + SQL_SENTENCES + " SELECT lang, sentence, min(doc_id) AS doc_id FROM sentences GROUP BY 1, 2")
def dedup_in_split(spark, sf):
    rows = _docs(spark, sf).select("doc_id", "lang", F.explode(X.sentences("text")).alias("sentence"))
    return C.distinct_sentences(rows, ["doc_id"], ["lang"])


SQL_SPLITS = "keys AS (SELECT page_id, " + SQL_HOST + " AS host, " + SQL_HOST + " AS key FROM pages)," + SQL_BUCKET


@query("WITH " + SQL_SPLITS + " SELECT page_id, host, CAST(bucket AS INTEGER) AS bucket, CASE WHEN bucket < 10 THEN 'test' WHEN bucket < 20 THEN 'val' ELSE 'train' END AS split FROM bucketed")
def hash_split(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", X.host("url").alias("host"))
    return pages.select("page_id", "host", X.bucket100("host").alias("bucket"), X.split_name("host", 10, 20).alias("split"))


@query("WITH " + SQL_SPLITS + ", s AS (SELECT host, CASE WHEN bucket < 10 THEN 'test' WHEN bucket < 20 THEN 'val' ELSE 'train' END AS split FROM bucketed) SELECT split, count(DISTINCT host) AS hosts, count(*) AS pages FROM s GROUP BY split")
def split_disjoint(spark, sf):
    return hash_split(spark, sf).groupBy("split").agg(F.countDistinct("host").alias("hosts"), F.count("*").alias("pages"))


@query("SELECT " + SQL_HOST + " AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(spark, sf):
    return table(spark, sf, "pages").groupBy(X.host("url").alias("host")).agg(F.count("*").alias("n"))


SQL_SIDES = SQL_SENTENCES + """,
sided AS (SELECT *, CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS side FROM sentences),
listed AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents) WHERE length(w) BETWEEN 2 AND 4),
hitting AS (SELECT side, doc_id, ix, unnest(regexp_extract_all(sentence, '\\p{L}+')) AS word, generate_subscripts(regexp_extract_all(sentence, '\\p{L}+'), 1) AS pos FROM sided),
first_hit AS (SELECT side, doc_id, ix, arg_min(word, pos) AS word FROM hitting SEMI JOIN listed USING (word) GROUP BY 1, 2, 3),
side_counts AS (SELECT side, word, count(*) AS n FROM first_hit GROUP BY 1, 2),
pages_of AS (SELECT count(*) FILTER (WHERE lang = 'en') AS pa, count(*) FILTER (WHERE lang <> 'en') AS pb FROM documents),
rated AS (SELECT word, CAST(coalesce(sum(n) FILTER (WHERE side = 'a'), 0) AS BIGINT) AS n_a, CAST(coalesce(sum(n) FILTER (WHERE side = 'b'), 0) AS BIGINT) AS n_b FROM side_counts GROUP BY word),
final AS (SELECT word, n_a, n_b, n_a / greatest(1, pa)::DOUBLE AS rate_a, n_b / greatest(1, pb)::DOUBLE AS rate_b FROM rated, pages_of)"""


def _rated(spark, sf):
    docs = _docs(spark, sf).withColumn("side", F.when(F.col("lang") == "en", "a").otherwise("b"))
    rows = docs.select("side", "doc_id", F.posexplode(X.sentences("text")).alias("ix", "sentence")).withColumn("key", F.struct("doc_id", "ix"))
    listed = C.words_of(docs).filter(F.length("word").between(2, 4))
    return C.rates(C.occurrences(rows, listed), docs.groupBy("side").agg(F.count("*").alias("n")), ("a", "b"))


@query("WITH " + SQL_SIDES + " SELECT * FROM side_counts")
def side_word_counts(spark, sf):
    docs = _docs(spark, sf).withColumn("side", F.when(F.col("lang") == "en", "a").otherwise("b"))
    rows = docs.select("side", F.struct("doc_id", F.lit(0)).alias("k"), "doc_id", F.posexplode(X.sentences("text")).alias("ix", "sentence")).withColumn("key", F.struct("doc_id", "ix"))
    return C.occurrences(rows, C.words_of(docs).filter(F.length("word").between(2, 4)))


@query("WITH " + SQL_SIDES + " SELECT word, n_a, n_b, round(rate_a, 9) AS rate_a, round(rate_b, 9) AS rate_b FROM final")
def side_rates(spark, sf):
    return _rated(spark, sf).withColumns({c: F.round(c, 9) for c in ("rate_a", "rate_b")})


@query("WITH " + SQL_SIDES + " SELECT word, n_a, n_b FROM final WHERE n_a >= 20 AND rate_b < 5 * rate_a AND left(word, 1) <> lower(left(word, 1))")
def also_common(spark, sf):
    return C.also_common(_rated(spark, sf)).select("word", "n_a", "n_b")


@query("WITH " + SQL_SIDES + " SELECT word, n_a, n_b FROM final WHERE rate_b >= 5 * greatest(rate_a, 1e-9)")
def one_sided_words(spark, sf):
    return C.one_sided(_rated(spark, sf)).select("word", "n_a", "n_b")


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('s:' || doc_id), doc_id) AS rank FROM documents) SELECT source, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def sample_per_key(spark, sf):
    return C.sample_per_key(_docs(spark, sf).select("source", "doc_id"), "source", ["doc_id"], 5)


@query("SELECT doc_id FROM documents ORDER BY md5('s' || doc_id), doc_id LIMIT 50")
def sample_rows(spark, sf):
    from ..sources.tables import sampled

    return sampled(_docs(spark, sf).select("doc_id"), "doc_id", 50)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('s' || doc_id), doc_id) - 1 AS n FROM documents")
def shuffled_rows(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.md5(F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("h"))
    return C.numbered(rows, ["h", "doc_id"]).select("doc_id", "n")


@query("""WITH o AS (SELECT turn, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM conversations), total AS (SELECT count(*) AS c FROM o),
p AS (SELECT item_id, unnest(range(0, 3)) AS pick FROM benchmark),
d AS (SELECT item_id, pick, CAST('0x' || substr(md5('s:' || item_id || ':' || pick), 1, 12) AS BIGINT) % c AS n FROM p, total)
SELECT item_id, CAST(pick AS INTEGER) AS pick, o.text AS other FROM d JOIN o USING (n)""")
def mixed_in(spark, sf):
    others = C.numbered(table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("other")), ["conv_id", "turn"]).select("n", "other")
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("key"))
    return C.mix_in(rows, others, 3).select(F.col("key").alias("item_id"), "pick", "other")


# ---- evaluation


@query("""WITH j AS (SELECT lang, quality, CASE WHEN length(text) > 1500 THEN 1 ELSE 0 END AS guess, toxic FROM documents JOIN labels USING (doc_id))
SELECT lang, round(1000.0 * count(*) FILTER (WHERE quality <> guess) / count(*), 6) AS per_1000, round(1000.0 * count(*) FILTER (WHERE quality <> guess AND toxic = 1) / greatest(count(*) FILTER (WHERE toxic = 1), 1), 6) AS per_1000_subset FROM j GROUP BY lang""")
def errors_per_1000(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    guess = F.when(F.length("text") > 1500, 1).otherwise(0)
    return rows.groupBy("lang").agg(*C.errors_per_1000(rows, F.col("quality") != guess, F.col("toxic") == 1))


@query("""WITH j AS (SELECT lang, quality = 1 AS t, length(text) > 1500 AS g FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND g) AS fp, count(*) FILTER (WHERE t AND NOT g) AS fn FROM j GROUP BY lang),
p AS (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS p, tp / greatest(tp + fn, 1)::DOUBLE AS r FROM c)
SELECT lang, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM p""")
def prf_by_label(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return rows.groupBy("lang").agg(*C.precision_recall(F.col("quality") == 1, F.length("text") > 1500))


@query("""SELECT quality, toxic, count(*) AS n, round(avg(CASE WHEN length(text) > 1500 THEN 1.0 ELSE 0.0 END), 9) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def class_recall(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg((F.length("text") > 1500).cast("double")), 9).alias("recall"))


@query("WITH " + SQL_COUNTS + " SELECT form, least(n_plain, n_variant) AS missed FROM counts ORDER BY 2 DESC, 1 LIMIT 12")
def most_missed(spark, sf):
    return _counts(spark, sf).select("form", F.least("n_plain", "n_variant").alias("missed")).orderBy(F.desc("missed"), "form").limit(12)


@query("""WITH j AS (SELECT quality = 1 AS gold, CASE WHEN contains(text, '!!') THEN FALSE WHEN contains(text, '. ') THEN TRUE END AS cue, length(text) > 1500 AS model FROM documents JOIN labels USING (doc_id))
SELECT gold, count(*) FILTER (WHERE cue = gold) AS cue_right, count(*) FILTER (WHERE cue IS NULL) AS cue_silent, count(*) FILTER (WHERE model = gold) AS model_right, count(*) FILTER (WHERE cue <> model) AS disagree, round(avg(abs(CAST(coalesce(cue, FALSE) AS INTEGER) - CAST(model AS INTEGER))), 9) AS drift FROM j GROUP BY gold""")
def cue_against_model(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    t = F.col("text")
    rows = rows.select((F.col("quality") == 1).alias("gold"), F.when(t.contains("!!"), False).when(t.contains(". "), True).alias("cue"), (F.length(t) > 1500).alias("model"))
    drift = F.abs(F.coalesce("cue", F.lit(False)).cast("int") - F.col("model").cast("int"))
    return rows.groupBy("gold").agg(F.count_if(F.col("cue") == F.col("gold")).alias("cue_right"), F.count_if(F.col("cue").isNull()).alias("cue_silent"), F.count_if(F.col("model") == F.col("gold")).alias("model_right"), F.count_if(F.col("cue") != F.col("model")).alias("disagree"), F.round(F.avg(drift), 9).alias("drift"))


@query("""SELECT lower(left(text, 1)) || '' AS src, role AS dst, count(*) AS n FROM conversations GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 300""")
def top_changes(spark, sf):
    return C.top_changes(table(spark, sf, "conversations").select(F.lower(F.substring("text", 1, 1)).alias("src"), F.col("role").alias("dst")))


@query("""WITH d AS (SELECT source, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), h AS (SELECT source, coalesce(lang, '') AS kind, count(*) AS n FROM d WHERE toxic = 1 GROUP BY 1, 2),
s AS (SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE toxic = 1) AS flagged FROM d GROUP BY 1)
SELECT s.source, n_docs, flagged, round(flagged / n_docs::DOUBLE, 9) AS share, (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM h WHERE h.source = s.source) AS kinds FROM s""")
def flag_share_by_side(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    flagged = F.col("toxic") == 1
    kinds = rows.filter(flagged).groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "lang", "n"))), ",").alias("kinds"))
    total = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(flagged).alias("flagged"))
    return total.join(kinds, "source", "left").select("source", "n_docs", "flagged", F.round(F.col("flagged") / F.col("n_docs"), 9).alias("share"), "kinds")


@query("""SELECT lang, count(*) FILTER (WHERE quality = 0) AS low, count(*) FILTER (WHERE quality = 1) AS high, count(*) FILTER (WHERE quality IS NULL) AS unsure FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 15""")
def judge_tallies(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    q = F.col("quality")
    out = rows.groupBy("lang").agg(F.count_if(q == 0).alias("low"), F.count_if(q == 1).alias("high"), F.count_if(q.isNull()).alias("unsure"), F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "lang").limit(15).drop("n")


# ---- windows and pages


@query("""SELECT conv_id, turn, role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations""")
def prev_turn_context(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag("text").over(w).alias("before"), F.lead("role").over(w).alias("next_role"))


@query("WITH " + SQL_SENTENCES + """, f AS (SELECT doc_id, ix, length(sentence) > 80 AS long FROM sentences),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - row_number() OVER (PARTITION BY doc_id, long ORDER BY ix) AS island FROM f)
SELECT doc_id, min(ix) AS first, max(ix) AS last, count(*) AS n FROM g WHERE long GROUP BY doc_id, island HAVING count(*) >= 2""")
def islands(spark, sf):
    rows = C.sentences(_docs(spark, sf)).select("doc_id", "ix", (F.length("sentence") > 80).alias("long"))
    island = F.row_number().over(Window.partitionBy("doc_id").orderBy("ix")) - F.row_number().over(Window.partitionBy("doc_id", "long").orderBy("ix"))
    runs = rows.withColumn("island", island).filter("long").groupBy("doc_id", "island").agg(F.min("ix").alias("first"), F.max("ix").alias("last"), F.count("*").alias("n"))
    return runs.filter("n >= 2").drop("island")


@query("""WITH t AS (SELECT doc_id, unnest(p) AS s, unnest(range(0, len(p))) AS ix FROM (SELECT doc_id, regexp_extract_all(text, '\\p{L}+|[^\\p{L}]+') AS p FROM documents)),
m AS (SELECT *, CASE WHEN regexp_matches(s, '[.!?]') THEN ix END AS stop, CASE WHEN regexp_matches(s, '[.,;:!?]') THEN 1 ELSE 0 END AS brk FROM t),
w AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_stop, sum(brk) OVER (PARTITION BY doc_id ORDER BY ix) AS clause FROM m)
SELECT doc_id, CAST(sum(coalesce(last_stop, -1)) AS BIGINT) AS stop_sum, CAST(max(clause) AS BIGINT) AS clauses, count(*) FILTER (WHERE s = upper(s) AND length(s) > 1 AND s <> lower(s)) AS caps FROM w WHERE regexp_matches(s, '^\\p{L}') AND NOT contains(s, 'ß') GROUP BY doc_id""")
def stops_and_clauses(spark, sf):
    long = lambda n, name: F.lit(n).cast("long").alias(name)
    tallies = ("n_words", "stop_sum", "clauses", "caps")

    def step(seen, s):
        place, n = seen["place"], seen["n"]
        goes_on = lambda place, n: F.struct((seen["ix"] + 1).alias("ix"), place.alias("place"), n.alias("n"))
        own = F.struct((n["n_words"] + 1).alias("n_words"), (n["stop_sum"] + place["last_stop"]).alias("stop_sum"), place["clause"].alias("clauses"), (n["caps"] + X.all_caps(s).cast("long")).alias("caps"))
        between = F.struct(F.when(s.rlike("[.!?]"), seen["ix"]).otherwise(place["last_stop"]).alias("last_stop"), (place["clause"] + 1).alias("clause"))
        word = F.when(s.contains("ß"), goes_on(place, n)).otherwise(goes_on(place, own))
        return F.when(s == " ", goes_on(place, n)).when(s.rlike(r"^\p{L}"), word).when(s.rlike("[.,;:!?]"), goes_on(between, n)).otherwise(goes_on(place, n))

    first = F.struct(long(0, "ix"), F.struct(long(-1, "last_stop"), long(0, "clause")).alias("place"), F.struct(*[long(0, c) for c in tallies]).alias("n"))
    walked = _docs(spark, sf).select("doc_id", F.aggregate(X.tokens("text"), first, step, lambda seen: seen["n"]).alias("x"))
    return walked.filter("x.n_words > 0").select("doc_id", "x.stop_sum", "x.clauses", "x.caps")


@query("""WITH last AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2)
SELECT user_id, count(*) AS members, count(*) FILTER (WHERE v > 0) AS active, round(sum(v), 6) AS total FROM last GROUP BY user_id""")
def latest_per_key_totals(spark, sf):
    return C.latest_totals(table(spark, sf, "events"), "user_id", "event_type", "ts", "value", "event_id").withColumn("total", F.round("total", 6))


@query("""WITH a AS (SELECT page_id, """ + SQL_HOST + """ AS host, lower(regexp_extract(html, '(?i)<html[^>]*\\blang=["'']?([A-Za-z]+)', 1)) AS lang,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>', ' ', 'g'), '(?is)<template\\b[^>]*>.*?</template\\s*>', ' ', 'g'), '(?is)<[^>]+>', ' ', 'g') AS t FROM pages)
SELECT page_id, host, lang, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM a""")
def html_text(spark, sf):
    return page_texts(table(spark, sf, "pages"))


@query("""SELECT doc_id AS key, left(string_agg(line, chr(10) ORDER BY ix), 20000) AS head FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS ix FROM documents) GROUP BY doc_id""")
def document_heads(spark, sf):
    rows = _docs(spark, sf).select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n")).alias("ix", "text"))
    return C.heads(rows, "key", "ix")


@query("""SELECT doc_id, CASE WHEN lang = 'de' AND source <> 'src2' AND NOT (source = 'src4' AND len(regexp_extract_all(text, '\\p{L}+')) <= 3) THEN TRUE ELSE FALSE END AS eligible FROM documents""")
def eligible_nodes(spark, sf):
    tag = F.when(F.col("source") == "src2", "code").when(F.col("source") == "src4", "em").otherwise("p")
    return _docs(spark, sf).select("doc_id", C.eligible(tag, F.lit(None).cast("string"), F.col("text"), F.col("lang"), F.lit(False)).alias("eligible"))


@query("""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_extract(text, '^([^,.;:!?]*)', 1), '\\p{L}+'), lambda x: lower(x)) AS ws FROM documents)
SELECT doc_id, len(list_filter(ws, lambda x: x IN ('the', 'der') OR regexp_matches(x, '^k?ein(?:e|en|em|er|es)?$'))) > 0 AS impersonal FROM w""")
def impersonal_openings(spark, sf):
    return _docs(spark, sf).select("doc_id", C.impersonal(F.col("text"), ["the", "der"]).alias("impersonal"))
