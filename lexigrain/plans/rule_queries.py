"""Queries on rule tables: lookups, cues, evidence, noun phrases.

The documents hold no words of the seed, so lookups on them take rule tables that
are made from their own frequent words; the seed is tested on inline rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..operators import lookup as K
from ..operators import morph as M
from ..operators import spans as S
from ..operators.rules import SEED, RuleSet
from ..sources.tables import table
from .corpus_queries import SQL_WORDS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _words(spark, sf):
    return C.words_of(table(spark, sf, "documents")).distinct()


SQL_TOP = SQL_WORDS + """,
distinct_words AS (SELECT DISTINCT word FROM words),
top AS (SELECT lower(word) AS form, row_number() OVER (ORDER BY count(*) DESC, lower(word)) AS ord FROM words WHERE length(word) BETWEEN 3 AND 6 GROUP BY lower(word) QUALIFY ord <= 60)"""


def _top(spark, sf):
    n = C.words_of(table(spark, sf, "documents")).filter(F.length("word").between(3, 6)).groupBy(F.lower("word").alias("form")).agg(F.count("*").alias("n"))
    first = n.orderBy(F.desc("n"), "form").limit(60)
    return first.select("form", F.expr("row_number() OVER (ORDER BY n DESC, form)").alias("ord"))


@query("WITH " + SQL_TOP + """, m AS (SELECT d.word, t.form, CASE WHEN d.word = t.form THEN reverse(t.form) WHEN length(word) > 1 AND word = upper(word) THEN upper(reverse(t.form))
  WHEN lower(left(word, 1)) || substr(word, 2) = t.form THEN upper(left(reverse(t.form), 1)) || substr(reverse(t.form), 2) END AS repl FROM distinct_words d JOIN top t ON lower(d.word) = t.form)
SELECT word, repl FROM m WHERE repl IS NOT NULL""")
def exact_lookup(spark, sf):
    rules = _top(spark, sf).select(F.col("form").alias("surface"), F.reverse("form").alias("repl"), "ord")
    return K.exact(_words(spark, sf), rules).filter(F.col("repl").isNotNull())


@query("WITH " + SQL_TOP + """, hits AS (SELECT word, form, ord, length(form) AS n FROM distinct_words JOIN top ON ends_with(lower(word), form) AND length(word) - length(form) >= 3 WHERE NOT (ord % 7 = 0 AND contains(lower(word), 'z')))
SELECT word, left(word, length(word) - n) AS prefix, form, CAST(ord AS INTEGER) AS entry FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY ord) AS r FROM hits) WHERE r = 1""")
def suffix_lookup(spark, sf):
    forms = _top(spark, sf).select("form", F.col("ord").alias("entry"), F.lit(0).alias("rank"), F.when(F.col("ord") % 7 == 0, "z").alias("unless"))
    return K.suffix(_words(spark, sf), forms)


@query("WITH " + SQL_TOP + """, hits AS (SELECT word, form, ord, substr(word, length(form) + 1) AS remainder FROM distinct_words JOIN top ON starts_with(lower(word), form) AND length(word) - length(form) >= 3)
SELECT word, form AS head, 'x' || form AS repl, remainder FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY ord) AS r FROM hits WHERE left(remainder, 1) = lower(left(remainder, 1))) WHERE r = 1""")
def prefix_lookup(spark, sf):
    heads = _top(spark, sf).select(F.col("form").alias("head"), F.concat(F.lit("x"), "form").alias("repl"), F.lit(None).cast("string").alias("unless"), "ord")
    return K.prefix(_words(spark, sf), heads)


@query("WITH " + SQL_TOP + """, hits AS (SELECT word, form, ord, lower(substr(word, length(form) + 1)) AS ending FROM distinct_words JOIN top ON starts_with(lower(word), form) WHERE regexp_matches(lower(substr(word, length(form) + 1)), '^(?:en|e|st|t|et|te|ten|ter|tes|tem|test|tet|end|ende|enden|ender|endes|endem)$') AND word = lower(word))
SELECT word, form AS stem, form || 'l' || ending AS plain, 'ge' || form || 'l' || ending AS participle FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY ord) AS r FROM hits) WHERE r = 1""")
def verb_lookup(spark, sf):
    stems = _top(spark, sf).select(F.col("form").alias("stem"), F.concat("form", F.lit("l")).alias("repl"), F.lit("ge").alias("ge"), "ord")
    return K.verbs(_words(spark, sf).filter(F.col("word") == F.lower("word")), stems)


@query("WITH " + SQL_TOP + """, long_top AS (SELECT form FROM top WHERE length(form) >= 5)
SELECT word FROM distinct_words d WHERE lower(word) NOT IN (SELECT form FROM top) AND NOT EXISTS (SELECT 1 FROM long_top t WHERE length(d.word) > length(t.form) AND (starts_with(lower(d.word), t.form) OR ends_with(lower(d.word), t.form)))""")
def keep_list(spark, sf):
    return K.not_kept(_words(spark, sf), _top(spark, sf).select(F.col("form").alias("word")))


@query("WITH " + SQL_WORDS + """, w AS (SELECT DISTINCT word FROM words WHERE contains(word, 'ss') AND NOT (length(word) > 1 AND word = upper(word) AND word <> lower(word)))
SELECT word, CASE WHEN contains(lower(word), 'esse') THEN one ELSE regexp_replace(one, '([eE])(?:ss)([eE])', '\\1ß\\2', 'g') END AS respelled
FROM (SELECT word, regexp_replace(word, '([aA])(?:ss)([aA])', '\\1ß\\2', 'g') AS one FROM w)""")
def ss_rules(spark, sf):
    words = _words(spark, sf).filter(F.col("word").contains("ss") & ~X.all_caps("word"))
    return words.select("word", K.ordered_rules(F.col("word"), [("assa", None), ("esse", "esse")]).alias("respelled"))


@query("""WITH d AS (SELECT doc_id, text, strpos(text, 'tion') - 1 AS place FROM documents WHERE contains(text, 'tion')),
g AS (SELECT *, string_split(text, 'ing') AS a, string_split(text, 'ed ') AS b FROM d),
n AS (SELECT *, list_min(list_transform(range(1, len(a)), lambda i: abs(CAST(length(array_to_string(a[1:i], 'ing')) AS BIGINT) - place))) AS pro,
  list_min(list_transform(range(1, len(b)), lambda i: abs(CAST(length(array_to_string(b[1:i], 'ed ')) AS BIGINT) - place))) AS contra FROM g)
SELECT doc_id, CASE WHEN pro IS NOT NULL AND contra IS NOT NULL THEN CASE WHEN pro <= contra THEN 1 ELSE 0 END WHEN pro IS NOT NULL THEN 1 WHEN contra IS NOT NULL THEN 0 END AS verdict FROM n""")
def cue_decision(spark, sf):
    docs = table(spark, sf, "documents").filter(F.col("text").contains("tion"))
    return docs.select("doc_id", K.decide(F.lit("tion"), [F.col("text")], "ing", "ed ").alias("verdict"))


@query("WITH " + SQL_TOP + """, each_word AS (SELECT DISTINCT doc_id, word FROM words),
found AS (SELECT doc_id, lower(word) AS sign FROM each_word WHERE lower(word) IN (SELECT form FROM top WHERE ord > 55)
  UNION SELECT doc_id, 'currency' FROM each_word WHERE word IN ('onst', 'thin')
  UNION SELECT doc_id, 'of the' FROM documents WHERE regexp_matches(' ' || lower(text) || ' ', '[^\\p{L}]of the[^\\p{L}]')
  UNION SELECT doc_id, lower(word) FROM each_word WHERE contains(word, 'ss') AND regexp_matches(lower(word), 'ess') AND NOT (length(word) > 1 AND word = upper(word) AND word <> lower(word))),
h AS (SELECT doc_id, count(DISTINCT sign) AS n FROM found GROUP BY 1),
c AS (SELECT doc_id, len(regexp_extract_all(text, '\\p{L}+')) AS n_words FROM documents)
SELECT doc_id, CAST(n_words AS INTEGER) AS n_words, coalesce(n, 0) AS n_signs, coalesce(n, 0) >= 2 OR (coalesce(n, 0) >= 1 AND n_words <= 40) AS swiss FROM c LEFT JOIN h USING (doc_id)""")
def swiss_signs(spark, sf):
    docs = table(spark, sf, "documents")
    listed = _top(spark, sf).filter("ord > 55").select(F.col("form").alias("sign"))
    found = K.signs(docs, listed, currency=r"(?<!\p{L})(?:onst|thin)(?!\p{L})", wholes=["of the"], ss=[("ess", None)])
    return K.evidence(docs, found)


SQL_REJECTS = """parts AS (SELECT doc_id, text, unnest(p) AS s, unnest(range(0, len(p))) AS ix FROM (SELECT doc_id, text, regexp_extract_all(text, '\\p{L}+|[^\\p{L}]+') AS p FROM documents)),
places AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM parts),
spans AS (SELECT doc_id, text, CAST(start AS BIGINT) AS start, CAST(start + length(s) AS BIGINT) AS stop, s AS word FROM places WHERE regexp_matches(s, '^\\p{L}')),
rejects AS (SELECT DISTINCT word, substr(text, start - 9, 10) AS before, substr(text, stop + 1, 4) AS after FROM spans WHERE start BETWEEN 40 AND 46),
near AS (SELECT s.doc_id, s.start, s.stop, word, before, after, substr(text, greatest(0, start - 30) + 1, least(30, start)) AS l, substr(text, stop + 1, 30) AS r FROM spans s JOIN rejects USING (word))"""


@query("WITH " + SQL_REJECTS + """, m AS (SELECT *, least(length(l), length(before)) AS a, least(length(r), length(after)) AS b FROM near)
SELECT DISTINCT doc_id, start, stop AS "end", word FROM m WHERE right(l, a) = right(before, a) AND left(r, b) = left(after, b) AND (a + b >= 12 OR (a = length(before) AND b = length(after)))""")
def held_places(spark, sf):
    """Places noted as rejected, by word and what stands around it, found again in all texts."""
    docs = table(spark, sf, "documents")
    words = S.word_spans(docs, "doc_id", around=30)
    noted = words.filter(F.col("start").between(40, 46)).select("word", F.expr("right(before, 10)").alias("before"), F.expr("left(after, 4)").alias("after"))
    return K.held(words, noted)


@query("""WITH r AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents)),
p AS (SELECT doc_id, w AS word, replace(w, 'th', 'h') AS other FROM r WHERE contains(w, 'th'))
SELECT * FROM p SEMI JOIN (SELECT DISTINCT doc_id, lower(w) AS l FROM r) x ON x.doc_id = p.doc_id AND x.l = lower(p.other)""")
def contrasted_words(spark, sf):
    docs = table(spark, sf, "documents")
    words = C.words_of(docs, "doc_id").distinct().filter(F.col("word").contains("th"))
    return K.contrasted(words.withColumn("other", F.replace("word", F.lit("th"), F.lit("h"))), docs)


@query("""SELECT doc_id, e >= 2 AND e > 3 * n AS german FROM (SELECT doc_id, length(text) - length(replace(text, 'ß', '')) AS e, len(list_filter(regexp_extract_all(text, '\\p{L}*ss\\p{L}*'), lambda w: regexp_matches(lower(w), 'ess') AND NOT (length(w) > 1 AND w = upper(w)))) AS n FROM documents)""")
def german_spelling(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.german_spelling(F.col("text"), [("ess", None)]).alias("german"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(' ' || text, '([^\\p{L}])the and([^\\p{L}])', '\\1BOTH\\2', 'g'), '([^\\p{L}])the and([^\\p{L}])', '\\1BOTH\\2', 'g') AS text FROM documents WHERE regexp_matches(' ' || text, '[^\\p{L}]the and[^\\p{L}]')""")
def phrase_replacement(spark, sf):
    text = F.concat(F.lit(" "), F.col("text"))
    new = K.phrases(text, {"the and": "BOTH"})
    return table(spark, sf, "documents").filter(text.rlike(r"[^\p{L}]the and[^\p{L}]")).select("doc_id", new.alias("text"))


@query("""SELECT * FROM (VALUES (1, 'sg', 1, 'die wichtige Entscheidung'), (2, 'sg', 2, 'mit dem neuen Fahrrad'), (3, 'pl', 0, 'die alten Krankenhäuser'), (3, 'pl', 1, 'die alten Krankenhäuser'),
(4, 'sg', 2, 'auf dem Dachboden'), (5, 'pl', 0, 'rote Möhren'), (5, 'pl', 1, 'rote Möhren'), (6, 'sg', 0, 'eine Fahrkarte'), (6, 'sg', 1, 'eine Fahrkarte'), (7, 'pl', 0, 'frische Rote Bete'), (7, 'pl', 1, 'frische Rote Bete'), (8, 'sg', 3, 'des kleinen Jungen')) AS t(np_id, num, "case", text)""")
def np_rewrite(spark, sf):
    rules = RuleSet.parse(SEED)
    rows = [(1, "den", None, ["wichtigen"], "Entscheid", None), (2, "dem", "mit", ["neuen"], "Velo", None), (3, "die", None, ["alten"], "Spitäler", None), (4, "im", None, [], "Estrich", None),
            (5, None, None, ["rote"], "Rüebli", "pl"), (6, "ein", None, [], "Billett", None), (7, None, None, ["frische"], "Randen", None), (8, "des", None, ["kleinen"], "Buben", None)]
    phrases = spark.createDataFrame(rows, "np_id int, det string, prep string, adjs array<string>, noun string, number string")
    out = M.rewrite(phrases, M.tables(spark, rules.nouns))
    return out.select("np_id", "num", "case", F.when(F.col("np_id") == 2, F.concat(F.lit("mit "), "text")).otherwise(F.col("text")).alias("text"))


#: Paradigms as a grammar prints them: cell, and the four cases in order.
SQL_PARADIGMS = """cells AS (SELECT * FROM (VALUES
  ('def', 'm', ['der', 'den', 'dem', 'des']), ('def', 'f', ['die', 'die', 'der', 'der']), ('def', 'n', ['das', 'das', 'dem', 'des']), ('def', 'p', ['die', 'die', 'den', 'der']),
  ('der', 'm', ['er', 'en', 'em', 'es']), ('der', 'f', ['e', 'e', 'er', 'er']), ('der', 'n', ['es', 'es', 'em', 'es']), ('der', 'p', ['e', 'e', 'en', 'er']),
  ('ein', 'm', ['', 'en', 'em', 'es']), ('ein', 'f', ['e', 'e', 'er', 'er']), ('ein', 'n', ['', '', 'em', 'es']), ('ein', 'p', ['e', 'e', 'en', 'er']),
  ('rel', 'm', ['der', 'den', 'dem', 'dessen']), ('rel', 'f', ['die', 'die', 'der', 'deren']), ('rel', 'n', ['das', 'das', 'dem', 'dessen']), ('rel', 'p', ['die', 'die', 'denen', 'deren'])) AS t(kind, cell, forms)),
stems AS (SELECT 'der' AS kind, unnest(['all', 'dies', 'jed', 'jen', 'manch', 'solch', 'welch']) AS stem UNION ALL SELECT 'ein', unnest(['dein', 'ein', 'euer', 'ihr', 'kein', 'mein', 'sein', 'unser']) UNION ALL SELECT 'def', ''),
ends AS (SELECT kind, cell, unnest(forms) AS ending, unnest(range(0, 4)) AS c FROM cells),
dets AS (SELECT kind, stem, cell, c, CASE WHEN stem = 'euer' AND ending <> '' THEN 'eur' ELSE stem END || ending AS form FROM ends JOIN stems USING (kind) WHERE NOT (stem = 'ein' AND cell = 'p')),
shorts AS (SELECT * FROM (VALUES ('am', 'dem'), ('ans', 'das'), ('aufs', 'das'), ('beim', 'dem'), ('durchs', 'das'), ('fürs', 'das'), ('im', 'dem'), ('ins', 'das'), ('ums', 'das'), ('vom', 'dem'), ('zum', 'dem'), ('zur', 'der')) AS t(short, article))"""


@query("WITH " + SQL_PARADIGMS + """ SELECT DISTINCT form, cell, CAST(c AS INTEGER) AS "case" FROM (SELECT form, cell, c FROM dets UNION ALL SELECT short, cell, c FROM shorts JOIN dets ON kind = 'def' AND form = article)""")
def determiner_cells(spark, sf):
    return M.determiner_cells(spark)


@query("WITH " + SQL_PARADIGMS + """, pairs AS (SELECT o.ending AS word, o.cell AS old_cell, n.cell AS new_cell, n.ending AS form, min(o.c) AS c FROM ends o JOIN ends n ON o.kind = 'rel' AND n.kind = 'rel' AND o.c = n.c GROUP BY 1, 2, 3, 4)
SELECT word, old_cell, new_cell, form, CAST(row_number() OVER (PARTITION BY word, old_cell, new_cell ORDER BY c) - 1 AS INTEGER) AS rank FROM pairs""")
def relative_followers(spark, sf):
    return M.followers(spark, M.RELATIVE)


@query("WITH " + SQL_PARADIGMS + """, adjectives AS (SELECT * FROM (VALUES ('weak', 'm', ['e', 'en', 'en', 'en']), ('weak', 'f', ['e', 'e', 'en', 'en']), ('weak', 'n', ['e', 'e', 'en', 'en']), ('weak', 'p', ['en', 'en', 'en', 'en']),
  ('mixed', 'm', ['er', 'en', 'en', 'en']), ('mixed', 'f', ['e', 'e', 'en', 'en']), ('mixed', 'n', ['es', 'es', 'en', 'en']), ('mixed', 'p', ['en', 'en', 'en', 'en'])) AS t(decl, cell, forms)),
adj AS (SELECT decl, cell, unnest(forms) AS ending, unnest(range(0, 4)) AS c FROM adjectives),
phrases AS (SELECT d.form || ' ' || 'neu' || a.ending || ' Entscheid' || CASE WHEN c = 3 THEN 's' ELSE '' END AS swiss, d.kind, d.stem, c FROM dets d JOIN adj a USING (cell, c) WHERE d.cell = 'm' AND a.decl = CASE d.kind WHEN 'ein' THEN 'mixed' ELSE 'weak' END),
german AS (SELECT d.kind, d.stem, c, d.form || ' neu' || a.ending || ' Entscheidung' AS german FROM dets d JOIN adj a USING (cell, c) WHERE d.cell = 'f' AND a.decl = CASE d.kind WHEN 'ein' THEN 'mixed' ELSE 'weak' END)
SELECT swiss, CAST(c AS INTEGER) AS "case", german AS text FROM phrases JOIN german USING (kind, stem, c)""")
def np_paradigms(spark, sf):
    """Every determiner with an adjective and a noun, read and rendered with the noun that replaces it."""
    dets = M.determiner_rows()
    endings = {(d, cell, case): e for d, cell, case, e in M.ending_rows()}
    rows = [(f"{form} neu{endings[decl, cell, case]} Entscheid{'s' * (case == 3)}", form, [f"neu{endings[decl, cell, case]}"], "Entscheid" + "s" * (case == 3), case) for form, kind, stem, prep, cell, case, decl in dets if cell == "m" and prep is None]
    phrases = spark.createDataFrame(sorted(set((r[0], r[1], tuple(r[2]), r[3], r[4]) for r in rows)), "swiss string, det string, adjs array<string>, noun string, wanted int")
    phrases = phrases.withColumn("np_id", F.concat_ws("|", "swiss", "wanted")).withColumn("prep", F.lit(None).cast("string")).withColumn("number", F.lit("sg"))
    out = M.rewrite(phrases.select("np_id", "det", "prep", "adjs", "noun", "number"), M.tables(spark, RuleSet.parse(SEED).nouns))
    return out.filter(F.col("case") == F.substring_index("np_id", "|", -1).cast("int")).select(F.substring_index("np_id", "|", 1).alias("swiss"), "case", "text")


@query("WITH " + SQL_TOP + """, pairs AS (SELECT form AS target, unnest([reverse(form), form || 'x']) AS source FROM top),
listed AS (SELECT target, list_sort(list_distinct(list(source))) AS sources FROM pairs GROUP BY 1),
hits AS (SELECT word, sources, target, CASE WHEN lower(word) = target THEN 0 WHEN ends_with(lower(word), target) AND length(word) - length(target) >= 3 THEN 1 END AS rank FROM distinct_words JOIN listed ON ends_with(lower(word), target)
  UNION ALL SELECT word, sources, target, 2 FROM distinct_words JOIN listed ON starts_with(lower(word), target) AND length(word) - length(target) >= 3),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY rank, length(target) DESC) AS r FROM hits WHERE rank IS NOT NULL),
chosen AS (SELECT word, rank, target, sources[CAST(CAST('0x' || substr(md5('r:' || word), 1, 8) AS BIGINT) % len(sources) AS INTEGER) + 1] AS s FROM best WHERE r = 1),
sided AS (SELECT *, CASE rank WHEN 0 THEN word WHEN 2 THEN left(word, length(target)) END AS own FROM chosen),
made AS (SELECT *, CASE WHEN length(own) > 1 AND own = upper(own) AND own <> lower(own) THEN upper(s) WHEN left(own, 1) <> lower(left(own, 1)) THEN upper(left(s, 1)) || substr(s, 2) ELSE s END AS cased FROM sided)
SELECT word, CASE rank WHEN 0 THEN cased WHEN 1 THEN left(word, length(word) - length(target)) || lower(s) ELSE cased || substr(word, length(target) + 1) END AS source, CASE rank WHEN 0 THEN 'exact' WHEN 1 THEN 'suffix' ELSE 'head' END AS how FROM made""")
def reverse_lookup(spark, sf):
    top = _top(spark, sf)
    pairs = top.select(F.col("form").alias("target"), F.explode(F.array(F.reverse("form"), F.concat("form", F.lit("x")))).alias("source"))
    return K.reverse(_words(spark, sf), pairs)


@query("WITH " + SQL_TOP + """, own AS (SELECT word, ord AS entry, 0 AS step FROM distinct_words JOIN top ON lower(word) = form AND ord % 3 = 0),
ends AS (SELECT word, ord AS entry, 1 AS step FROM distinct_words JOIN top ON ord % 3 = 1 AND ends_with(lower(word), form) AND length(word) - length(form) >= 3),
heads AS (SELECT word, ord AS entry, 2 AS step FROM distinct_words JOIN top ON ord % 3 = 2 AND starts_with(lower(word), form) AND length(word) - length(form) >= 3 WHERE substr(word, length(form) + 1, 1) = lower(substr(word, length(form) + 1, 1))),
every AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY step, entry) AS r FROM (SELECT * FROM own UNION ALL SELECT * FROM ends UNION ALL SELECT * FROM heads))
SELECT word, CASE step WHEN 0 THEN 'exact' WHEN 1 THEN 'suffix' ELSE 'head' END AS how, CAST(entry AS INTEGER) AS entry FROM every WHERE r = 1""")
def regional_cascade(spark, sf):
    top = _top(spark, sf)
    listed = top.filter("ord % 3 = 0").select(F.col("form").alias("surface"), F.col("ord").alias("entry"))
    forms = top.filter("ord % 3 = 1").select("form", F.col("ord").alias("entry"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("unless"))
    heads = top.filter("ord % 3 = 2").select(F.col("form").alias("head"), F.lit("x").alias("repl"), F.lit(None).cast("string").alias("unless"), "ord")
    return K.cascade(_words(spark, sf), listed, forms, heads)
