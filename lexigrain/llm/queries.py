"""The dealt queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, flac, labelled, mixing, quality, resharding, secrets, setjoin, simhash, toxicity
from .common import crc_text, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = flac.write_media(table(spark, sf_dir, "documents"))
    return flac.digests(media).drop("error")


def _classified(spark: SparkSession, sf_dir: str, kind) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kind.fit(docs, table(spark, sf_dir, "labels"))
    scores = kind.scored(docs.select("doc_id", "text"), model).drop("text")
    return scores.select("doc_id", labelled.held_out("doc_id", *kind.FOLD).alias("held_out"), "score", kind.predicted(F.col("score")).alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicated(table(spark, sf_dir, "documents"))
    return mixed.withColumn("rate", F.round("rate", 9))


OP4_SQL = """
WITH own AS (SELECT source, sum(coalesce(strlen(text), 0) + 1) AS bytes, pow(sum(coalesce(strlen(text), 0) + 1), 0.5) AS w FROM documents GROUP BY source),
total AS (SELECT sum(w) AS all_w, sum(bytes)::DOUBLE AS all_bytes FROM own),
rates AS (SELECT source, w / all_w * all_bytes / bytes AS rate FROM own, total),
terms AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM rates),
cdf AS (SELECT source, rate, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT *, CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT d.doc_id, any_value(c.rate) AS rate, count(*) AS copies FROM drawn d JOIN cdf c ON d.source = c.source AND c.c <= d.u GROUP BY d.doc_id),
copied AS (SELECT doc_id, rate, copies, unnest(range(1, copies + 1)) AS copy FROM counted)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, round(c.rate, 9) AS rate, CAST(c.copies AS INTEGER) AS copies,
       CAST(c.copy AS INTEGER) AS copy, md5('mix/order:' || d.doc_id || ':' || c.copy) AS shuffle_key
FROM copied c JOIN documents d USING (doc_id)
"""


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    placed = resharding.reshard(docs, F.pmod(crc_text("source"), F.lit(8)), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op6_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = setjoin.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.md5("text").alias("text_md5"), "n_lines", "n_copies", "n_near")


OP6_SQL = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, unnest(parts) AS line, unnest(range(0, len(parts))) AS place FROM split),
sets AS (SELECT doc_id, place, line, list_distinct(list_filter(string_split(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda w: w <> '')) AS words FROM numbered),
ordered AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS nth FROM sets WHERE len(words) > 0),
firsts AS (SELECT row_number() OVER (ORDER BY doc_id, place) AS id, doc_id, place, words, len(words) AS n FROM ordered WHERE nth = 1),
tokens AS (SELECT id, n, unnest(words) AS word FROM firsts),
counted AS (SELECT id, n, word, count(*) OVER (PARTITION BY word) AS df FROM tokens),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY df, word) AS i FROM counted),
prefix AS (SELECT * FROM ranked WHERE i <= n - (4 * n + 4) // 5 + 1 AND df > 1),
pairs AS (SELECT DISTINCT x.id AS later, y.id AS earlier FROM prefix x JOIN prefix y ON x.word = y.word AND x.id > y.id AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n),
links AS (SELECT later, earlier FROM pairs JOIN firsts x ON x.id = later JOIN firsts y ON y.id = earlier WHERE 9 * len(list_intersect(x.words, y.words)) >= 4 * (x.n + y.n)),
copied AS (SELECT doc_id, place, 1 AS kind FROM ordered WHERE nth > 1),
near AS (SELECT doc_id, place, 2 AS kind FROM firsts WHERE id IN (SELECT later FROM links)),
gone AS (SELECT * FROM copied UNION ALL SELECT * FROM near),
texts AS (SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.place) FILTER (WHERE g.kind IS NULL) AS text, count(*) AS n_lines,
          count(*) FILTER (WHERE g.kind = 1) AS n_copies, count(*) FILTER (WHERE g.kind = 2) AS n_near
          FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.place = n.place GROUP BY n.doc_id)
SELECT doc_id, md5(coalesce(text, '')) AS text_md5, n_lines, n_copies, n_near FROM texts
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scanned(docs, secrets.train(secrets.samples(docs)))
    base, every = F.col("base_spans"), F.sort_array(F.concat("base_spans", "added_spans"))
    counts = [secrets.count_of(base, kind).alias(f"n_{kind}") for kind, *_ in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(every).alias("spans"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH turns AS (SELECT conv_id, role, text, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
       string_agg(role || chr(30) || text, chr(31)) OVER w AS said
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT n, said, min(conv_id) AS conv_id FROM turns WHERE pos = n GROUP BY n, said),
kept AS (SELECT w.conv_id, w.n FROM whole w ANTI JOIN (SELECT DISTINCT pos, said FROM turns WHERE pos < n) p ON p.pos = w.n AND p.said = w.said)
SELECT k.conv_id, k.n AS n_turns, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
FROM kept k JOIN turns t ON t.conv_id = k.conv_id GROUP BY k.conv_id, k.n
"""


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_flac": op2_flac,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_resharding": op5_resharding,
    "op6_linedup": op6_linedup,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_chat": op9_chat,
    "op10_decontam": op10_decontam,
}

ORACLES: dict[str, str] = {"op4_mixing": OP4_SQL, "op6_linedup": OP6_SQL, "op9_chat": OP9_SQL}
