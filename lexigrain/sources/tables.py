"""Reading and writing: Parquet, text, JSON lines, CoNLL-U, issue forms, HTML pages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; a temporary one only in a local session without it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lexigrain-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read again: its plan runs once, and its size in bytes is known to the joins that follow."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Small rows that make much work, dealt out evenly: a compact file is one task, and adaptive execution would gather few bytes in few tasks again."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``line`` for each line of text files; with ``limit`` the first of them by file and place."""
    found = spark.read.text(path).withColumnRenamed("value", "line")
    if limit is None:
        return found
    placed = found.withColumn("__file", F.input_file_name()).withColumn("__at", F.monotonically_increasing_id())
    return placed.orderBy("__file", "__at").limit(limit).select("line")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def conllu_sentences(spark: SparkSession, path: str) -> DataFrame:
    """``sentence`` of each ``# text = `` line of CoNLL-U files."""
    mark = "# text = "
    return lines(spark, path).filter(F.col("line").startswith(mark)).select(F.substring("line", len(mark) + 1, 1 << 30).alias("sentence"))


def issue_forms(bodies: DataFrame, fields: Mapping[str, str], body_col: str = "body", needed: str | None = None) -> DataFrame:
    """A column per field of issue forms with ``### Label`` sections; rows without ``needed`` go.

    ``fields`` maps labels to column names. The first section of a label counts.
    """
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.col(body_col)), r"\n### *"), 2, 1 << 30)
    sections = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "\n", 1)).alias("label"), F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("value")))
    kept = bodies.withColumn("__sections", sections)
    for label, name in fields.items():
        first = _section(label)
        kept = kept.withColumn(name, F.nullif(F.regexp_replace(first, r"^_No response_$", ""), F.lit("")))
    kept = kept.drop("__sections")
    return kept if needed is None else kept.filter(F.col(needed).isNotNull())


def _section(label: str) -> Column:
    value = F.filter("__sections", lambda s: s["label"] == label)
    return F.when(F.size(value) > 0, F.element_at(value, 1)["value"])


def tagged_tokens(df: DataFrame, tokens: str = "tokens", tags: str = "ner_tags") -> DataFrame:
    """A row per token of parallel arrays: other columns, ``ix``, ``token``, ``tag``."""
    rest = [c for c in df.columns if c not in (tokens, tags)]
    return df.select(*rest, F.posexplode(F.arrays_zip(F.col(tokens).alias("token"), F.col(tags).alias("tag"))).alias("ix", "pair")).select(*rest, "ix", "pair.token", "pair.tag")


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``lang``, ``text`` of raw pages."""
    lang = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1))
    return pages.select("page_id", X.host("url").alias("host"), lang.alias("lang"), X.html_text("html").alias("text"))


def sampled(df: DataFrame, key: str, rows: int, seed: str = "s") -> DataFrame:
    """Exactly ``rows`` rows (or all there are): those whose seeded keys hash least."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(rows)


def shuffled(df: DataFrame, key: str, seed: str = "s") -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)


def write_splits(sentences: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split, each sentence once."""
    sentences.dropDuplicates([split, "sentence"]).write.mode("overwrite").partitionBy(split).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_once(df: DataFrame, path: str, key: str) -> str:
    """Write ``df`` under a folder named by ``key`` (a vocabulary's hash, say) unless it is there; the folder."""
    target = f"{path}/{key}"
    df.write.mode("ignore").parquet(target)
    return target


def confident(df: DataFrame, score: str, least: float = 0.85) -> DataFrame:
    """Rows whose language score is ``least`` or more; one without a score goes."""
    return df.filter(F.col(score) >= least)


def first_per_split(rows: DataFrame, split: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each split in an order."""
    from ..operators.corpus import top_per_key

    return top_per_key(rows, [split], [F.col(c) for c in order], k, order).drop("rank")
