"""The corpus pipeline: each stage applies one operator to all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import decontam, mixing, quality, resharding, simhash
from lexigrain.llm.common import crc_text, dropped, saved, shared_folder, table

SHARDS = 8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled ones among ``docs``.

    A null text is scored as an empty one; equal texts, and so repeated rows, go or
    stay together; a score of just the threshold stays. Without labelled rows nothing goes.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.score_udf(docs, model)(F.col("text")) >= quality.THRESHOLD)


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, alike by 0.8 or more in their five-word shingles: that of the least id.

    SimHash fingerprints find the close pairs, whole sets the rest. Null, empty and
    blank texts are one class. Of repeated rows one stays; ties go to the least hash of the text.
    """
    return simhash.keep_one(docs, words=5, threshold=(4, 5))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null and empty texts leak nothing, repeated rows go or stay together."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents by Poisson counts; a source's weight is the root of its size.

    A null source is a source. Rows without an id, and rows that repeat one, draw each for itself.
    """
    return mixing.replicated(docs).select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shards of even bytes, moved from where their sources lie, shuffled within each: ``shard``, ``slot``, ``size``, ``old_shard`` follow.

    A null source lies in shard 0, a null text has the size 1. Copies and rows without an id are placed each by itself.
    """
    return resharding.reshard(docs, F.coalesce(F.pmod(crc_text("source"), F.lit(SHARDS)), F.lit(0)), SHARDS)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_distinct),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: SQL can express neither the classifier nor XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written and read again for the next; what the one before has written goes then."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, f"{folder}/{i}")
            if i:
                dropped(spark, f"{folder}/{i - 1}")
    return docs
