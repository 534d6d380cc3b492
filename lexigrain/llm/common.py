"""What the operators of this package share: table access, lineage cuts, folds."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a
    local session without that setting (tests) gets a temporary one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexigrain-"))
    return df.checkpoint()


def crc_text(col: Column | str) -> Column:
    """CRC-32 (unsigned long) of a value written as text."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of ``df``."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def saved(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as Parquet under ``folder`` and read again."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        cut(spark.range(0))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def told_apart(docs: DataFrame, id_col: str, key: str, again: bool = False) -> DataFrame:
    """``docs`` with a text in ``key`` that no two rows share: the id, as long as every row has its own.

    Where ids are null or repeat, it is a hash of the whole row and its number among
    equal rows. Equal rows meet as a count, made where they lie, and are
    exploded again, so that thousands of copies are never one task's rows. Such a table is
    written if it is read ``again``.
    """
    many = docs.groupBy(id_col).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
    if not many.head(1):
        return docs.withColumn(key, F.col(id_col).cast("string"))
    n = free_name(docs, "n")
    rows = docs.groupBy(docs.columns).agg(F.count("*").alias(n)).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    whole = F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(*docs.columns).cast("string"), F.xxhash64(F.lit(1), *docs.columns).cast("string"), F.col(n).cast("string"))
    rows = rows.withColumn(key, whole).drop(n)
    return saved(rows, shared_folder(docs.sparkSession, "rows")) if again else rows


def joined(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner", hot: int = 1000) -> DataFrame:
    """``rows`` joined to ``table``, which has a row per ``key`` at most, with no key's rows gathered in one task.

    ``counts(key, n)`` says how many of the ``total`` rows a key has. Keys of more than
    ``hot`` rows, and of more than a 500,000th of all (so there are 500,000 such keys at
    most), are joined by broadcasting their rows of ``table``; the rest by a shuffle.
    """
    often = cut(counts.filter(F.col("n") > max(hot, total // 500_000)).select(key))
    if not often.head(1):
        return rows.join(table, key, how)
    few = cut(table.join(F.broadcast(often), key))
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(table, key, how)
    return rows.join(F.broadcast(few), key).unionByName(rest.select(*rows.columns, *[c for c in table.columns if c != key]))


#: Bytes of a table that is broadcast at most.
BROADCAST_BYTES = 32 << 20


def light(table: DataFrame, most: int | None = None) -> DataFrame:
    """``table`` (written or checkpointed) marked to be broadcast if its rows hold ``most`` bytes at most; a larger one is left to a shuffle join."""
    strings = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c, kind in table.dtypes if "string" in kind]
    held = (24 + 16 * len(table.columns)) * table.count()  # more than rows of numbers take in a hash relation
    if strings:
        held += table.agg(F.sum(sum(strings[1:], strings[0]))).first()[0] or 0
    return F.broadcast(table) if held <= (BROADCAST_BYTES if most is None else most) else table


def release(spark: SparkSession) -> None:
    """Let the driver notice that earlier steps' shuffle files and checkpoints are no longer needed; else they stay until it happens to collect its garbage."""
    for _ in range(2):  # what the first finds keeps others alive
        gc.collect()
        spark.sparkContext._jvm.System.gc()
