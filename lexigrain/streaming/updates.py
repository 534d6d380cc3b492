"""Streams of texts and counts: new versions only, two-phase results, latest state per key.

The sources have no event time of their own; where a watermark is used it is on a
column that the caller names, and rows later than it are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import work_folder

__all__ = ["collected", "current", "finish", "latest", "new_texts", "replay", "scattered", "two_phases", "verdicts", "work_folder"]


def new_texts(stream: DataFrame, key: str, text: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Rows whose (key, text) has not been seen within the watermark."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withColumn("text_hash", F.sha2(F.coalesce(text, F.lit("")), 256)).withWatermark(time, late).dropDuplicatesWithinWatermark([key, "text_hash"])


def latest(stream: DataFrame, keys: list[str], time: str, value: str, tie: str) -> DataFrame:
    """The latest value per key, for update mode; state is one row per key."""
    return stream.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(time, tie)).alias(value), F.max(time).alias(time))


def two_phases(stream: DataFrame, path: str, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], version: str = "version"):
    """A writer that appends each batch's quick results as phase 1 and its better ones as phase 2."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for phase, make in ((1, first), (2, second)):
            # a batch that is repeated after a failure overwrites what it wrote before
            make(kept).withColumn("phase", F.lit(phase)).write.mode("overwrite").parquet(f"{path}/batch={number}/phase_{phase}")
        kept.unpersist()

    return stream.writeStream.foreachBatch(write)


def current(rows: DataFrame, key: str, version: str = "version") -> DataFrame:
    """One row per key: of its newest version the latest phase; results for older versions are stale."""
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("phase"))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def finish(writer, checkpoint: str, timeout: int = 600) -> None:
    """Run a stream over all that there is now, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("the stream has not ended")


def replay(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a path or pattern."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def collected(stream: DataFrame, path: str, mode: str = "update") -> str:
    """Write every batch of a stream under ``path``, a folder each; the pattern to read them."""
    finish(stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.withColumn("batch_no", F.lit(n)).write.mode("overwrite").parquet(f"{path}/b{n}")), f"{path}-state")
    return f"{path}/b*"


def verdicts(stream: DataFrame, key: str, order: str, hit: str, gone: str, least: int = 3) -> DataFrame:
    """``key``, ``order``, ``verdict`` each time that a key's verdict changes; what does not change is not sent again.

    The verdict is whether more than half of a key's rows so far are hits, from ``least`` rows on;
    late rows may turn it. A row with ``gone`` closes the key: its state is dropped, and a
    new one begins with the next row. Rows of a batch are taken in the order of ``order``.
    """
    kind = dict(stream.dtypes)

    def step(found: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        n, hits, shown = state.get if state.exists else (0, 0, None)
        out, closed = [], False
        for at, is_hit, is_gone in zip(rows[order], rows[hit], rows[gone], strict=True):
            n, hits, closed = n + 1, hits + bool(is_hit), bool(is_gone)
            now = 2 * hits > n if n >= least else None
            if now is not None and now != shown:
                shown = now
                out.append((*found, at, now))
            if closed:
                n, hits, shown = 0, 0, None
        state.remove() if closed else state.update((n, hits, shown))
        yield pd.DataFrame(out, columns=[key, order, "verdict"])

    return stream.select(key, order, hit, gone).groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {order} {kind[order]}, verdict boolean", "n long, hits long, shown boolean", "append", GroupStateTimeout.NoTimeout)


def scattered(df: DataFrame, path: str, order: str, files: int) -> str:
    """``df`` written as ``files`` files in an order, for a stream of as many batches; the pattern to read them."""
    edges = df.select(F.percentile_approx(order, [i / files for i in range(1, files)])).first()[0] or []  # one number per file
    part = sum((F.when(F.col(order) > e, 1).otherwise(0) for e in edges), F.lit(0))
    for i in range(files):
        df.filter(part == i).coalesce(1).write.parquet(f"{path}/part={i}")
    return f"{path}/part=*"
