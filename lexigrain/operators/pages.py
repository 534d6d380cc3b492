"""Text from positioned fragments: lines, paragraphs, column edges.

A fragment has ``page, ix, str, eol, x, y, w, h``; y grows upwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import overlapping


def lines(fragments: DataFrame) -> DataFrame:
    """``page``, ``line``, ``text``, ``x``, ``y``, ``right``, ``h`` of each line; a fragment with ``eol`` ends one."""
    before = Window.partitionBy("page").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    rows = fragments.withColumn("line", F.coalesce(F.sum(F.col("eol").cast("int")).over(before), F.lit(0)).cast("int"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ix", "str"))), lambda f: f["str"]), "")
    return rows.groupBy("page", "line").agg(text.alias("text"), F.min("x").alias("x"), F.max("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max("h").alias("h")).filter(F.trim("text") != "")


def paragraphs(rows: DataFrame, gap: float = 1.6, size: float = 0.1, indent: float = 1.5) -> DataFrame:
    """``page``, ``paragraph``, ``text``: a new one where the step down, the size or the indent changes.

    A hyphen at a line's end goes if the next line begins small and does not go on with "und" or "oder".
    """
    marked = with_paragraphs(rows, gap, size, indent)
    gathered = marked.groupBy("page", "paragraph").agg(F.sort_array(F.collect_list(F.struct("line", F.trim("text").alias("t")))).alias("ls"))

    def join(acc, line):
        t = line["t"]
        hyphen = acc.rlike(r"\p{L}-$") & t.rlike(r"^\p{Ll}") & ~t.rlike(r"^(?:und|oder)\b")
        return F.when(acc == "", t).when(hyphen, F.concat(F.regexp_replace(acc, "-$", ""), t)).otherwise(F.concat(acc, F.lit(" "), t))

    return gathered.select("page", "paragraph", F.aggregate("ls", F.lit(""), join).alias("text"))


def with_paragraphs(rows: DataFrame, gap: float = 1.6, size: float = 0.1, indent: float = 1.5) -> DataFrame:
    """``rows`` with ``paragraph``, numbered from 0 on each page."""
    w = Window.partitionBy("page").orderBy("line")
    last_y, last_h, last_x = (F.lag(c).over(w) for c in ("y", "h", "x"))
    parts = (F.abs(last_y - F.col("y")) > gap * last_h) | (F.abs(F.col("h") - last_h) > size * last_h) | (F.col("x") - last_x > indent * last_h) | last_y.isNull()
    return rows.withColumn("new", parts.cast("int")).withColumn("paragraph", (F.sum("new").over(w) - 1).cast("int")).drop("new")


def column_edges(rows: DataFrame, reach: float = 4.0) -> DataFrame:
    """Each line with ``edge``: the right edge of its column, the furthest of lines that begin within ``reach`` of it.

    Lines are binned by their left edge, so that only neighbours meet.
    """
    own = rows.withColumn("bin", F.floor(F.col("x") / reach))
    near = own.groupBy("page", "bin", F.col("x").alias("x2")).agg(F.max("right").alias("far"))
    spread = near.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    hit = own.join(spread, ["page", "bin"]).filter(F.abs(F.col("x") - F.col("x2")) <= reach)
    return hit.groupBy("page", "line").agg(F.first("text").alias("text"), F.first("right").alias("right"), F.max("far").alias("edge"))


def running_right(rows: DataFrame, by: tuple[str, ...] = ("page", "paragraph")) -> DataFrame:
    """``rows`` with ``so_far``: the furthest right edge of a paragraph's lines up to each."""
    w = Window.partitionBy(*by).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("so_far", F.max("right").over(w))


def room(rows: DataFrame, least: float = 0.85) -> DataFrame:
    """Lines with ``room`` (what is free up to the column's edge) and ``open``: whether the line ends well before it, so that the margin is open."""
    return rows.withColumn("room", F.greatest(F.lit(0.0), F.col("edge") - F.col("right"))).withColumn("open", F.col("right") < least * F.col("edge"))


def edited_fragments(fragments: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """``fragments(key, ix, start, end, str)`` of a text with ``edits(key, start, end, dst)`` carried back to them: ``key``, ``ix``, ``str``.

    Of the fragments that an edit covers the first takes the new text, the others lose what is covered. Edits don't overlap.
    """
    hit = overlapping(fragments.select(key, "ix", "start", "end"), edits, key)
    first = Window.partitionBy(key, "start2").orderBy("start")
    hit = hit.withColumn("new", F.when(F.row_number().over(first) == 1, F.col("dst")).otherwise(""))
    a, b = F.greatest("start", "start2") - F.col("start"), F.least("end", "end2") - F.col("start")
    per = hit.groupBy(key, "ix").agg(F.sort_array(F.collect_list(F.struct(a.alias("a"), b.alias("b"), "new"))).alias("cuts"))
    done = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    grown = lambda acc, e: F.struct(e["b"].cast("int").alias("at"), F.concat(acc["out"], F.substring("str", acc["at"] + 1, e["a"].cast("int") - acc["at"]), e["new"]).alias("out"))
    made = F.aggregate("cuts", done, grown, lambda acc: F.concat(acc["out"], F.substring("str", acc["at"] + 1, F.length("str"))))
    return fragments.select(key, "ix", "str").join(per, [key, "ix"], "left").select(key, "ix", F.when(F.col("cuts").isNull(), F.col("str")).otherwise(made).alias("str"))
