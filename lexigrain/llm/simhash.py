"""SimHash near-duplicates, linked by pigeonring filtering.

A fingerprint's 64 bits are four segments of 16 on a ring. If two fingerprints
differ in at most three bits, some segment starts a chain of consecutive
segments whose cumulative differences stay within their share of the budget:
0 bits in the first, at most 1 in two, 2 in three and 3 in all four (pigeonring
principle, Qin and Xiao 2018). The first two limits become an equi-join on 32
bits: index rows carry (start, segment, next segment), probe rows also the
variants with one more bit set in the next segment. The rest of the chain and
the full Hamming distance are checked on the joined rows only.

Three of 64 bits link the closest copies only. Where documents alike by a Jaccard
similarity of their shingles are wanted (``keep_one``), the pairs that the fingerprints
find are verified on the whole sets, and ``shingles`` finds the pairs beyond their bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, joined
from .components import components

SEGMENTS, WIDTH, BUDGET = 4, 16, 3
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, words: int = 3, block: int = 1 << 16) -> int:
    """The signed 64-bit SimHash of a whole text; null is as empty, no word gives 0.

    ASCII letters are lowered; words end at ASCII white space (``bytes.split``
    knows just these six characters); shingles are hashed ``block`` at a time,
    so a very long text needs no more memory than its words.
    """
    split = (text or "").encode().lower().split()
    if not split:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(split) - words + 1)
    return voted((np.fromiter((digest(b" ".join(split[i : i + words]), 42) for i in range(at, min(n, at + block))), np.uint64) for at in range(0, n, block)), n)


def voted(hashes: Iterable[np.ndarray], n: int) -> int:
    """The signed 64 bits that are 1 in over half of ``n`` unsigned hashes, given in blocks."""
    ones = np.zeros(64, np.int64)
    for h in hashes:
        counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048)
        ones += (counts.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, words in batches:
        yield pd.Series([fingerprint(x, n) for x, n in zip(texts, words, strict=True)], dtype="int64")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _turned(fp: Column, start: int) -> Column:
    """The ring read from segment ``start`` on, that segment in the lowest bits."""
    s = start * WIDTH
    return fp if not s else F.shiftrightunsigned(fp, s).bitwiseOR(F.shiftleft(fp, 64 - s))


def _segment(ring: Column, i: int) -> Column:
    return F.shiftrightunsigned(ring, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _chain_holds(x: Column) -> Column:
    """Whether the differences ``x`` (turned, XORed) stay within the chain's budgets."""
    differ = [F.bit_count(_segment(x, i)) for i in range(SEGMENTS)]
    total, holds = differ[0], differ[0] <= BUDGET // SEGMENTS
    for i in range(1, SEGMENTS):
        total = total + differ[i]
        holds = holds & (total <= (i + 1) * BUDGET // SEGMENTS)
    return holds


def links(prints: DataFrame, hot: int = 1000) -> DataFrame:
    """Pairs ``a``, ``b`` of the distinct longs ``fp`` that differ in 1 to 3 bits.

    Where more than ``hot`` fingerprints share a join key, that key's rows are
    joined on 48 bits instead: the chain's third limit, 2 bits in all, is
    enumerated too. No group is ever paired whole, and no link is lost.
    """
    low = F.lit((1 << 2 * WIDTH) - 1)
    ring = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("at"), _turned(F.col("fp"), i).alias("ring")) for i in range(SEGMENTS)])).alias("x")).select("fp", "x.at", "x.ring")
    index = ring.select("at", F.col("ring").bitwiseAND(low).alias("key"), F.col("ring").alias("mine"))
    flips = F.filter(F.sequence(F.lit(WIDTH), F.lit(2 * WIDTH - 1)), lambda b: F.getbit(F.col("ring"), b) == 0)
    variants = F.concat(F.array(F.lit(0).cast("long")), F.transform(flips, lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    probe = ring.select("at", F.col("ring").alias("other"), F.explode(variants).alias("flip")).select(
        "at", F.col("other").bitwiseAND(low).bitwiseXOR(F.col("flip")).alias("key"), "other", "flip")
    crowded = index.groupBy("at", "key").count().filter(F.col("count") > hot).select("at", "key")
    crowded = cut(crowded)
    once = (F.col("flip") != 0) | (F.col("mine") > F.col("other"))
    differ = F.col("mine").bitwiseXOR(F.col("other"))
    calm_index, calm_probe, found = index, probe, []
    if crowded.head(1):
        calm_index, calm_probe = (x.join(crowded, ["at", "key"], "left_anti") for x in (index, probe))
        first, pairs = [1 << i for i in range(WIDTH)], [0]
        pairs += first + [x | y for i, x in enumerate(first) for y in first[:i]]
        third = index.join(crowded, ["at", "key"], "left_semi").select("at", "key", "mine", F.explode(F.array(*map(F.lit, pairs))).alias("turn"))
        third = third.withColumn("third", _segment(F.col("mine"), 2).bitwiseXOR(F.col("turn").cast("long")))
        asked = probe.join(crowded, ["at", "key"], "left_semi").withColumn("third", _segment(F.col("other"), 2))
        found.append(third.join(asked, ["at", "key", "third"]).filter(once & _chain_holds(differ)).select("at", "mine", "other"))
    found.insert(0, calm_index.join(calm_probe, ["at", "key"]).filter(once & _chain_holds(differ)).select("at", "mine", "other"))
    pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    home = lambda c: F.coalesce(*[F.when(F.col("at") == i, _turned(F.col(c), (SEGMENTS - i) % SEGMENTS)) for i in range(SEGMENTS)])
    pairs = pairs.select(home("mine").alias("p"), home("other").alias("q"))
    return pairs.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()


def classes(each: DataFrame) -> DataFrame:
    """``fp``, ``component_id`` for the distinct fingerprints of ``each(fp, first)``; ``first`` is the least id of those that have it."""
    roots = components(links(each.select("fp")))
    linked = cut(each.join(roots.withColumnRenamed("node", "fp"), "fp"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "component_id")
    return each.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (long), ``component_id``.

    Null and empty texts have fingerprint 0 and are linked like any other. Equal
    texts and repeated rows share a class. A null id is kept as a row; it names
    no class unless no member has an id (then ``component_id`` is null). Other
    columns are not read. An empty table gives an empty result.
    """
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint_udf(F.col(text_col), F.lit(words)).alias("fp")))
    each = cut(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    found = joined(prints, classes(each.select("fp", "first")), "fp", each, prints.count())
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: tuple[int, int] | None = None) -> DataFrame:
    """The documents with one row left of each class: that of the least id, then of the least hash of its text.

    Classes are those of the fingerprints of ``words`` words. With a ``threshold`` (a
    fraction) they are the components of the links between texts whose sets of shingles
    have that Jaccard similarity or more; null texts and texts without a word are one class
    then. Rows that repeat an id go or stay each by its own class. Rows without an id stay
    only where their whole class has none, again one of them. An empty table gives an empty
    one; other columns are kept as they are.
    """
    from . import shingles  # it takes this module's fingerprints

    if threshold is not None:
        return shingles.keep_one(docs, id_col, text_col, words, threshold)
    prints = cut(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), fingerprint_udf(F.col(text_col), F.lit(words)).alias("fp")))
    return shingles.one_of_each(docs, prints, components(links(prints.select("fp").distinct())), id_col, text_col)
