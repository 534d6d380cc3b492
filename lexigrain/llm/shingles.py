"""Whole shingle sets behind SimHash: verification of its pairs, and the pairs beyond its bits.

SimHash at few bits finds only the closest copies, and at the 15 % of bits in which
fingerprints of sets alike by 0.8 differ, no chain of segments is selective. So a set
that the fingerprints have linked is verified, and then all sets are
joined: ordered by rarity, two sets reach the threshold only if they
share a shingle among their first few (prefix filter), are of like sizes and have
enough shingles left from there on (positional filter). Parity maps, of 256 bits and then of
2048 or as many as the set is large, bound the symmetric difference; what is left is verified
on the whole sets.

Only the classes are wanted, so large groups are not paired whole: first each set
meets its fingerprint's neighbours and the least and the greatest set of each posting, then
all pairs of a posting that lie in different classes are joined. No pair that could join two
classes is left out. A pair that shares many postings comes out of the join at the first of them,
and again only where it shares none of the last few before.

Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, release
from .components import components
from .setjoin import _need
from .simhash import links as close
from .simhash import voted

#: Words of a shingle, and the Jaccard threshold as a fraction.
WORDS, THRESHOLD = 5, (4, 5)
#: Entries of the rarity table and bytes of the filter of rows to read again: bounds of what goes to the driver and to each task.
SLOTS, FILTER_BYTES = 1 << 16, 1 << 16
#: Larger sets don't meet the ends of postings first; all their pairs are counted.
LARGE = 2000
#: Bits of the parity maps; a set larger than the finer one's has one of the next power of two.
LANES, FINE = 256, 2048
#: Shingles before a posting's that tell whether a pair has met already.
BEFORE = 4


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``words`` words; a shorter text is one run, no word gives none.

    Words are those of ``simhash.fingerprint``.
    """
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split))
    size = min(words, len(split))
    n = len(split) - size + 1
    acc = h[:n].copy()
    for i in range(1, size):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def rarity(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """The rarity class (rarest first) of each slot, from the shingles of all ``docs(text)``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            for x in b["text"]:
                np.add.at(n, (shingles(x, words) & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        at = np.nonzero(n)[0]
        yield pd.DataFrame({"slot": at.astype(np.int32), "n": n[at]})

    table = np.zeros(SLOTS, np.uint8)
    counts = docs.select("text").mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    for r in counts.coalesce(1).toLocalIterator():
        table[r.slot] = int(2 * np.log2(r.n + 1))  # one row per slot at most
    return table


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def sketch_udf(classes: np.ndarray, words: int, threshold: tuple[int, int]) -> Callable[[Column], Column]:
    """``fp`` (hash of the set), ``sim`` (its SimHash), ``n``, ``parity`` and ``fine`` (maps) and ``first`` (the prefix, rarest first)."""
    a, b = threshold

    @F.pandas_udf("fp long, sim long, n int, parity array<long>, fine array<long>, first array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for x in texts:
                s = shingles(x, words)
                n = len(s)
                order = np.lexsort((s, classes[(s & np.uint64(SLOTS - 1)).astype(np.int64)]))
                bits = max(FINE, 1 << max(0, n - 1).bit_length())
                flips = np.bincount((s >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                fine, parity = _packed(flips), _packed(flips.reshape(-1, LANES).sum(0) & 1)
                first = s[order[: n + (-n * a) // b + 1]] if n else s
                out.append((np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64), voted([s], n) if n else 0, n, parity, fine, _signed(first)))
            yield pd.DataFrame(out, columns=["fp", "sim", "n", "parity", "fine", "first"])

    return sketch


def _marked(rows: DataFrame, key: str) -> Column:
    """Whether ``key`` is one of those of ``rows``: a bit map of fixed size, so some others pass too."""
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BYTES * 8))
    bit = F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int"))
    table = bytearray(FILTER_BYTES)
    for r in rows.groupBy(F.floor(slot / 8).cast("int").alias("at")).agg(F.bit_or(bit).alias("v")).coalesce(1).toLocalIterator():
        table[r["at"]] = r.v  # one row per byte at most
    byte = F.conv(F.hex(F.substring(F.lit(bytes(table)), F.floor(slot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (slot % 8).cast("int")) == 1


def _folded(bits: Column, longs: Column) -> Column:
    """A parity map of ``longs`` entries from one of as many or twice as many."""
    return F.when(F.size(bits) > longs, F.zip_with(F.slice(bits, F.lit(1), longs), F.slice(bits, longs + 1, longs), lambda v, w: v.bitwiseXOR(w))).otherwise(bits)


def _sized(n: Column, m: Column, threshold: tuple[int, int]) -> Column:
    """What the sizes of two sets must fulfil."""
    a, b = threshold
    return (n * b >= m * a) & (m * b >= n * a)


def _alike(x: str, y: str, threshold: tuple[int, int]) -> Column:
    """What two rows with ``n`` and ``parity`` must have for their sets to reach the threshold."""
    n, m, p, q = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.parity"), F.col(f"{y}.parity")
    flipped = sum((F.bit_count(p[k].bitwiseXOR(q[k])) for k in range(1, LANES // 64)), F.bit_count(p[0].bitwiseXOR(q[0])))
    return _sized(n, m, threshold) & (flipped <= n + m - 2 * _need(n, m, threshold))


def _alike_fine(x: str, y: str, threshold: tuple[int, int]) -> Column:
    """The same of two rows with ``n`` and ``fine``."""
    n, m, p, q = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.fine"), F.col(f"{y}.fine")
    longs = F.least(F.size(p), F.size(q))  # sets of like sizes have maps of one size or the next
    flipped = F.aggregate(F.zip_with(_folded(p, longs), _folded(q, longs), lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda s, v: s + v)
    return F.when(_sized(n, m, threshold), flipped <= n + m - 2 * _need(n, m, threshold))


def _verified(pairs: DataFrame, rows: DataFrame, each: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """The ``pairs(a, b)`` whose whole sets reach the threshold; ``rows(id, h, text)`` are read again where a pair names them."""

    @F.pandas_udf("array<long>")
    def whole_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_signed(shingles(x, words)) for x in texts], dtype=object)

    maps = each.select("fp", "n", "fine")
    pairs = pairs.join(maps.alias("x"), F.col("a") == F.col("x.fp")).join(maps.alias("y"), F.col("b") == F.col("y.fp"))
    pairs = cut(pairs.filter(_alike_fine("x", "y", threshold)).select("a", "b"))
    named = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    named = cut(each.select("fp", "id", "h").join(named, "fp"))
    there = rows.filter(_marked(named, "h")).withColumnRenamed("id", "own")
    found = there.join(named, (F.col("own").eqNullSafe(F.col("id"))) & (there["h"] == named["h"])).select("fp", "text").dropDuplicates(["fp"])
    whole = cut(found.select("fp", whole_udf("text").alias("words")))
    both = pairs.join(whole.select(F.col("fp").alias("a"), F.col("words").alias("x")), "a").join(whole.select(F.col("fp").alias("b"), F.col("words").alias("y")), "b")
    return both.filter(F.size(F.array_intersect("x", "y")) >= _need(F.size("x"), F.size("y"), threshold)).select("a", "b")


def near_prints(each: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of sets, the greater one first, whose fingerprints ``sim`` are equal or linked.

    Of the sets that share a fingerprint the least stands for all: each of the others
    meets it, and it alone meets those of other fingerprints.
    """
    least = cut(each.groupBy("sim").agg(F.min("fp").alias("least")))
    same = each.join(least, "sim").filter("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    there = least.withColumnsRenamed({"sim": "fp"})
    linked = close(there.select("fp"))
    for c in ("a", "b"):
        linked = linked.join(there.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_")), c)
    return same.unionByName(linked.select(F.greatest("a_", "b_").alias("a"), F.least("a_", "b_").alias("b")))


def meetings(shared: DataFrame, label: DataFrame, sizes: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Pairs ``a``, ``b``, few of them repeated, of sets of different labels that may reach the threshold, the greater one first.

    ``shared`` has ``fp``, ``word`` and ``i``, the word's place in the prefix; a set that ``label(fp, label)`` lacks is its own.
    """
    of_word = Window.partitionBy("word")
    placed = shared.select("word", "fp", "i").join(sizes.select("fp", "n"), "fp").join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    placed = placed.withColumn("lo", F.min("label").over(of_word)).withColumn("hi", F.max("label").over(of_word)).withColumn("least", F.min("n").over(of_word))
    placed = placed.filter((F.col("lo") != F.col("hi")) & (F.col("n") - F.col("i") >= _need(F.col("n"), F.col("least"), threshold)))
    placed = placed.select("word", "fp", "i", "label").join(sizes, "fp")
    ahead = Window.partitionBy("fp").orderBy("i")
    placed = cut(placed.withColumn("before", F.array(*[F.lag("word", k).over(ahead) for k in range(1, BEFORE + 1)])))
    need = _need(F.col("x.n"), F.col("y.n"), threshold)
    places = (F.col("x.n") - F.col("x.i") >= need) & (F.col("y.n") - F.col("y.i") >= need)  # i counts from 0
    fits = (F.col("x.fp") > F.col("y.fp")) & (F.col("x.label") != F.col("y.label")) & places & _alike("x", "y", threshold)
    # Where both have a word of those before, they have met there: its places are lower, so what holds here holds there.
    fits &= ~F.coalesce(F.arrays_overlap("x.before", "y.before"), F.lit(False))
    return placed.alias("x").join(placed.alias("y"), (F.col("x.word") == F.col("y.word")) & fits).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def roots(rows: DataFrame, prints: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``node``, ``root`` of the sets ``fp`` that are linked to others by similarity.

    ``rows`` has ``id``, ``h`` and ``text``, ``prints`` the same ``id`` and ``h`` with the sketch's columns.
    """
    each = cut(prints.dropDuplicates(["fp"]))
    sizes = each.select("fp", "n", "parity")
    found = cut(near_prints(each.select("fp", "sim")))
    postings = each.select("fp", F.posexplode("first").alias("i", "word"))
    of_word = Window.partitionBy("word")
    shared = postings.withColumn("lo", F.min("fp").over(of_word)).withColumn("hi", F.max("fp").over(of_word))
    shared = cut(shared.filter("lo <> hi"))

    ends = shared.select("fp", F.explode(F.array("lo", "hi")).alias("end")).filter("fp <> end")
    ends = ends.select(F.greatest("fp", "end").alias("a"), F.least("fp", "end").alias("b")).distinct()
    ends = ends.join(sizes.alias("x"), F.col("a") == F.col("x.fp")).join(sizes.alias("y"), F.col("b") == F.col("y.fp")).filter(_alike("x", "y", threshold) & (F.col("x.n") <= LARGE) & (F.col("y.n") <= LARGE))
    links = cut(_verified(cut(ends.select("a", "b").unionByName(found).distinct()), rows, each, words, threshold))

    # Equal labels are in one class; different ones may be, which costs pairs but changes nothing.
    label = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.least("a", F.min("b")).alias("label"))
    label = cut(label)
    release(rows.sparkSession)
    for _ in range(2):
        label = label.join(label.select(F.col("a").alias("label"), F.col("label").alias("next")), "label").select("a", F.col("next").alias("label"))
    second = meetings(shared, cut(label).withColumnRenamed("a", "fp"), sizes, threshold).distinct()
    release(rows.sparkSession)
    second = cut(second)
    return components(links.unionByName(_verified(second, rows, each, words, threshold)))


def one_of_each(docs: DataFrame, prints: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with one row left of each class: that of the least id, then of the least hash of its text.

    ``prints`` has ``id``, ``h`` (``xxhash64`` of the text) and ``fp`` of each row,
    ``roots(node, root)`` the classes of those ``fp`` that are linked to others. A
    row is told by id and text, so rows that repeat an id go or stay each by its own class.
    """
    own, h = free_name(docs, "id"), free_name(docs, "h")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("x")
    each = prints.groupBy("fp").agg(first).join(roots.withColumnRenamed("node", "fp"), "fp", "left")  # a row per fingerprint: copies are counted out before
    least = each.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("x").alias("x")).select("x.id", "x.h")
    again = prints.groupBy("id", "h").count().filter("count > 1").select("id", "h", F.lit(True).alias("again"))
    kept = cut(least.alias("l").join(again.alias("r"), F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.h") == F.col("r.h")), "left").select("l.id", "l.h", F.coalesce("again", F.lit(False)).alias("again")))
    kept = kept.select(F.col("id").alias(f"{own}_"), F.col("h").alias(f"{h}_"), "again")
    told = docs.withColumn(h, F.xxhash64(text_col))
    match = lambda k: told.join(k, told[id_col].eqNullSafe(k[f"{own}_"]) & (told[h] == k[f"{h}_"]), "left_semi")
    once = match(kept.filter("NOT again")).unionByName(match(kept.filter("again")).dropDuplicates([id_col, h]))
    return once.select(docs.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """See ``simhash.keep_one``."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    sketch = sketch_udf(rarity(rows, words), words, threshold)
    prints = cut(rows.select("id", "h", sketch("text").alias("s")).select("id", "h", "s.*"))
    return one_of_each(docs, prints.select("id", "h", "fp"), roots(rows, prints, words, threshold), id_col, text_col)
