"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-case words. Items and documents are joined on their
seeds, runs of five words: both sides are hashed by running Karp-Rabin, a bit map of the items'
seeds drops what no item has, and the rest is joined on hash and words. Of each
pair that shares a seed the longest run of words that is free on both sides is
marked, again and again, until none of five words is left (running Karp-Rabin greedy string
tiling, Wise 1993); the longest length that is left is found by bisection over window
hashes. A document leaks an item if tiles cover enough of it, in whatever order its passages come.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, light

SEED, COVERAGE = 5, 0.6
#: The bit map of seeds has so many bits a seed, but 2 to the power of the first at least and of the second at most.
BITS, LEAST_BITS, MOST_BITS = 64, 20, 28
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Rolled:
    """Karp-Rabin hashes, modulo 2**64, of all windows of a sequence of numbers, for any length."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        power = np.ones(n, np.uint64)
        power[1:] = np.cumprod(np.full(max(0, n - 1), _BASE))
        self.back = np.ones(n + 1, np.uint64)
        self.back[1:] = np.cumprod(np.full(n, _INVERSE))
        self.upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])

    def windows(self, length: int) -> np.ndarray:
        n = len(self.upto) - length
        return (self.upto[length:] - self.upto[:n]) * self.back[:n] if n > 0 else np.zeros(0, np.uint64)


def tiles(doc: np.ndarray, item: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, words) of ``length`` words at least; words that the item lacks are negative.

    The longest first; of equally long ones the first of the document, then of the item.
    """
    free = [doc >= 0, np.ones(len(item), bool)]
    rolled = [Rolled(doc), Rolled(item)]

    def windows(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        taken = np.concatenate([[0], np.cumsum(~free[side])])
        at = np.nonzero(taken[n:] == taken[:-n])[0] if n < len(taken) else np.zeros(0, np.int64)
        return at, rolled[side].windows(n)[at]

    def shared(n: int) -> bool:
        return len(np.intersect1d(windows(0, n)[1], windows(1, n)[1])) > 0

    out, top = [], min(len(doc), len(item))
    while top >= length:
        low, high = length - 1, top  # a run of low is shared (or low is too short), none longer than high is
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if shared(mid) else (low, mid - 1)
        n, top = low, low - 1
        if n < length:
            break
        places: dict[int, list[int]] = defaultdict(list)
        for t, h in zip(*map(np.ndarray.tolist, windows(1, n)), strict=True):
            places[h].append(t)
        for d, h in zip(*map(np.ndarray.tolist, windows(0, n)), strict=True):
            if h in places and free[0][d : d + n].all():
                t = next((t for t in places[h] if free[1][t : t + n].all() and np.array_equal(doc[d : d + n], item[t : t + n])), None)
                if t is not None:
                    out.append((d, t, n))
                    free[0][d : d + n] = free[1][t : t + n] = False
    return out


def covered(text: str | None, item: str | None, length: int = SEED) -> tuple[float, int, int]:
    """Coverage of an item by a text, number of tiles, words of the longest; an item of fewer than ``length`` words must occur whole."""
    target = words(item)
    number: dict[str, int] = {}
    there = np.array([number.setdefault(w, len(number)) for w in target], np.int64)
    got = tiles(np.array([number.get(w, -1) for w in words(text)], np.int64), there, min(length, len(target))) if target else []
    return sum(n for *_, n in got) / max(1, len(target)), len(got), max((n for *_, n in got), default=0)


class _Hashes(dict):
    """Word to its 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _item_seeds(items: DataFrame, length: int) -> DataFrame:
    """``item``, ``n``, ``h``, ``run`` of the runs of ``length`` words of ``items(item, text)``; a shorter item is one run."""

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for part in batches:
            out = []
            for item, text in zip(part["item"], part["text"], strict=True):
                found = words(text)
                n = min(length, len(found))
                if n:
                    h = Rolled(np.fromiter(map(known.__getitem__, found), np.uint64, len(found))).windows(n)
                    out += [(item, n, x, " ".join(found[i : i + n])) for i, x in enumerate(h.view(np.int64).tolist())]
            yield pd.DataFrame(out, columns=["item", "n", "h", "run"])

    return items.mapInPandas(seeds, "item long, n int, h long, run string").distinct()


def _seed_map(seeds: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """A bit map of the seeds' hashes, how many bits of a hash it takes, and the seeds' lengths."""
    per = {r.n: r["count"] for r in seeds.groupBy("n").count().collect()}  # a row per seed length
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS * sum(per.values())).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - bits)
    rows = seeds.groupBy(F.floor(slot / 8).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int"))).alias("v")).toPandas()  # a row per byte at most
    table = np.zeros(1 << bits - 3, np.uint8)
    table[rows["at"].to_numpy()] = rows["v"].to_numpy()
    return table, bits, sorted(per)


def _shared(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pairs ``doc``, ``item`` of ``docs(doc, text)`` and items that share a seed."""
    made, bits, lengths = _seed_map(seeds)
    table = docs.sparkSession.sparkContext.broadcast(made)  # 2 to the power MOST_BITS bits at most

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, marks = _Hashes(), table.value
        for part in batches:
            out = []
            for doc, text in zip(part["doc"], part["text"], strict=True):
                said = words(text)
                rolled = Rolled(np.fromiter(map(known.__getitem__, said), np.uint64, len(said)))
                hits = set()
                for n in lengths:
                    h = rolled.windows(n)
                    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
                    for i in np.nonzero(marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)[0].tolist():
                        hits.add((doc, n, int(h[i].view(np.int64)), " ".join(said[i : i + n])))
                out += hits
            yield pd.DataFrame(out, columns=["doc", "n", "h", "run"])

    hits = docs.mapInPandas(found, "doc long, n int, h long, run string")
    return hits.join(light(seeds), ["n", "h", "run"]).select("doc", "item").distinct()


def _keyed(rows: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.xxhash64(id_col, text_col).alias(key), F.col(id_col).alias(f"{key}_id"), F.col(text_col).alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, length: int = SEED, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``doc_id``, ``item_id``, ``coverage``, ``n_tiles``, ``longest`` of each leaked item.

    A document may leak several items; clean documents give no row. Null and
    empty texts and items leak nothing; an item of fewer than ``length`` words
    must occur whole. Of equally long matches the first of the document goes first, then the
    first of the item. Repeated rows give repeated results; rows are told by id and text, so ids
    may repeat or be null. Empty tables give an empty result.
    """
    ours, theirs = _keyed(docs, "doc", id_col, text_col), _keyed(benchmark, "item", item_col, text_col)
    seeds = cut(_item_seeds(theirs.select("item", "text"), length))
    pairs = cut(_shared(ours.select("doc", "text"), seeds))
    both = ours.join(light(pairs), "doc").join(light(cut(theirs.withColumnRenamed("text", "item_text"))), "item").select("doc_id", "item_id", "text", "item_text")
    kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()

    def tiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [(d, i, *covered(text, item, length)) for d, i, text, item in part.itertuples(index=False)]
            yield pd.DataFrame([x for x in found if x[2] >= coverage], columns=["doc_id", "item_id", "coverage", "n_tiles", "longest"])

    return both.mapInPandas(tiled, f"doc_id {kind[0]}, item_id {kind[1]}, coverage double, n_tiles int, longest int")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, length: int = SEED, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that leak no item; other columns are kept as they are."""
    key = free_name(docs, "doc")
    found = leaks(docs.select(F.xxhash64(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, coverage, length, "doc_id", "text", item_col)
    leaking = light(cut(found.select(F.col("doc_id").alias(key)).distinct()))
    return docs.withColumn(key, F.xxhash64(id_col, text_col)).join(leaking, key, "left_anti").select(docs.columns)
