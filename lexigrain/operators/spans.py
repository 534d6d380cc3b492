"""Spans: interval joins, the diff of two texts, alignment, segmentation, decomposition."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

BLOCK = 256


def overlapping(a: DataFrame, b: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Pairs of spans of one key that share a character: all columns of ``a(key, start, end, ...)`` and ``b``, its places as ``start2``, ``end2``.

    Both sides are spread over blocks of the text, so a long text with very many
    spans is many small joins; a pair is kept in the block where it begins.
    """
    cells = lambda s, e: F.sequence(F.floor(s / block), F.floor((F.greatest(e, s + 1) - 1) / block))
    left = a.withColumn("__b", F.explode(cells(F.col("start"), F.col("end"))))
    right = b.withColumnsRenamed({"start": "start2", "end": "end2"}).withColumn("__b", F.explode(cells(F.col("start2"), F.col("end2"))))
    hit = left.join(right, [key, "__b"]).filter((F.col("start") < F.col("end2")) & (F.col("start2") < F.col("end")))
    return hit.filter(F.col("__b") == F.floor(F.greatest("start", "start2") / block)).drop("__b")


def starting_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Spans of ``b`` that start inside one of ``a``."""
    return overlapping(a, b, key).filter((F.col("start2") >= F.col("start")) & (F.col("start2") < F.col("end")))


def enclosing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """For each span of ``b`` the first span of ``a`` that holds it whole."""
    held = overlapping(a, b, key).filter((F.col("start2") >= F.col("start")) & (F.col("end2") <= F.col("end")))
    return held.groupBy(key, "start2", "end2").agg(F.min(F.struct("start", "end")).alias("outer")).select(key, "start2", "end2", "outer.*")


def best_kind(spans: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """For each span the kind and probability of the surest overlapping mark ``marks(key, start, end, kind, p)``."""
    hit = overlapping(spans, marks, key)
    return hit.groupBy(key, "start", "end").agg(F.max_by("kind", F.struct("p", F.struct("kind"))).alias("kind"), F.max("p").alias("p"))


def disagreements(a: DataFrame, b: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Places where two models differ, with the truth: ``a``, ``b``, ``gold``, and who is right."""
    three = a.withColumnRenamed("label", "a").join(b.withColumnRenamed("label", "b"), keys).join(gold.withColumnRenamed("label", "gold"), keys)
    return three.filter("a <> b").withColumn("right", F.when(F.col("a") == F.col("gold"), "a").when(F.col("b") == F.col("gold"), "b"))


# ---- procedures on one text; they depend on order, so they run in Arrow batches

_TOKEN = regex.compile(r"\p{L}+|\d+(?:['’.,]\d+)*|\s+|.", regex.S)


def partings(a: list[str], b: list[str], run: int = 3, reach: int = 40) -> list[tuple[int, int, int, int]]:
    """(i0, i1, j0, j1) of each stretch where two token lists part until the nearest run of ``run`` tokens that they share.

    Nearest is what skips fewest tokens in all, ``reach`` at most on a side, and fewest of
    ``a`` among those. Both lists end in ``run`` equal marks, so that a common end is a run too.
    """
    ends = [None] * run
    grams = lambda x: [tuple(x[k : k + run]) for k in range(len(x) - run + 1)]
    left, right = grams(a + ends), grams(b + ends)
    places: dict[tuple, list[int]] = {}
    for k, g in enumerate(right):
        places.setdefault(g, []).append(k)
    out, i, j = [], 0, 0
    while True:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        if i == len(a) and j == len(b):
            return out
        shared = []
        for x, g in enumerate(left[i : i + reach + 1]):
            there = places.get(g, [])
            k = bisect_left(there, j)
            if k < len(there) and there[k] - j <= reach:
                shared.append((x + there[k] - j, i + x, there[k]))
        _, i1, j1 = min(shared, default=(0, len(a), len(b)))
        out.append((i, i1, j, j1))
        i, j = i1, j1


def changes(old: str, new: str, run: int = 3, reach: int = 40) -> list[tuple[int, int, str, str]]:
    """Edits (start, end, from, to) on ``new``, one for each stretch where the texts part.

    A bare insertion or deletion takes the equal tokens before it along, back to the
    nearest that is no white space, so that each edit shows what was changed.
    """
    a, b = _TOKEN.findall(old), _TOKEN.findall(new)
    place = [0, *accumulate(map(len, b))]
    out = []
    for i0, i1, j0, j1 in partings(a, b, run, reach):
        if not "".join(a[i0:i1]).strip() or not "".join(b[j0:j1]).strip():
            equal = next((k for k in range(min(i0, j0)) if a[i0 - 1 - k] != b[j0 - 1 - k]), min(i0, j0))
            back = next((k + 1 for k in range(equal) if b[j0 - 1 - k].strip()), equal)
            i0, j0 = i0 - back, j0 - back
        out.append((place[j0], place[j1], "".join(a[i0:i1]), "".join(b[j0:j1])))
    return out


EDITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())]))


@F.pandas_udf(EDITS)
def changes_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for old, new in batches:
        yield pd.Series([None if a is None or b is None else [dict(zip(("start", "end", "src", "dst"), e, strict=True)) for e in changes(a, b)] for a, b in zip(old, new, strict=True)], dtype=object)


def split_at_hyphen(old: tuple[str, str], new: str) -> tuple[str, str]:
    """``new`` cut where ``old`` was hyphenated: by the longer of the common beginning and end."""
    first, second = old
    whole = first + second
    head = next((i for i, (x, y) in enumerate(zip(whole, new)) if x != y), min(len(whole), len(new)))
    tail = next((i for i, (x, y) in enumerate(zip(whole[::-1], new[::-1])) if x != y), min(len(whole), len(new)))
    cut = len(first) if head >= len(first) else len(new) - len(second) if tail >= len(second) else min(head, len(new))
    return new[:cut], new[cut:]


def align(text: str, pieces: list[str], mark: str = "##") -> list[tuple[int, int]] | None:
    """Places of word pieces in a text, in order; None where a piece is not found next."""
    out, at, lower = [], 0, text.lower()
    for piece in pieces:
        bare = piece.removeprefix(mark).lower()
        while at < len(text) and text[at].isspace():
            at += 1
        if not lower.startswith(bare, at):
            return None
        out.append((at, at + len(bare)))
        at += len(bare)
    return out


def agreement(truth: list[str], guess: list[str]) -> list[tuple[int, int]]:
    """Pairs of places in the equal blocks of two word lists."""
    blocks = difflib.SequenceMatcher(None, truth, guess, autojunk=False).get_matching_blocks()
    return [(m.a + k, m.b + k) for m in blocks for k in range(m.size)]


#: Letters that link the parts of a compound.
LINKS = ("", "s", "es", "n", "en", "e")


def decomposes(rest: str, words: set[str], least: int = 3) -> bool:
    """Whether a remainder is made of listed words with linking letters between, before or after them."""
    reached = {len(x) for x in LINKS if rest.startswith(x)}  # where a word may begin
    for at in range(len(rest)):
        if at in reached:
            for end in range(at + least, len(rest) + 1):
                if rest[at:end] in words:
                    reached.update(end + len(x) for x in LINKS if rest.startswith(x, end))
    return len(rest) in reached


def decomposable(remainders: DataFrame, words: DataFrame, least: int = 3) -> DataFrame:
    """Distinct ``word`` of ``remainders`` that decompose into words of ``words(word)``, by joins.

    Each stretch of a remainder that may be a listed word is joined to the list; the
    stretches that are listed are then followed from the beginning to the end.
    """
    listed = words.select(F.lower("word").alias("part")).filter(F.length("part") >= least).distinct()
    longest = listed.agg(F.max(F.length("part"))).first()[0]
    asked = remainders.select("word").distinct()
    if not longest:
        return asked.filter(F.lower("word").isin(*LINKS))
    low = F.lower("word")
    starts = asked.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("word") - least))))
    room = F.least(F.lit(longest), F.length("word") - F.col("at"))
    parts = starts.filter(room >= least).withColumn("n", F.explode(F.sequence(F.lit(least), room))).select("word", "at", (F.col("at") + F.col("n")).alias("end"), F.substring(low, F.col("at") + 1, F.col("n")).alias("part"))
    steps = parts.join(listed, "part", "left_semi").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("at", "end"))).alias("steps"))
    follows = lambda end: F.filter(F.array(*[F.when(F.substring(low, end + 1, F.lit(len(x))) == x, end + len(x)) for x in LINKS]), lambda v: v.isNotNull())
    reached = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<at:int,end:int>>")), follows(F.lit(0)), lambda seen, step: F.when(F.array_contains(seen, step["at"]), F.array_union(seen, follows(step["end"]))).otherwise(seen))
    return asked.join(steps, "word", "left").filter(F.array_contains(reached, F.length("word"))).select("word")


def lattice(letters: str, cost: dict[str, float], common: float, longest: int, least: int = 2, short: int = 4) -> list[tuple[int, int, float, bool]]:
    """(start, end, price, rare) of the listed words in run-together letters, in the order of their ends; of short ones the common only."""
    low = letters.lower()
    out = []
    for end in range(least, len(letters) + 1):
        for start in range(max(0, end - longest), end - least + 1):
            price = cost.get(low[start:end])
            if price is not None and (end - start >= short or price <= common):
                out.append((start, end, price, price > common))
    return out


def segment(letters: str, cost: dict[str, float], common: float = 3.5, longest: int = 30, gap: float = 2.0, unlisted: float = 1.6, oov: float = 8.0) -> list[str]:
    """Run-together letters cut into the cheapest words: the least path through the lattice of listed ones.

    A listed word costs what ``cost`` says; the whole may also stay one unlisted
    word, which pays for its length. A word that begins small after another pays
    ``gap``; after a noun that is not common only a common one may; short words must be common.
    """
    if len(letters) < 4:
        return [letters]
    n = len(letters)
    paths: dict[tuple[int, bool], tuple[float, list[str]]] = {(0, False): (0.0, [])}  # to a place, after a noun that is not common or not
    for start, end, price, rare in lattice(letters, cost, common, longest):
        if (start, end) == (0, n):
            continue
        small = start > 0 and not letters[start].isupper()
        for after_noun in (False, True):
            if (start, after_noun) not in paths or (small and after_noun and rare):
                continue
            total, words = paths[start, after_noun]
            step = (total + price + gap * small, [*words, letters[start:end]])
            to = (end, rare and letters[start].isupper())
            if to not in paths or step[0] < paths[to][0]:
                paths[to] = step
    whole = cost.get(letters.lower(), oov + unlisted * n) if n <= longest else float("inf")
    best = min((paths[n, noun] for noun in (False, True) if (n, noun) in paths), key=lambda p: p[0], default=(float("inf"), []))
    return best[1] if best[0] < whole else [letters]


_RUN, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
#: So many spans leave a task at once.
_SPANS = 20_000


def letter_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, word) of every run of letters."""
    for m in _RUN.finditer(text):
        if m[0].isalpha():
            yield m.start(), m.end(), m[0]
        else:  # numerals such as ² are in the run
            yield from ((m.start() + x.start(), m.start() + x.end(), x[0]) for x in _LETTERS.finditer(m[0]))


def word_spans(texts: DataFrame, key: str, text: str = "text", around: int = 0) -> DataFrame:
    """``key``, ``start``, ``end``, ``word`` of every letter run; with ``around`` also ``before`` and ``after``, so many characters of the text on both sides.

    A text is walked through once, where it lies, so no token is shuffled.
    """
    names = ["start", "end", "word"] + ["before", "after"] * bool(around)
    schema = T.StructType([texts.schema[key], *[T.StructField(n, T.LongType() if n in ("start", "end") else T.StringType()) for n in names]])

    def spans(whole: str) -> Iterator[tuple]:
        if not around:
            return letter_runs(whole)
        return ((s, e, w, whole[max(0, s - around) : s], whole[e : e + around]) for s, e, w in letter_runs(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, whole in enumerate(batch.column(1)):
                for span in spans(whole.as_py() or ""):
                    rows.append(i)
                    found.append(span)
                    if len(rows) == _SPANS:
                        yield made(batch, rows, found)
                        rows, found = [], []
            if rows:
                yield made(batch, rows, found)

    def made(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, pa.int64() if n in ("start", "end") else pa.string()) for n, x in zip(names, zip(*found, strict=True), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], [key, *names])

    return texts.select(key, text).mapInArrow(run, schema)
