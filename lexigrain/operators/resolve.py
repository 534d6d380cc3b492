"""Resolution of decisions by a scorer, with rules where it is silent or unsure.

The scorer is pluggable: a function of candidate texts. The default one is a
smoothed letter-trigram model over the language tables' counts; results of a
stronger one are not comparable with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import best_kind, overlapping

#: Fewer training examples than this of a spelling, and a cue outranks the scorer.
EVIDENCE = 20


def jobs(converted: DataFrame, key: str) -> DataFrame:
    """A row per open choice: ``key``, ``ix``, ``candidates``, ``base`` (what must be beaten), ``conf``."""
    rows = converted.select(key, F.posexplode("converted.decisions").alias("ix", "d")).filter("d.kind = 'choice'")
    return rows.select(key, "ix", "d.candidates", F.coalesce("d.base", "d.pick").alias("base"), "d.conf")


def pick(scores: Column, base: Column, conf: Column) -> Column:
    """The first best option, unless it beats ``base`` by less than ``conf``."""
    best = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
    lead = F.array_max(scores) - F.element_at(scores, base + 1)
    return F.when(lead < conf, base).otherwise(best)


def scored(rows: DataFrame, score: Callable[[list[str]], list[float]]) -> DataFrame:
    """``rows`` with ``scores`` of their candidates; equal candidate lists are scored once."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([[float(x) for x in score(list(c))] for c in lists], dtype=object)

    once = rows.select("candidates").distinct().withColumn("scores", run("candidates"))
    return rows.join(once, "candidates")


def resolved(converted: DataFrame, key: str, score: Callable[[list[str]], list[float]]) -> DataFrame:
    """``key``, ``ix``, ``pick`` of every open choice."""
    return scored(jobs(converted, key), score).select(key, "ix", pick(F.col("scores"), F.col("base"), F.col("conf")).alias("pick"))


def trigram_scorer(grams: dict[str, float], floor: float = -8.0) -> Callable[[list[str]], list[float]]:
    """Log scores of texts from log probabilities of letter trigrams."""

    def score(texts: list[str]) -> list[float]:
        marked = [f"^^{t.lower()}$" for t in texts]
        return [sum(grams.get(m[i : i + 3], floor) for i in range(len(m) - 2)) for m in marked]

    return score


def scorer_of(grams: DataFrame, lang: str, floor: float = -8.0) -> Callable[[list[str]], list[float]]:
    """The trigram scorer of a language's table ``grams(lang, gram, cost)``; costs are tenths of -log10, and there are as many as the listed words have."""
    rows = grams.filter(F.col("lang") == lang).select("gram", "cost").collect()
    return trigram_scorer({r.gram: -r.cost / 10 * math.log(10) for r in rows}, floor)


def settled(c, score: Callable[[list[str]], list[float]]) -> str:
    """The text of one conversion with its open choices decided, as ``resolved`` and ``rendered`` do over tables."""
    own = []
    for i, d in enumerate(c.decisions):
        new = d.pick
        if d.kind == "choice":
            scores = [float(x) for x in score(c.candidates(i))]
            base = d.pick if d.base is None else d.base
            new = base if d.conf is not None and max(scores) - scores[base] < d.conf else scores.index(max(scores))
        own.append(d.options[new])
    undone = lambda d: d.depends is not None and own[d.depends] == c.decisions[d.depends].orig
    return "".join(p if isinstance(p, str) else c.decisions[p].orig if undone(c.decisions[p]) else own[p] for p in c.parts)


def spelling_probability(plain: Column, variant: Column) -> Column:
    """Probability of the second of two spellings from the scores of the texts with each."""
    return 1 / (1 + F.exp(plain - variant))


def name_probability(spans: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """``key``, ``start``, ``end``, ``p``, ``kind`` of spans: the surest token's probability of not being outside a name, and its kind.

    ``tokens(key, start, end, outside, kind)`` has a model's probability of "outside" and the kind it prefers otherwise.
    """
    return best_kind(spans, tokens.withColumn("p", 1 - F.col("outside")).drop("outside"), key)


def eszett(p: Column, rule: Column, fixed: Column, cue: Column, seen: Column, margin: float = 0.1) -> Column:
    """Whether one ss pair is written ß: a fixed rule, an unseen spelling's cue, a sure scorer, or the rule."""
    unseen = cue.isNotNull() & (seen < EVIDENCE)
    sure = F.when(p > 0.5 + margin, True).when(p < 0.5 - margin, False).otherwise(rule)
    return F.when(fixed, rule).when(unseen, cue == 1).when(p.isNull(), rule).otherwise(sure)


def respelt(word: Column, choice: Column) -> Column:
    """``word`` with each of its ss pairs as the booleans of ``choice`` say."""
    parts = F.split(word, "ss", -1)
    marks = F.concat(F.array(F.lit("")), F.transform(choice, lambda c: F.when(c, "ß").otherwise("ss")))
    return F.array_join(F.zip_with(marks, parts, lambda m, p: F.concat(m, p)), "")


def rule_choice(word: Column, rule: Column) -> Column:
    """For each ss pair whether the rule's spelling has ß there; all false where it changed anything else."""
    pairs = F.split(word, "ss", -1)
    n = F.size(pairs) - 1
    only = F.replace(rule, F.lit("ß"), F.lit("ss")) == word
    marks = F.regexp_extract_all(rule, F.lit("(ss|ß)"), F.lit(1))
    none = F.array_repeat(F.lit(False), n)
    return F.when(only & (rule != word), F.transform(marks, lambda m: m == "ß")).otherwise(none)


def named(p: Column, kind: Column, is_eszett: Column, least: float = 0.5, keeps: tuple[str, ...] = ("PER",)) -> Column:
    """Whether a word stays as written since it is a name; spelling is kept for some kinds only."""
    return F.coalesce((p > least) & (~is_eszett | kind.isin(*keeps)), F.lit(False))


def rendered(converted: DataFrame, key: str, picks: DataFrame) -> DataFrame:
    """``key``, ``text`` of all parts with the picked options; a dependent decision follows the one that it hangs on."""
    parts = converted.select(key, F.posexplode("converted.parts").alias("__ix", "p")).select(key, "__ix", F.col("p.fixed").alias("__fixed"), F.col("p.decision").alias("__n"))
    rows = converted.select(key, F.posexplode("converted.decisions").alias("__n", "d")).join(picks.select(key, F.col("ix").alias("__n"), F.col("pick").alias("__new")), [key, "__n"], "left")
    shown = rows.select(key, "__n", F.col("d.depends").alias("__on"), F.col("d.orig").alias("__orig"), F.element_at("d.options", F.coalesce("__new", "d.pick") + 1).alias("__own"))
    head = shown.select(key, F.col("__n").alias("__on"), (F.col("__own") == F.col("__orig")).alias("__undone"))
    shown = shown.join(head, [key, "__on"], "left").select(key, "__n", F.when(F.coalesce("__undone", F.lit(False)), F.col("__orig")).otherwise(F.col("__own")).alias("__shown"))
    joined = parts.join(shown, [key, "__n"], "left").select(key, "__ix", F.coalesce("__fixed", "__shown").alias("__s"))
    return joined.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__ix", "__s"))), lambda x: x["__s"]), "").alias("text"))


def explained(src: Column, dst: Column, options: Column, is_open: Column) -> Column:
    """Why a place reads as it does: a choice over others, spelling, usage of several words, or a word."""
    others = F.filter(options, lambda o: (o != dst) & (F.trim(o) != ""))
    spelling = (F.replace(src, F.lit("ss"), F.lit("ß")) == dst) | (F.replace(dst, F.lit("ß"), F.lit("ss")) == src)
    listed = F.concat(F.lit("chosen over "), F.array_join(F.slice(others, 1, 3), ", "))
    return F.when(is_open & (F.size(others) > 0), listed).when(spelling, "spelling").when(src.contains(" ") | dst.contains(" "), "usage").otherwise("word")


def why(edits: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """``edits(key, start, end, src, dst)`` with ``reason``: what the first decision that overlaps each says of it.

    ``pieces(key, start, end, options, is_open)`` are the decisions as they lie in the text.
    """
    hit = overlapping(edits.select(key, "start", "end"), pieces, key)
    first = hit.groupBy(key, "start", "end").agg(F.min_by(F.struct("options", "is_open"), "start2").alias("d"))
    told = edits.join(first, [key, "start", "end"], "left")
    none = F.array().cast("array<string>")
    return told.select(*edits.columns, explained(F.col("src"), F.col("dst"), F.coalesce("d.options", none), F.coalesce("d.is_open", F.lit(False))).alias("reason"))
