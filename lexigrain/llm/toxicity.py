"""Toxicity: a logistic model kept indifferent to who is named.

A word has hashed features: the word, its beginnings, its character n-grams. A
text is their mean over its words, so its length doesn't matter. The features
that tell the classes apart best are chosen by their likelihood ratio over the
labelled sample. Training then swaps identity
terms in the labelled texts for others of their kind and penalises the squared
change of the logit (counterfactual logit pairing, Garg et al. 2019), so that a
group's name can't carry the score that its contexts have earned.

Which terms are swapped: a list of names of groups, and what the labelled texts
themselves show to be neutral, terms that both classes use alike and often. Terms are
of one kind if they stand between the same neighbours, so that one can replace the other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled
from .common import cut

FOLD = (4, 2)
#: Labelled documents of each class that the model is fitted on, at most.
ROWS = 3000
THRESHOLD = 0.3
SPACE, CHOSEN = 1 << 18, 2048
PENALTY = 4.0
#: Swaps of a text that training sees, at most: those of the least hashes.
SWAPS = 6
#: Neutral terms, and frequent neighbours by which they are compared, at most; the share of each class's texts that must
#: have the term, how far its shares in the classes may differ (as a log), and how like the neighbours of a kind must be.
TERMS, SIGNPOSTS, SPREAD, NEUTRAL, LIKE = 64, 256, 0.05, 0.15, 0.6
#: A feature of this share of a long text's words has the value 1; a text counts as so many words longer.
SHARE, GROWN = 0.02, 20
_WORD = re.compile(r"\w+")
#: Terms that name groups of people, by kind; a swap stays within a kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "christen", "muslime", "juden", "chrétiens", "musulmans", "juifs", "cristianos", "musulmanes", "judíos"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "schwul", "lesbisch", "homosexuel", "lesbienne"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("immigrants", "refugees", "foreigners", "locals", "migranten", "flüchtlinge", "ausländer", "immigrés", "réfugiés", "inmigrantes", "refugiados"),
    ("blind", "deaf", "disabled", "autistic", "elderly", "young"),
)


def own_feature(word: str) -> int:
    """The feature of the whole word."""
    return xxhash.xxh32_intdigest(f"^{word}$".encode(), 2) % SPACE


def word_features(word: str) -> set[int]:
    raw = f"^{word}$".encode()
    digest, n = xxhash.xxh32_intdigest, len(raw)
    out = {digest(raw[:i], 1) % SPACE for i in range(4, min(n, 11))}  # beginnings
    out.update([digest(raw[i : i + 4]) % SPACE for i in range(n - 3)])
    out.update([digest(raw[i : i + 5]) % SPACE for i in range(n - 4)])
    out.add(own_feature(word))
    return out


class _Words(dict):
    """Word to what ``f`` makes of it; forgets all when it has grown large."""

    def __init__(self, f: Callable):
        super().__init__()
        self.f = f

    def __missing__(self, word: str):
        if len(self) > 250_000:
            self.clear()
        v = self[word] = self.f(word)
        return v


def _slots_of(slots: np.ndarray) -> _Words:
    def own(word: str) -> list[int]:
        got = slots[list(word_features(word))]
        return got[got >= 0].tolist()

    return _Words(own)


def words(text: str) -> list[str]:
    """Lower-case words in order; a word said several times in a row counts once."""
    return [w for w, _ in groupby(_WORD.findall(text.lower()))]


def swaps(found: list[str], identity: Iterable[tuple[str, ...]] = IDENTITY) -> list[list[str]]:
    """The text's words with its identity terms of a kind replaced, once for each other term of the kind."""
    out, there = [], set(found)
    for kind in identity:
        mine = there.intersection(kind)
        for new in kind if mine else ():
            if mine != {new}:
                out.append([new if w in mine else w for w in found])
    return out


def options(counts: dict[str, int], kinds: Iterable[tuple[str, ...]], seed: str) -> list[tuple[list[str], str]]:
    """(terms of the text, their replacement) of each swap of ``swaps`` and of leaving a kind out (""), in the order of a hash; SWAPS of them at most."""
    out = []
    for kind in kinds:
        mine = [w for w in kind if w in counts]
        out += [(mine, new) for new in (*kind, "") if mine and mine != [new]]
    return sorted(out, key=lambda s: xxhash.xxh64_intdigest(f"{seed}:{s[1]}"))[:SWAPS]


def change(counts: dict[str, int], swap: tuple[list[str], str], cache: _Words, n_words: int) -> dict[int, float]:
    """By how much each feature's value changes if ``swap`` is made."""
    mine, new = swap
    out: dict[int, float] = {}
    for old in mine:
        for word, sign in ((new, 1), (old, -1)):
            for slot in cache[word] if word else ():
                out[slot] = out.get(slot, 0.0) + sign * counts[old] / (SHARE * (GROWN + n_words))
    return {k: v for k, v in out.items() if v}


def _values(found: list[str], cache: _Words, n: int) -> np.ndarray:
    x = np.zeros(n, np.float32)
    for w in found:
        if v := cache[w]:
            x[v] += 1
    return x / (SHARE * (GROWN + len(found)))


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float
    kinds: tuple[tuple[str, ...], ...] = ()
    #: Swapped texts of the sample, and by how much a swap changes the logit, in the mean.
    swapped: int = 0
    moved: float = 0.0

    def word_weights(self) -> _Words:
        own = {int(f): float(self.weights[s]) for f, s in enumerate(self.slots) if s >= 0}
        return _Words(lambda w: sum(own[f] for f in word_features(w) if f in own))

    def score(self, text: str | None, cache: _Words | None = None) -> float:
        found = words(text or "")
        weight = self.word_weights() if cache is None else cache
        x = self.bias + sum(map(weight.__getitem__, found)) / (SHARE * (GROWN + len(found)))
        return float(1 / (1 + np.exp(-min(30, max(-30, x)))))


@dataclass
class Changes:
    """Feature changes of ``n`` swapped texts: the value at feature ``at`` of text ``row``."""

    n: int
    row: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], minlength=self.n)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        """Of the mean squared change of the logit."""
        return 2 / self.n * np.bincount(self.at, self.value * self.logits(w)[self.row], minlength=len(w))


def fit_weights(x: np.ndarray, y: np.ndarray, changes: Changes, penalty: float = PENALTY, steps: int = 300, decay: float = 2e-3) -> tuple[np.ndarray, float]:
    """Logistic weights by Adam; ``penalty`` weighs the swapped texts' changes of the logit."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = float(y.mean())
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    for t in range(1, steps + 1):
        d = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * cost
        g, gb = x.T @ d + decay * w, d.sum()
        if changes.n and penalty:
            g = g + penalty * changes.gradient(w)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - 0.05 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b = b - 0.05 * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, float(b)


def neutral_kinds(chosen: DataFrame) -> tuple[tuple[str, ...], ...]:
    """Kinds of terms that both classes of ``chosen(text, y)`` use alike and often; a kind's terms have like neighbours."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, list[int]] = {}
        for part in batches:
            for text, y in zip(part["text"], part["y"], strict=True):
                for w in set(words(text)):
                    n.setdefault(w, [0, 0])[y] += 1
        yield pd.DataFrame([(w, *v) for w, v in n.items()], columns=["word", "n0", "n1"])

    totals = {r.y: r["count"] for r in chosen.groupBy("y").count().collect()}  # two rows
    if len(totals) < 2:
        return ()
    known = chosen.mapInPandas(spread, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    known = known.withColumn("n", F.col("n0") + F.col("n1")).withColumn("apart", F.abs(F.log((F.col("n1") + 0.5) / totals[1] / ((F.col("n0") + 0.5) / totals[0]))))
    alike = (F.col("n0") >= SPREAD * totals[0]) & (F.col("n1") >= SPREAD * totals[1]) & (F.col("apart") <= NEUTRAL) & (F.length("word") > 1)
    known = cut(known)
    terms = [r.word for r in known.filter(alike).orderBy(F.desc("n"), "word").limit(TERMS).collect()]
    posts = [r.word for r in known.orderBy(F.desc("n"), "word").limit(SIGNPOSTS).collect()]
    place, post = {w: i for i, w in enumerate(terms)}, {w: i for i, w in enumerate(posts)}

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((len(terms), 2 * len(posts)), np.int64)
        for part in batches:
            for text in part["text"]:
                found = words(text)
                for left, right in zip(found, found[1:]):
                    if right in place and left in post:
                        n[place[right], post[left]] += 1
                    if left in place and right in post:
                        n[place[left], len(posts) + post[right]] += 1
        term, at = np.nonzero(n)
        yield pd.DataFrame({"term": term, "at": at, "n": n[term, at]})

    seen = np.zeros((len(terms), 2 * len(posts)))
    for r in chosen.select("text").mapInPandas(beside, "term int, at int, n long").groupBy("term", "at").agg(F.sum("n").alias("n")).collect():  # TERMS x 2 SIGNPOSTS at most
        seen[r.term, r.at] = r.n
    seen = np.sqrt(seen / np.maximum(seen.sum(1, keepdims=True), 1))
    kinds: list[list[int]] = []
    for i in range(len(terms)):
        near = [(float(seen[i] @ seen[k[0]]), k) for k in kinds]
        best = max(near, key=lambda x: x[0], default=(0.0, None))
        if best[0] >= LIKE:
            best[1].append(i)
        else:
            kinds.append([i])
    return tuple(tuple(terms[i] for i in k) for k in kinds if len(k) > 1)


def _choose(chosen: DataFrame, most: int, kinds: Iterable[tuple[str, ...]] = ()) -> np.ndarray:
    """Slot of each feature, -1 where it is neither among the ``most`` that tell the classes apart best nor that of a whole term of ``kinds``."""
    swapped = np.zeros(SPACE, bool)
    for term in {w for kind in kinds for w in kind}:
        swapped[own_feature(term)] = True

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, seen = np.zeros((2, SPACE), np.int64), _Words(word_features)
        for part in batches:
            for text, y in zip(part["text"], part["y"], strict=True):
                own: set[int] = set()
                for w in set(words(text)):
                    own |= seen[w]
                n[y, list(own)] += 1
        at = np.nonzero(n.sum(0))[0]
        yield pd.DataFrame({"feature": at, "n0": n[0, at], "n1": n[1, at]})

    totals = {r.y: r["count"] for r in chosen.groupBy("y").count().collect()}
    slots = np.full(SPACE, -1, np.int32)
    if len(totals) < 2:
        return slots
    got = chosen.mapInPandas(counted, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter("n0 + n1 >= 4").toPandas()
    a, b = got["n1"].to_numpy() + 0.5, got["n0"].to_numpy() + 0.5
    na, nb = totals[1] + 1, totals[0] + 1
    both = (a + b) / (na + nb)
    gain = a * np.log(a / na / both) + b * np.log(b / nb / both)
    gain = np.where(a / na > b / nb, gain, gain / 4)  # what marks label 1 comes first
    feature = got["feature"].to_numpy()
    best = np.lexsort((feature, -gain))
    best = best[(np.arange(len(best)) < most) | swapped[feature[best]]]
    slots[feature[best]] = np.arange(len(best))
    return slots


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: tuple[int, int] = FOLD, rows: int = ROWS, penalty: float = PENALTY, identity: Iterable[tuple[str, ...]] = IDENTITY, neutral: bool = True) -> Model:
    """A model of ``label``, fitted on at most ``rows`` documents of each class outside the held-out fold.

    ``identity`` are kinds of terms to swap; with ``neutral`` those that the sample itself
    shows are swapped too, and their features are in the model in any case. What goes to the
    driver is bounded: 2 x ``rows`` texts of CHOSEN values and those of the terms, and SWAPS
    sparse changes of each. Without both classes among the labels
    every text scores 0.5.
    """
    chosen = labelled.sample(docs, labels, label, fold, rows)
    kinds = tuple(map(tuple, identity)) + (neutral_kinds(chosen) if neutral else ())
    slots = _choose(chosen, CHOSEN, kinds)
    n = int(slots.max()) + 1
    if not n:
        return Model(slots, np.zeros(1), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _slots_of(shared.value)
        for part in batches:
            for text, y in zip(part["text"], part["y"], strict=True):
                found = words(text)
                counts = Counter(found)
                x = _values(found, cache, n)
                at = np.nonzero(x)[0]
                swapped = [change(counts, o, cache, len(found)) for o in options(counts, kinds, str(xxhash.xxh64_intdigest(text)))]
                swapped = [c for c in swapped if c]
                yield pd.DataFrame({"y": [y] + [-1] * len(swapped), "at": [at.tolist(), *map(list, swapped)], "value": [x[at].tolist(), *[list(c.values()) for c in swapped]]})

    got = chosen.mapInPandas(featured, "y int, at array<int>, value array<float>").toPandas()
    shared.unpersist()
    own, swapped = got[got["y"] >= 0], got[got["y"] < 0]
    x = np.zeros((len(own), n), np.float32)
    for i, (at, value) in enumerate(zip(own["at"], own["value"], strict=True)):
        x[i, at] = value
    flat = lambda c, kind: np.concatenate([np.asarray(v, kind) for v in swapped[c]]) if len(swapped) else np.zeros(0, kind)
    changes = Changes(len(swapped), np.repeat(np.arange(len(swapped)), [len(v) for v in swapped["at"]]), flat("at", np.int64), flat("value", np.float64))
    w, b = fit_weights(x, own["y"].to_numpy(), changes, penalty)
    return Model(slots, w, b, kinds, changes.n, float(np.abs(changes.logits(w)).mean()) if changes.n else 0.0)


def score_udf(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        cache = m.word_weights()
        for texts in batches:
            yield pd.Series([m.score(t, cache) for t in texts], dtype="float64")

    return score


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``name`` (0 to 1, never null).

    A null text counts as empty; equal texts get equal scores; every row stays.
    """
    return docs.withColumn(name, score_udf(docs, model)(F.col(text_col)))


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")
