"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Each token hashes to a bucket with a fixed sparse random index vector. A
bucket's word vector is the sum of the index vectors seen next to it in the
sampled documents (random indexing, Kanerva et al. 2000), plus its own. A text
is the mean of its words' vectors; a network with one hidden layer gives a
logit, and a temperature fitted on a part of the sample that the network has
not seen makes it a calibrated probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled

FOLD = (5, 0)
#: Labelled documents of each class that the model is fitted on, at most.
ROWS = 2000
THRESHOLD = 0.3
DIM, NONZERO, WINDOW, HIDDEN = 48, 4, 2, 32
BUCKETS = 1 << 16
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_REPEAT, _LOUD = "\x00same", "\x00loud"


class _Buckets(dict):
    """Token to bucket; words in capitals share one. Forgets all when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 250_000:
            self.clear()
        loud = len(token) > 1 and token.isupper()
        b = self[token] = xxhash.xxh32_intdigest((_LOUD if loud else token.lower()).encode()) % BUCKETS
        return b


_buckets = _Buckets()


def buckets(text: str) -> np.ndarray:
    """Buckets of a whole text's tokens in order; a word that repeats the last one adds a mark after it."""
    tokens = _TOKEN.findall(text)
    ids = np.fromiter(map(_buckets.__getitem__, tokens), np.int32, len(tokens))
    again = np.nonzero(ids[1:] == ids[:-1])[0] + 1
    return np.insert(ids, again + 1, _buckets[_REPEAT]) if len(again) else ids


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's few non-zero entries."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO)).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh((pooled - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature, -30, 30)))


def pooled(text: str, vectors: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """Mean word vector of a whole text, ``block`` tokens at a time; zeros for no token."""
    ids = buckets(text)
    total = np.zeros(DIM)
    for a in range(0, len(ids), block):
        total += vectors[ids[a : a + block]].sum(0, dtype=np.float32)
    return total / max(1, len(ids))


def contexts(texts: Iterable[str]) -> np.ndarray:
    """For each bucket the sum of the index vectors seen next to it."""
    places, signs = index_vectors()
    out = np.zeros(BUCKETS * DIM, np.float32)
    for text in texts:
        ids = buckets(text).astype(np.int64)
        for d in range(1, WINDOW + 1):
            for mine, other in ((ids[d:], ids[:-d]), (ids[:-d], ids[d:])):
                np.add.at(out, (mine[:, None] * DIM + places[other]).ravel(), signs[other].ravel())
    return out


def word_vectors(chosen: DataFrame, tasks: int = 2, part: int = 1024) -> np.ndarray:
    """Each bucket's vector from ``chosen(text)``, summed in ``tasks`` tasks; as many matrices of fixed size go to the driver, in slices of ``part`` buckets."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = contexts(x for b in batches for x in b["text"])
        for i in range(BUCKETS // part):
            yield pd.DataFrame({"slice": [i], "context": [total[i * part * DIM : (i + 1) * part * DIM].tobytes()]})

    context = np.zeros((BUCKETS // part, part * DIM), np.float64)
    for r in chosen.select("text").coalesce(tasks).mapInPandas(summed, "slice int, context binary").repartition(BUCKETS // part, "slice").collect():
        context[r.slice] += np.frombuffer(r.context, np.float32)
    context = context.reshape(BUCKETS, DIM)
    places, signs = index_vectors()
    out = (context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    np.add.at(out, (np.arange(BUCKETS)[:, None], places), signs / 2)
    return out


def fit_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, epochs: int = 400, decay: float = 1e-3, seed: int = 11) -> Model:
    """The network, by Adam on four fifths of the rows; the temperature on the rest."""
    rng = np.random.default_rng(seed)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else min(0.99, max(0.01, float(y.mean())))
        return Model(vectors, np.zeros(DIM), np.ones(DIM), np.zeros((DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    order = rng.permutation(len(y))
    cal, fit = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    z, t = (x[fit] - mean) / scale, y[fit].astype(float)
    weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-3), 0.5 / max(1 - t.mean(), 1e-3))
    p = [rng.normal(0, DIM**-0.5, (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, epochs + 1):
        h = np.tanh(z @ p[0] + p[1])
        out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30)))
        d = (out - t) * weight / len(t)
        dh = np.outer(d, p[2]) * (1 - h * h)
        grads = [z.T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(cal):
        logit, t = model.logits(x[cal]), y[cal]
        loss = lambda s: np.logaddexp(0, np.where(t == 1, -logit, logit) / s).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] = FOLD, rows: int = ROWS) -> Model:
    """A model of ``label``, fitted on at most ``rows`` documents of each class outside the held-out fold.

    Without labelled rows, or with one class only, every text gets that class's share.
    """
    spark = docs.sparkSession
    chosen = labelled.sample(docs, labels, label, fold, rows)
    vectors = word_vectors(chosen)
    shared = spark.sparkContext.broadcast(vectors)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def pool(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([pooled(x, shared.value) for x in texts])

    got = chosen.select(pool("text").alias("x"), "y").toPandas()
    shared.unpersist()
    x = np.stack(got["x"]) if len(got) else np.zeros((0, DIM))
    return fit_network(x, got["y"].to_numpy(), vectors)


def score_udf(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            x = np.array([pooled(t or "", m.vectors) for t in texts]).reshape(-1, DIM)
            yield pd.Series(m.scores(x))

    return score


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``name`` (0 to 1, never null).

    A null text counts as empty; equal texts get equal scores; every row stays.
    """
    return docs.withColumn(name, score_udf(docs, model)(F.col(text_col)))


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")
