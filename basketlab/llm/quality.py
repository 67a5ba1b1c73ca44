"""Quality classifier by positive-unlabelled learning.

Trusted positives (rows labelled 1) and unlabelled text train a small network g with the
non-negative risk estimator: with class prior p, loss l and samples P and U,

    risk = p * mean_P l(g) + max(0, mean_U l(-g) - p * mean_P l(-g))

The second term stands for the risk of the negatives; where a batch makes it negative, its gradient
is turned round so that the fit does not follow the noise. The prior is estimated from the labelled
rows. Features are shares and shapes of the whole text (no id, source, language or label).

Training uses bounded samples: at most about ``POSITIVES`` labelled and ``UNLABELLED`` other texts
are turned into features and collected (``FEATURES`` numbers each). Scores cover every row.

Null and empty texts get features and a score like others. Without any positive label every score
is 0.5. Repeated rows score alike. Labels that are null, or belong to no document, are ignored.
Extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.llm.common import add_columns, byte_list

POSITIVES = 8_000
UNLABELLED = 16_000
HIDDEN = 16
STEPS = 600
BATCH = 4_000

_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
FEATURES = len(_SIGNS) + 17


def features(text: bytes) -> list[float]:
    """Shares of kinds of characters and words, and how much of the text repeats."""
    size = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    per = 1.0 / max(1, size)
    letters = int(counts[65:91].sum() + counts[97:123].sum())
    words = text.split()
    n = len(words)
    each = 1.0 / max(1, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = set(words)
    pairs = set(zip(words, words[1:]))
    plain = sum(map(bytes.isalpha, words))
    out = [
        math.log1p(size),
        math.log1p(n),
        math.log1p(len(lines)),
        float(counts[65:91].sum()) / max(1, letters),
        float(counts[48:58].sum()) * per,
        float(counts[128:].sum()) * per,
        float(counts[:32].sum()) * per,
        float(counts[32]) * per,
        letters * per,
        len(distinct) * each,
        len(pairs) / max(1, n - 1),
        sum(map(eq, words, words[1:])) * each,
        float(lengths.mean()) if n else 0.0,
        float(lengths.std()) if n else 0.0,
        float(lengths.max()) if n else 0.0,
        plain * each,
        len(set(lines)) / max(1, len(lines)),
    ]
    # Signs are rare: their shares are stretched at the low end.
    return out + np.log1p(100.0 * counts[_SIGNS] * each).tolist()


def _matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float32).reshape(-1, FEATURES)


def feature_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    rows = docs.select(F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = list(_matrix(byte_list(batch["text"])))
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float32()))], names=["values"])

    return rows.mapInArrow(run, "values array<float>")


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(self._scaled(x) @ a + b) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_positive_unlabelled(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, seed: int = 1
) -> Network:
    """Minimise the non-negative risk with Adam on the sigmoid of g."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    net = Network(
        mean,
        scale,
        [
            rng.normal(0, 0.3, (both.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, 0.3, HIDDEN),
            np.zeros(1),
        ],
    )
    p, u = net._scaled(positive), net._scaled(unlabelled)
    first = [np.zeros_like(w) for w in net.weights]
    second = [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1):
        x = p[rng.integers(0, len(p), min(BATCH, len(p)))]
        y = u[rng.integers(0, len(u), min(2 * BATCH, len(u)))]
        a, b, c, d = net.weights
        rows = np.concatenate([x, y])
        hidden = np.tanh(rows @ a + b)
        g = hidden @ c + d[0]
        sigmoid = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss_as_negative = -np.log(np.maximum(1 - sigmoid, 1e-9))
        k = len(x)
        negative_risk = loss_as_negative[k:].mean() - prior * loss_as_negative[:k].mean()
        slope = np.zeros(len(rows))
        if negative_risk >= 0:
            slope[:k] = prior / k * (sigmoid[:k] - 1) - prior / k * sigmoid[:k]
            slope[k:] = sigmoid[k:] / (len(rows) - k)
        else:
            slope[:k] = prior / k * sigmoid[:k]
            slope[k:] = -sigmoid[k:] / (len(rows) - k)
        back = slope[:, None] * c * (1 - hidden**2)
        gradient = [rows.T @ back + 1e-4 * a, back.sum(axis=0), hidden.T @ slope + 1e-4 * c, np.array([slope.sum()])]
        rate = 0.02 if step < steps * 2 // 3 else 0.004
        for w, m, v, q in zip(net.weights, first, second, gradient):
            m += 0.1 * (q - m)
            v += 0.001 * (q * q - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(
    docs: DataFrame,
    labels: DataFrame,
    may_train: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    seed: int = 1,
) -> Network | None:
    """Train on a bounded sample; ``may_train`` (over labels) says which labels may be read."""
    known = labels.select(F.col(doc_id).cast("long").alias("__id"), F.col(label).cast("int").alias("__label"))
    known = known.where("__id is not null and __label is not null")
    if may_train is not None:
        known = known.where(may_train)
    totals = known.agg(F.count("*").alias("n"), F.sum("__label").alias("ones")).first()
    if not totals.ones:
        return None
    prior = min(0.99, totals.ones / totals.n)
    share = min(1.0, positives / totals.ones)
    trusted = known.where("__label = 1").sample(False, share, seed).select("__id").distinct()
    slim = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("text"))
    # At most about ``positives`` ids of 8 bytes: small enough to send to every task.
    chosen = slim.join(F.broadcast(trusted), "__id", "left_semi")
    rest = slim.sample(False, min(1.0, unlabelled / max(1, docs.count())), seed + 1)

    def collected(df: DataFrame) -> np.ndarray:
        rows = feature_rows(df).limit(4 * max(positives, unlabelled)).collect()
        return np.array([r["values"] for r in rows], np.float64).reshape(-1, FEATURES)

    p, u = collected(chosen), collected(rest)
    if not len(p) or not len(u):
        return None
    return fit_positive_unlabelled(p, u, prior, seed=seed)


def score(docs: DataFrame, model: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on)."""

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            values = byte_list(batch[text])
            got = np.full(len(values), 0.5) if model is None else model.score(_matrix(values))
            return [pa.array(got), pa.array((got >= 0.5).astype(np.int32))]

        return work

    return add_columns(docs, start, [("score", T.DoubleType()), ("predicted", T.IntegerType())])
