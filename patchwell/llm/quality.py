"""Text quality by Bradley-Terry ranking.

Preference pairs (a document labelled 1 over one labelled 0) train a linear utility: the logistic
loss of the difference of their features, by Newton steps. The cut is the utility at the quantile
of the sample that the share of label 0 gives; scores are a logistic function that is 0.7 there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, held_out, portions

#: Labelled documents the model is fitted on at most (those with the smallest hash of their id), and preference pairs.
SAMPLE, PAIRS = 20_000, 100_000
CUT = 0.7
RIDGE = 1e-3
SYMBOLS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
N_FEATURES = len(SYMBOLS) + 15


def features(text: bytes) -> list[float]:
    """Shares of character classes and symbols, word lengths, repetition; zeros for an empty text."""
    n = len(text)
    if not n:
        return [0.0] * N_FEATURES
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    m = max(len(words), 1)
    upper, lower, digits, high, feeds = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum(), hist[128:].sum(), hist[10]
    counts = Counter(words)
    distinct = len(counts)
    most = max(counts.values(), default=0)
    again = sum(map(eq, words, words[1:]))
    marked = len([1 for w in words if w[-1] < 48 or 57 < w[-1] < 65])
    start = len([1 for w in words if 65 <= w[0] < 91])
    half = words[: m // 2]
    repeat = float(m >= 8 and len(set(half) & set(words[m // 2 :])) / max(len(set(half)), 1))
    shape = [
        upper / max(upper + lower, 1), lower / n, digits / n, high / n, np.log1p(m), np.log1p(n) / 10, (n - m + 1) / m / 10, distinct / m,
        most / m, again / m, marked / m, start / m, feeds / n * 10, repeat, float(m < 5),
    ]
    return [*map(float, shape), *np.log1p(100 * hist[SYMBOLS] / n).tolist()]


def featured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and array x of features."""
    schema = ", ".join([f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep] + ["x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, len(keep)):
            x = pa.array([features(t) for t in as_bytes(batch.column(len(keep)))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], x], [*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


class Model:
    """Weights of the utility, the cut, and the scale of features."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> None:
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.weights, self.cut = np.zeros(N_FEATURES), 0.0
        if not len(x) or good.all() or not good.any():
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        rng = np.random.default_rng(seed)
        d = z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]
        w = self.weights
        for _ in range(30):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = d.T @ p / pairs - RIDGE * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        self.cut = float(np.quantile(z @ w, 1 - good.mean()))

    def score(self, x: np.ndarray) -> np.ndarray:
        u = (x - self.mean) / self.scale @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(u + np.log(CUT / (1 - CUT)), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows of labelled documents that are not held out.

    Null labels and ids with both labels teach nothing. `sample` bounds the labels that are sent out
    as well as the rows that come back, where rows repeat a doc_id.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & ~F.coalesce(held_out(), F.lit(True))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    known = known.filter("quality = other").drop("other").orderBy(*order).limit(sample)
    taught = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").orderBy(*order, "text").limit(sample)
    rows = featured(taught, ("doc_id", "quality")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(-1, N_FEATURES)
    return Model(x, np.array([r["quality"] == 1 for r in rows], bool))


def rate(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.7) for every row of `docs`.

    Null texts are scored as empty ones. Without both labels in the sample every score is 0.7. Rows
    that repeat a doc_id are scored alike; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in portions(batches, 1):
            x = np.array([features(t) for t in as_bytes(batch.column(1))], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
