"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has its mean and a shrunken covariance: a share POOL of the pooled covariance, then a share RIDGE of a
multiple of the identity. The score is the logistic of the difference of the two log densities (from Mahalanobis
distances by Cholesky factors, computed once for a model) and log priors. The moments are sums over all labelled
training rows, gathered from partial sums of each batch; the driver gets one row for each class and moment.

Null and empty texts have the statistics of an empty text and get a score. Without training rows of both classes,
every score is the share of label 1 among the training rows, 0.5 without any. Repeated labels of a document count
as often as they occur; null labels are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm import textstats as ts
from rivulet.llm.common import map_batches

POOL, RIDGE = 0.2, 0.02
#: Statistics are limited to so many standard deviations from the training mean.
LIMIT = 8.0
N = 13


def statistics(text: str | None) -> list[float]:
    """N transformed statistics: logarithms of lengths and of shares, shares moved off zero first."""
    raw = ts.encode(text)
    words = raw.split()
    classes = ts.class_counts(raw)
    n, chars = max(len(words), 1), max(int(classes.sum()), 1)
    n_lines, n_dup = ts.dup_lines(raw)
    low = raw.lower().split()
    share = lambda x, of, floor=0.002: float(np.log(x / of + floor))
    common = sum(w in ts.WORD_AT for w in low)
    at = {c: classes[i] for i, c in enumerate(ts.CLASSES)}
    return [
        float(np.log1p(len(words))),
        float(np.log1p((chars - at["space"]) / n)),
        share(at["upper"], chars),
        share(at["digit"], chars),
        share(at["stop"], chars),
        share(at["symbol"], chars),
        share(at["beyond"], chars),
        share(n_dup, max(n_lines, 1), 0.02),
        share(ts.repeat_words(words), n, 0.02),
        share(common, n, 0.02),
        share(len(set(low)), n),
        float(np.log1p(n / max(n_lines, 1))),
        share(ts.n_of(raw, b"!|"), chars),
    ]


def features(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep and x, the statistics of the whole text."""
    return map_batches(df, keep, [F.col(text)], "x array<double>", lambda texts: [[statistics(t) for t in texts.to_pylist()]])


@dataclass
class Model:
    prior: float
    mean: np.ndarray | None = None  # of the statistics, for standard units
    scale: np.ndarray | None = None
    centre: tuple[np.ndarray, np.ndarray] | None = None  # by class
    inverse: tuple[np.ndarray, np.ndarray] | None = None  # of the Cholesky factors
    log_det: tuple[float, float] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.centre is None:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.mean) / self.scale, -LIMIT, LIMIT)
        density = [-0.5 * (((z - self.centre[k]) @ self.inverse[k].T) ** 2).sum(1) - 0.5 * self.log_det[k] for k in (0, 1)]
        odds = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def solve(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """The model of count, sum and sum of outer products by class."""
    n = {k: moments[k][0] if k in moments else 0 for k in (0, 1)}
    total = n[0] + n[1]
    prior = (n[1] / total) if total else 0.5
    if min(n.values()) < 2:
        return Model(prior)
    mean = sum(moments[k][1] for k in (0, 1)) / total
    second = sum(moments[k][2] for k in (0, 1)) / total
    # A statistic that hardly varies keeps a scale at which rounding of the sums doesn't matter.
    scale = np.maximum(np.sqrt(np.maximum(np.diag(second) - mean**2, 0)), 1e-3 * (1 + np.abs(mean)))
    centre, covariance = [], []
    for k in (0, 1):
        m = moments[k][1] / n[k]
        centre.append((m - mean) / scale)
        covariance.append((moments[k][2] / n[k] - np.outer(m, m)) / np.outer(scale, scale))
    pooled = (n[0] * covariance[0] + n[1] * covariance[1]) / total
    inverse, log_det = [], []
    for c in covariance:
        c = (1 - POOL) * c + POOL * pooled
        c = (1 - RIDGE) * c + RIDGE * max(np.trace(c) / N, 0.05) * np.eye(N)
        factor = np.linalg.cholesky(c)
        inverse.append(np.linalg.inv(factor))
        log_det.append(2 * float(np.log(np.diag(factor)).sum()))
    return Model(prior, mean, scale, tuple(centre), tuple(inverse), tuple(log_det))


def fit(rows: DataFrame, x: Column, label: Column) -> Model:
    """The model of all rows of whose label is 0 or 1."""

    def make(xs, labels):
        x, y = np.array(xs.to_pylist(), float).reshape(-1, N), np.array(labels.to_pylist())
        out: list[list] = [[None] * len(y), [None] * len(y)]
        for k in (0, 1):
            if (y == k).any():
                part = x[y == k]
                out[0][k if len(y) > 1 else 0] = k
                out[1][k if len(y) > 1 else 0] = np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()]).tolist()
        return out

    used = rows.filter(label.isin(0, 1)).select(x.alias("x"), label.cast("int").alias("y"))
    parts = map_batches(used, [], [F.col("x"), F.col("y")], "k int, m array<double>", make).filter("k is not null")
    got: dict[int, np.ndarray] = {}
    for r in parts.select("k", F.posexplode("m").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        got.setdefault(r["k"], np.zeros(1 + N + N * N))[r["i"]] = r["v"]
    return solve({k: (v[0], v[1 : 1 + N], v[1 + N :].reshape(N, N)) for k, v in got.items()})


def score(df: DataFrame, keep: list[str], model: Model, x: str = "x") -> DataFrame:
    """keep, score double and predicted int (1 from a score of 0.7)."""

    def make(xs):
        s = model.score(np.array(xs.to_pylist(), float).reshape(-1, N))
        return [s, (s >= 0.7).astype(np.int32)]

    return map_batches(df, keep, [F.col(x)], "score double, predicted int", make, rows=8192)
