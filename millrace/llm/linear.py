"""Small linear models that are fitted on a bounded sample and carried to the tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F


#: Characters of a text that a sample takes, and of a stretch that it takes of a longer one.
LONGEST, STRETCH = 1 << 15, 512


def stretches(text: Column, longest: int = LONGEST, stretch: int = STRETCH) -> Column:
    """A text of at most ``longest`` characters as it is; of a longer one stretches spread evenly from its first character to its last."""
    count = max(longest // stretch, 2)
    parts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring(text, F.floor(i * (F.length(text) - stretch) / (count - 1)).cast("int") + 1, F.lit(stretch)))
    return F.when(F.length(text) > longest, F.array_join(parts, "\n")).otherwise(text)


def bounded_sample(df: DataFrame, class_col: str, per_class: int, text_col: str | None = None, longest: int = LONGEST) -> list:
    """At most ``per_class`` rows of each class reach the driver, those whose hash comes first; no text is longer than ``longest``.

    Classes are counted first, and rows whose hash can't be among the first
    are dropped where they are read; the rest is ranked, and Spark cuts ranks
    before their exchange. The same rows give the same sample in any order.
    """
    counts = {r[0]: r[1] for r in df.groupBy(class_col).count().collect()}
    limit = F.lit(1 << 30)
    for value, n in counts.items():
        if n > 4 * per_class:
            limit = F.when(F.col(class_col) == value, int(4 * per_class / n * (1 << 30))).otherwise(limit)
    columns = [stretches(F.col(c), longest).alias(c) if c == text_col else F.col(c) for c in df.columns]
    near = df.withColumn("_hash", F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30))).where(F.col("_hash") < limit).select("_hash", *columns)
    rank = F.row_number().over(Window.partitionBy(class_col).orderBy("_hash", *df.columns))
    picked = near.withColumn("_rank", rank).where(F.col("_rank") <= per_class).select(*df.columns)
    return sorted(picked.collect(), key=lambda r: tuple(map(str, r)))


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge), by accelerated gradient.

    x: rows of unit-scale features; y: +1 or -1. Classes count alike, however
    many rows each has.
    """
    n, share = len(y), np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    x = np.hstack((x, np.ones((n, 1), x.dtype)))
    y, share = y.astype(x.dtype), share.astype(x.dtype)
    w = v = np.zeros(x.shape[1], x.dtype)
    step = 1 / (2 * np.square(x).sum(axis=1).max() + penalty)
    for k in range(rounds):
        slack = np.maximum(1 - y * (x @ v), 0)
        grad = x.dtype.type(-2) * ((share * slack * y) @ x) + x.dtype.type(penalty) * v
        new = v - x.dtype.type(step) * grad
        v = new + x.dtype.type(k / (k + 3)) * (new - w)
        w = new
    return w[:-1].astype(np.float64), float(w[-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights (bias last) of a logistic regression on few features, by Newton's method. y: 0 or 1."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
