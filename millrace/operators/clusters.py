"""K-means over a table of vectors: several starts advance together, a pass over the vectors for each round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows that the first centres are chosen from, those whose hash comes first.
SAMPLE = 16_384
#: Numbers in all centres of all starts, which the driver and every task hold.
MOST_NUMBERS = 1 << 24


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centre."""
    return np.maximum(np.square(x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + np.square(centres).sum(axis=1), 0)


def spread_rows(x: np.ndarray, clusters: int, rng: np.random.Generator) -> np.ndarray:
    """First centres among the rows, each with a chance by its squared distance to those before; fewer where rows repeat."""
    picks = [int(rng.integers(len(x)))]
    nearest = distances(x, x[picks])[:, 0]
    while len(picks) < min(clusters, len(x)) and nearest.max() > 1e-12:
        picks.append(int(rng.choice(len(x), p=nearest / nearest.sum())))
        nearest = np.minimum(nearest, distances(x, x[picks[-1:]])[:, 0])
    return x[picks]


def sample(vectors: DataFrame, most: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """At most ``most`` vectors, those whose hash comes first; the same rows in any order give the same sample."""
    picked = vectors.select("vector", F.xxhash64(F.lit(seed), "vector").alias("h")).where("vector is not null").orderBy("h").limit(most)
    return matrix(picked.toArrow().column("vector"))


def _advanced(vectors: DataFrame, starts: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """One round of Lloyd for every start: its new centres, and the squared distances to the old ones.

    A task gives a row for each start and cluster, whatever it reads; a cluster without rows keeps its centre.
    """
    held = vectors.sparkSession.sparkContext.broadcast(starts)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(c.shape) for c in held.value]
        count, far = [np.zeros(len(c)) for c in held.value], [np.zeros(len(c)) for c in held.value]
        for batch in batches:
            x = matrix(batch.column(0))
            for s, centres in enumerate(held.value if len(x) else ()):
                away = distances(x, centres)
                own = away.argmin(axis=1)
                np.add.at(total[s], own, x)
                count[s] += np.bincount(own, minlength=len(centres))
                far[s] += np.bincount(own, away[np.arange(len(own)), own], len(centres))
        rows = [(s, c, float(count[s][c]), float(far[s][c]), total[s][c].tolist()) for s in range(len(total)) for c in np.flatnonzero(count[s]).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())))], names=["start", "cluster", "n", "far", "total"])

    parts = vectors.select("vector").where("vector is not null").mapInArrow(sums, "start int, cluster int, n double, far double, total array<double>")
    whole = parts.select("start", "cluster", "n", "far", F.posexplode("total").alias("i", "x")).groupBy("start", "cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("far").alias("far")).toArrow()
    start, cluster, place, x, n, far = (whole.column(c).to_numpy() for c in ("start", "cluster", "i", "x", "n", "far"))
    out = []
    for s, centres in enumerate(starts):
        on, new = start == s, centres.copy()
        new[cluster[on], place[on]] = x[on] / n[on]
        out.append((new, float(far[on & (place == 0)].sum())))
    return out


def fitted(vectors: DataFrame, clusters: int, starts: int = 10, rounds: int = 25, tolerance: float = 1e-4, seed: int = 42, centres: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Centres of the start with the least inertia, and that inertia. vectors: a column vector.

    The first centres come from a sample, or are ``centres`` alone. A round moves
    all starts in one pass; they end when no centre moves by ``tolerance``. There are
    fewer clusters where rows repeat, and none for an empty table.
    """
    if centres is not None:
        held = [np.asarray(centres, float)]
    else:
        x = sample(vectors, seed=seed)
        if not len(x):
            return np.zeros((0, 0)), 0.0
        held = [spread_rows(x, max(clusters, 1), np.random.default_rng([seed, s])) for s in range(starts)]
    if sum(c.size for c in held) > MOST_NUMBERS:
        raise ValueError("so many starts, clusters and dimensions can't be held by every task")
    inertia = [0.0] * len(held)
    for _ in range(rounds):
        moved = _advanced(vectors, held)
        still = all(len(c) == 0 or np.abs(new - c).max() <= tolerance for c, (new, _) in zip(held, moved, strict=True))
        held, inertia = [m[0] for m in moved], [m[1] for m in moved]
        if still:
            break
    best = int(np.argmin(inertia))
    return held[best], inertia[best]


def assigned(vectors: DataFrame, centres: np.ndarray, name: str = "cluster") -> DataFrame:
    """``vectors`` with the number of the nearest centre, the first of equally near ones; null for a null vector."""
    held = vectors.sparkSession.sparkContext.broadcast(np.asarray(centres, float))

    @F.pandas_udf("int")
    def nearest(column: pd.Series) -> pd.Series:
        on = column.notna()
        out = pd.Series(np.nan, column.index, "float64")
        if on.any():
            out[on] = distances(np.array(column[on].tolist(), float), held.value).argmin(axis=1)
        return out.astype("Int32")

    return vectors.withColumn(name, nearest("vector"))
