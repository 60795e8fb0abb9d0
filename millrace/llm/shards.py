"""Groups of rows with a common key that are few enough to be looked at together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import written


def shared_groups(keyed: DataFrame, member: str, largest: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the keys that have 2 to ``largest`` rows, and those of the keys that have more.

    Keys are counted with partial sums, so a key that very many rows have
    costs its tasks one row each. Of keys with the same members one stays.
    """
    by = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(member)).alias("x"), F.bit_xor(F.xxhash64(member, F.lit(1))).alias("y"))
    by = by.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("k"))
    by = written(by.select("k", "n"), "shared")
    held = keyed.join(by, F.col("key") == F.col("k"))
    return held.where(F.col("n") <= largest).drop("k", "n"), held.where(F.col("n") > largest).drop("k", "n")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come in order of the first column, cut so that no group is split; only a batch and one group are held."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or held and key[0] != last:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)


def pair_groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of three or more equal keys, and the places of the rows of each run of two."""
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.append(heads[1:], len(key))
    two, more = ends - heads == 2, ends - heads > 2
    return heads[more], ends[more], heads[two], heads[two] + 1
