"""Samples by hash priority: the rows whose hash comes first, of all rows or of each stratum.

Rows are counted by the beginning of their hash, so it is known which stretches of hashes are in the sample and
how many rows of the last one; ranks are needed within stretches alone, and nothing is sorted as a whole however
large the sample is. The same rows give the same sample in any order and partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Hexadecimal digits of a hash that make a stretch.
DIGITS = 4


def priority(key: Column, seed: int = 42) -> Column:
    """A row's place in the draw: the MD5 of seed and key, as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def _first(df: DataFrame, key: str, strata: list[str], quota: DataFrame, seed: int) -> DataFrame:
    """The first rows of each stratum by priority, then by all columns' hash; ``quota`` has the strata as _s0, _s1, ... and quota."""
    rows = df.withColumn("_p", priority(F.col(key), seed)).withColumn("_at", F.substring("_p", 1, DIGITS))
    counts = rows.groupBy(*strata, "_at").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*strata).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before)

    def same(names: list[str], other: list[str]) -> Column:
        return reduce(Column.__and__, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(names, other, strict=True)), F.lit(True))

    of = [f"_s{i}" for i in range(len(strata))]
    wanted = counts.join(quota, same(strata, of)) if strata else counts.join(F.broadcast(quota))  # one row
    wanted = wanted.where("_before < quota").select(*(F.col(c).alias(f"_w{i}") for i, c in enumerate(strata)), F.col("_at").alias("_to"), "_before", "quota")
    held = rows.join(wanted, same([*strata, "_at"], [*(f"_w{i}" for i in range(len(strata))), "_to"]))
    place = F.row_number().over(Window.partitionBy(*strata, "_at").orderBy("_p", F.xxhash64(*df.columns)))
    return held.withColumn("_place", place + F.col("_before")).where("_place <= quota").select(*df.columns)


def drawn(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows, or all if there are fewer; ties in priority (rows with one key) by all columns' hash."""
    return _first(df, key, [], df.sparkSession.createDataFrame([(size,)], "quota long"), seed)


def quotas(counts: DataFrame, stratum: str, size: int) -> DataFrame:
    """(stratum, n, quota) from (stratum, n): shares of ``size`` by n, rounded down, and one more for the largest remainders, ties by stratum; ``size`` in all, or all rows if there are fewer."""
    total = counts.agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(total)).withColumn("size", F.least(F.lit(size).cast("long"), F.col("total")))  # one row
    share = share.withColumn("whole", F.expr("size * n div total")).withColumn("rest", F.expr("size * n % total"))
    left = share.agg((F.max("size") - F.sum("whole")).alias("left"))
    # Fewer strata than rows wanted have a remainder: the first of them by remainder, not all strata, meet in one task.
    ranked = share.where("rest > 0").orderBy(F.desc("rest"), stratum).limit(max(size, 1)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("rest"), stratum)))
    more = ranked.join(F.broadcast(left)).where("place <= left").select(F.col(stratum).alias("_s"), F.lit(1).alias("more"))
    return share.join(more, F.col(stratum).eqNullSafe(F.col("_s")), "left").select(stratum, "n", (F.col("whole") + F.coalesce("more", F.lit(0))).alias("quota"))


def stratified(df: DataFrame, key: str, stratum: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows, of each stratum its share by rows, exactly as ``quotas`` says. A null stratum is one too."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("n"))
    quota = quotas(counts, stratum, size).select(F.col(stratum).alias("_s0"), "quota")
    return _first(df, key, [stratum], quota, seed)
