"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours (large: its greater ones; else: its smaller ones and itself) on its least one.

    The least neighbours are aggregated before their exchange and written, so
    that the join has plain scans on both sides and a hub's rows can be split.
    """
    if large:
        edges = edges.union(edges.select("b", "a"))
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least").withColumnRenamed("a", "u")
    if large:
        met = edges.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        met = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return written(met.where("a <> b").distinct(), "stars")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """For edges (a, b): a row (a, b) for each node a but the least of its component, with that least node b.

    Each round about halves the distances, so the rounds grow with the
    logarithm of the longest path. Only two numbers a round reach the driver.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        edges = _star(_star(edges, large=True), large=False)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
