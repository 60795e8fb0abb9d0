"""Diverse seed queries: clusters by k-means, then picks by quota and marginal relevance."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..operators import clusters as kmeans
from ..sources.shared import written

#: Candidates of a cluster that the driver holds at a time, besides those that it has picked.
HELD = 64


def clustered(vectors: DataFrame, clusters: int = 100, seed: int = 42, starts: int = 10) -> DataFrame:
    """With cluster: k-means over the column ``vector``, the best of several starts; at most as many clusters as distinct rows."""
    centres, _ = kmeans.fitted(vectors, clusters, starts, seed=seed)
    return kmeans.assigned(vectors, centres) if len(centres) else vectors.withColumn("cluster", F.lit(None).cast("int"))


@dataclass
class _Candidate:
    query: str
    vector: np.ndarray
    fresh: set
    listed: int
    distinct: int
    nearest: float | None

    def score(self, weight: float) -> float:
        gain = float(len(self.fresh))
        return gain if self.nearest is None else weight * gain - (1 - weight) * self.nearest


@dataclass
class _Cluster:
    """The best candidates of a cluster when they were read, and the (score, query) that those left in the table can't beat; None where none are left."""

    held: list[_Candidate] = field(default_factory=list)
    beyond: tuple[float, str] | None = (float("inf"), "")


@dataclass
class _Pool:
    """The candidates as a written table, and the picks that it doesn't know of yet.

    Of each candidate the table has query, vector, cluster, the numbers of its
    documents as listed and distinct, fresh (those not seen yet) and nearest,
    the closeness to the picks so far.
    """

    table: DataFrame
    weight: float
    novelty: float
    recent: list[_Candidate] = field(default_factory=list)

    def settle(self) -> None:
        """Writes the table as the recent picks leave it: documents that they brought are seen, in one pass for all of them."""
        if not self.recent:
            return
        context = self.table.sparkSession.sparkContext
        held = context.broadcast((np.array([p.vector for p in self.recent]), {p.query for p in self.recent}, set().union(*(p.fresh for p in self.recent))))

        def updated(frames):
            at, taken, seen = held.value
            for frame in frames:
                frame = frame[~frame["query"].isin(taken)]
                if len(frame):
                    frame = frame.assign(fresh=[[d for d in docs if d not in seen] for docs in frame["fresh"]])
                    close = np.array(frame["vector"].tolist()) @ at.T
                    frame["nearest"] = np.fmax(frame["nearest"].to_numpy(float), close.max(axis=1))
                yield frame

        self.table, self.recent = written(self.table.mapInPandas(updated, self.table.schema), "candidates"), []

    def read(self, names: list) -> dict:
        """The best candidates of the clusters by their present scores: one job for all of them."""
        self.settle()
        old = F.col("distinct") - F.size("fresh")
        gain = F.size("fresh").cast("double")
        score = F.when(F.col("nearest").isNull(), gain).otherwise(self.weight * gain - (1 - self.weight) * F.col("nearest"))
        fit = self.table.where((F.col("listed") > 0) & (old / F.col("listed") <= self.novelty)).withColumn("score", score)
        place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "query"))
        best = fit.where(F.col("cluster").isin(names)).withColumn("place", place).where(F.col("place") <= HELD + 1).drop("place")
        out = {name: _Cluster(beyond=None) for name in names}
        for r in sorted(best.collect(), key=lambda r: (-r["score"], r["query"])):  # HELD of each cluster
            cluster = out[r["cluster"]]
            if len(cluster.held) < HELD:
                cluster.held.append(_Candidate(r["query"], np.array(r["vector"]), set(r["fresh"]), r["listed"], r["distinct"], r["nearest"]))
            else:
                cluster.beyond = (r["score"], r["query"])
        return out

    def picked(self, pick: _Candidate, clusters: dict) -> None:
        """What the driver holds learns of a pick: documents are seen, and closeness grows."""
        self.recent.append(pick)
        for cluster in clusters.values():
            cluster.held = [c for c in cluster.held if c is not pick]
            for c in cluster.held:
                c.fresh = c.fresh - pick.fresh
                close = float(c.vector @ pick.vector)
                c.nearest = close if c.nearest is None else max(c.nearest, close)

    def best(self, cluster: _Cluster) -> _Candidate | None:
        """The best held candidate if none in the table can beat it."""
        fit = [c for c in cluster.held if (c.distinct - len(c.fresh)) / c.listed <= self.novelty]
        top = min(fit, key=lambda c: (-c.score(self.weight), c.query), default=None)
        if top is not None and (cluster.beyond is None or (-top.score(self.weight), top.query) < (-cluster.beyond[0], cluster.beyond[1])):
            return top
        return None


def selected(candidates: DataFrame, prior: DataFrame, num_seeds: int = 1000, novelty: float = 0.6, weight: float = 0.7) -> DataFrame:
    """(pick, query) of candidates (query, vector, cluster, doc_ids) against documents (doc_id) that are known already.

    Clusters take turns in the order of their first query; with n picks made
    the turn is that of number n modulo the clusters left, and a cluster with
    nothing to offer leaves. A candidate is worth its documents that neither
    the known ones nor earlier picks have, weighed against its closeness to
    the picks; one without documents, or with more than ``novelty`` of them
    seen, is passed over.

    Picks are lazily greedy: a candidate's worth can only fall, so the best of a cluster among the
    ``HELD`` that were best at some time is the best of all while it beats the next one's worth of that
    time. Only then is a job needed, which brings the table up to date with all picks since and reads the best of every cluster again. The driver
    holds the picks and HELD candidates for each of a chosen number of clusters.
    """
    docs = F.coalesce("doc_ids", F.array().cast("array<string>"))
    rows = candidates.select("query", F.transform("vector", lambda x: x.cast("double")).alias("vector"), "cluster", docs.alias("doc_ids"))
    fresh = rows.select("query", F.explode(F.array_distinct("doc_ids")).alias("doc_id")).distinct().join(prior.select("doc_id").distinct(), "doc_id", "left_anti")
    fresh = fresh.groupBy(F.col("query").alias("q")).agg(F.collect_list("doc_id").alias("fresh"))
    table = rows.join(fresh, F.col("query") == F.col("q"), "left").select(
        "query", "vector", "cluster", F.size("doc_ids").alias("listed"), F.size(F.array_distinct("doc_ids")).alias("distinct"), F.coalesce("fresh", F.array().cast("array<string>")).alias("fresh"), F.lit(None).cast("double").alias("nearest"),
    )
    pool = _Pool(written(table, "candidates"), weight, novelty)
    turns = [r["cluster"] for r in pool.table.groupBy("cluster").agg(F.min("query").alias("first")).orderBy("first").collect()]  # clusters, a chosen number
    clusters = pool.read(turns)
    picks: list[str] = []
    while turns and len(picks) < num_seeds:
        name = turns[len(picks) % len(turns)]
        pick = pool.best(clusters[name])
        if pick is None and clusters[name].beyond is not None:
            clusters = pool.read(turns)
            pick = pool.best(clusters[name])
        if pick is None:
            turns.remove(name)
            continue
        picks.append(pick.query)
        pool.picked(pick, clusters)
        if len(picks) == 1:
            clusters = pool.read(turns)  # scores of another kind
    return candidates.sparkSession.createDataFrame(list(enumerate(picks, 1)), "pick int, query string")
