"""Processing of evidence: filter, dedup, extract, rerank. Evidence is kept in order of ``pos`` in each query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import tokens
from ..sources.shared import written
from .retrieval import PLACES, first_k, numbered

_BY = ["query_id"]
OKAPI_K1, OKAPI_B, OKAPI_EPSILON = 1.5, 0.75, 0.25


def _head(evidence: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    kept = first_k(evidence, _BY, order or [F.col("pos")], n, "_rank")
    return kept.withColumn("pos", F.col("_rank") - 1).drop("_rank")


def filtered(evidence: DataFrame, min_length: int = 30, max_length: int = 10_000, min_score: float = 0.0, max_results: int = 15) -> DataFrame:
    """By length and score (a missing score is 1), then the first ``max_results``."""
    size = F.length("text")
    fits = size.between(min_length, max_length) & (F.coalesce("score", F.lit(1.0)) >= min_score)
    return _head(evidence.where(fits), max_results)


def deduplicated(evidence: DataFrame, method: str = "text_prefix", prefix_length: int = 50, max_results: int = 20) -> DataFrame:
    """The first piece of each prefix (or each whole text), then the first ``max_results``."""
    key = F.substring("text", 1, prefix_length) if method == "text_prefix" else F.col("text")
    firsts = first_k(evidence.withColumn("_key", key), [*_BY, "_key"], [F.col("pos")], 1, "_first")
    return _head(firsts.drop("_key", "_first"), max_results)


def extracted(evidence: DataFrame, max_spans: int = 20) -> DataFrame:
    return _head(evidence, max_spans)


def simple_scores(evidence: DataFrame) -> DataFrame:
    """With rerank_score: 0.7 of the score (missing: 0.5) and 0.3 of the closeness to the front."""
    sizes = evidence.groupBy(F.col("query_id").alias("_q")).agg(F.count("*").alias("_size"))
    placed = numbered(evidence, _BY, ["pos"], name="_place").join(sizes, F.col("query_id").eqNullSafe(F.col("_q")))
    score = 0.7 * F.coalesce("score", F.lit(0.5)) + 0.3 * (1 - F.col("_place") / F.col("_size"))
    return placed.withColumn("rerank_score", score).drop("_q", "_size", "_place")


def okapi_scores(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """With rerank_score: Okapi BM25 of the query over the query's own evidence.

    Counts, lengths and document frequencies are those of each query's
    evidence; a negative idf is replaced by a quarter of the mean idf; terms
    that a query repeats count as often.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = written(asked, "asked")  # small tables are written so that Spark knows their size and may send them to the words
    own = written(asked.groupBy("query_id").agg(F.collect_set("term").alias("own")), "own")
    # The texts are read once: each piece's terms, and those of its query as often as they come, counted in the piece's own row.
    words = evidence.select("query_id", "pos", tokens(F.col("text")).alias("words")).join(own, "query_id", "left")
    hits = F.filter("words", lambda w: F.array_contains("own", w))
    counted = written(words.select("query_id", "pos", F.size("words").alias("dl"), F.array_distinct("words").alias("terms"), hits.alias("hits")), "counted")
    sets = written(counted.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("dl").alias("mean")), "sets")
    df = counted.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("df"))
    df = written(df, "df").join(sets, "query_id").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.groupBy("query_id").agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, OKAPI_EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    weighed = written(asked.join(df, ["query_id", "term"]).join(mean, "query_id").select("query_id", "term", "times", idf.alias("idf"), "mean"), "weighed")
    tf = counted.select("query_id", "pos", "dl", F.explode("hits").alias("term")).groupBy("query_id", "pos", "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (OKAPI_K1 + 1) / (F.col("tf") + OKAPI_K1 * (1 - OKAPI_B + OKAPI_B * F.col("dl") / F.col("mean")))
    scores = tf.join(weighed, ["query_id", "term"]).groupBy("query_id", "pos").agg(F.sum(part).alias("rerank_score"))
    return evidence.join(scores, ["query_id", "pos"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))


def reranked(evidence: DataFrame, queries: DataFrame, method: str = "cross_encoder", top_k: int = 20, cross_encoder: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The best ``top_k`` by the method's score (rounded); ties keep their order. An unknown method is ``simple``.

    ``cross_encoder`` scores (query, text); without one that method raises.
    """
    if method == "cross_encoder":
        if cross_encoder is None:
            raise ValueError("the cross_encoder method needs a model; pass cross_encoder")
        scored = evidence.join(queries.select("query_id", "query"), "query_id").withColumn("rerank_score", cross_encoder(F.col("query"), F.substring("text", 1, 512))).drop("query")
    else:
        # Places and scores decide; texts meet the few that are left.
        scored = okapi_scores(evidence.select("query_id", "pos", "text"), queries).drop("text") if method == "bm25" else simple_scores(evidence.select("query_id", "pos", "score"))
        scored = scored.withColumn("rerank_score", F.round("rerank_score", PLACES))
        top = _head(scored.withColumn("_at", F.col("pos")), top_k, [F.desc("rerank_score"), F.col("pos")])
        top = top.select(F.col("query_id").alias("_q"), "_at", F.col("pos").alias("_pos"), "rerank_score")
        met = evidence.join(top, F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("pos") == F.col("_at")))
        return met.withColumn("pos", F.col("_pos")).drop("_q", "_at", "_pos")
    scored = scored.withColumn("rerank_score", F.round("rerank_score", PLACES))
    return _head(scored, top_k, [F.desc("rerank_score"), F.col("pos")])


def rerank_narrative(reranked_evidence: DataFrame) -> DataFrame:
    """(query_id, narrative): the three best scores with the beginnings of their texts."""
    line = F.format_string("%.4f: %s", F.col("rerank_score"), F.substring("text", 1, 80))
    top = F.slice(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), 1, 3)
    return reranked_evidence.groupBy("query_id").agg(F.concat_ws("\n", F.transform(top, lambda x: x["line"])).alias("narrative"))


def counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, original_count, kept_count, removed); what truncation cut off counts as removed."""
    a = before.groupBy("query_id").agg(F.count("*").alias("original_count"))
    b = after.groupBy("query_id").agg(F.count("*").alias("kept_count"))
    kept = F.coalesce("kept_count", F.lit(0))
    return a.join(b, "query_id", "left").select("query_id", "original_count", kept.alias("kept_count"), (F.col("original_count") - kept).alias("removed"))
