"""Coverage of exploration: overlaps, novelty and frequencies of documents.

explorations: seed_id, iteration, query, answer, doc_ids, similarity_score,
iterations_taken, evidence_count; one row for each explored query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _seed():
    return Window.partitionBy("seed_id").orderBy("iteration")


def per_iteration(explorations: DataFrame) -> DataFrame:
    """Overlap and Jaccard similarity with the iteration before (0 without one), and documents met so far.

    The running number of distinct documents is a running sum of first
    occurrences, which are found by an aggregation by document.
    """
    docs = F.array_sort(F.array_distinct(F.coalesce("doc_ids", F.array().cast("array<string>"))))
    df = explorations.select("seed_id", "iteration", "query", docs.alias("doc_ids"))
    firsts = df.select("seed_id", "iteration", F.explode("doc_ids").alias("doc")).groupBy("seed_id", "doc").agg(F.min("iteration").alias("iteration"))
    fresh = firsts.groupBy("seed_id", "iteration").agg(F.count("*").alias("fresh"))
    df = df.join(fresh, ["seed_id", "iteration"], "left")
    before = F.coalesce(F.lag("doc_ids").over(_seed()), F.array().cast("array<string>"))
    df = df.withColumn("before", before).withColumn("seed_iteration", F.row_number().over(_seed())).withColumn("cumulative_unique_docs", F.sum(F.coalesce("fresh", F.lit(0))).over(_seed()))
    overlap, union = F.size(F.array_intersect("doc_ids", "before")), F.size(F.array_union("doc_ids", "before"))
    none = F.size("before") == 0
    return df.select(
        "seed_id", "seed_iteration", "iteration", "query", "doc_ids", F.size("doc_ids").alias("docs_count"), F.when(none, 0).otherwise(overlap).alias("overlap_with_prev"),
        F.when(none | (union == 0), 0.0).otherwise(overlap / union).alias("jaccard_with_prev"), "cumulative_unique_docs", (~none).alias("has_prev"),
    )


def seed_summary(coverage: DataFrame) -> DataFrame:
    """Iterations, documents and the mean similarity where the iteration before had documents."""
    return coverage.groupBy("seed_id").agg(F.count("*").alias("iterations"), F.max("cumulative_unique_docs").alias("unique_docs"), F.coalesce(F.avg(F.when(F.col("has_prev"), F.col("jaccard_with_prev"))), F.lit(0.0)).alias("avg_jaccard"))


def global_summary(coverage: DataFrame) -> DataFrame:
    """One row over all seeds; the mean takes every iteration after a seed's first, even after an empty one."""
    documents = coverage.select(F.explode("doc_ids").alias("doc")).agg(F.countDistinct("doc").alias("unique_docs"))
    rows = coverage.agg(F.countDistinct("seed_id").alias("seeds"), F.count("*").alias("iterations"), F.coalesce(F.avg(F.when(F.col("seed_iteration") > 1, F.col("jaccard_with_prev"))), F.lit(0.0)).alias("avg_jaccard"))
    return rows.join(documents)  # one row each


def document_frequency(explorations: DataFrame) -> DataFrame:
    """(doc, frequency, queries_found_in): distinct queries of each seed, summed over seeds, and distinct over all."""
    found = explorations.select("seed_id", "query", F.explode("doc_ids").alias("doc")).distinct()
    by_seed = found.groupBy("doc", "seed_id").agg(F.count("*").alias("n")).groupBy("doc").agg(F.sum("n").alias("frequency"))
    overall = found.groupBy("doc").agg(F.countDistinct("query").alias("queries_found_in"))
    return by_seed.join(overall, "doc")


def documents_by_seed(explorations: DataFrame) -> DataFrame:
    """(seed_id, doc, frequency, queries_found_in): the distinct queries of a seed that found a document, sorted."""
    found = explorations.select("seed_id", "query", F.explode("doc_ids").alias("doc")).distinct()
    return found.groupBy("seed_id", "doc").agg(F.count("*").alias("frequency"), F.array_sort(F.collect_list("query")).alias("queries_found_in"))


def breadth_and_redundancy(explorations: DataFrame) -> DataFrame:
    """Per seed: distinct documents, the share of repeats, and figures of the queries."""
    docs = explorations.select("seed_id", F.explode("doc_ids").alias("doc")).groupBy("seed_id").agg(F.countDistinct("doc").alias("unique_docs"), F.count("*").alias("total_docs"))
    asked = explorations.groupBy("seed_id").agg(F.count("*").alias("queries"), F.avg(F.length("query")).alias("avg_query_length"), (F.countDistinct("query") / F.count("*")).alias("distinct_query_ratio"))
    unique, total = F.coalesce("unique_docs", F.lit(0)), F.coalesce("total_docs", F.lit(0))
    return asked.join(docs, "seed_id", "left").select("seed_id", "queries", "avg_query_length", "distinct_query_ratio", unique.alias("unique_docs"), F.when(total > 0, 1 - unique / total).otherwise(0.0).alias("redundancy"))


def exploration_summary(explorations: DataFrame) -> DataFrame:
    docs = explorations.select(F.explode("doc_ids").alias("doc")).agg(F.countDistinct("doc").alias("unique_docs"))
    rows = explorations.agg(F.count("*").alias("total_explorations"), F.countDistinct("seed_id").alias("seeds"), F.countDistinct("query").alias("unique_queries"))
    return rows.join(docs)  # one row each


def run_aggregate(explorations: DataFrame) -> DataFrame:
    n = F.greatest(F.count("*"), F.lit(1))
    return explorations.groupBy("seed_id").agg(F.sum("iterations_taken").alias("total_iterations"), F.sum("evidence_count").alias("total_evidence"), (F.sum("similarity_score") / n).alias("avg_similarity"))


def queries_explored(explorations: DataFrame) -> DataFrame:
    """(seed_id, queries, total) for each seed, sorted, and a row with a null seed for all of them together."""
    distinct = explorations.select("seed_id", "query").distinct()
    rows = distinct.union(distinct.select(F.lit(None).cast(distinct.schema["seed_id"].dataType), "query").distinct())
    return rows.groupBy("seed_id").agg(F.array_sort(F.collect_list("query")).alias("queries"), F.count("*").alias("total"))


def replaced_by_seed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` without the seeds that ``new`` has, and ``new``."""
    return old.join(new.select("seed_id").distinct(), "seed_id", "left_anti").unionByName(new)


def documents_as_bitmaps(found: DataFrame, by: list[str], doc: str = "doc") -> DataFrame:
    """(*by, bucket, bitmap): the distinct documents of each group; documents are integers from 0. Bitmaps of several groups merge by OR.

    A bucket has 32,768 documents and its bitmap 4 KiB, so no state grows with the documents of a group.
    """
    return found.groupBy(*by, F.bitmap_bucket_number(F.col(doc)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(doc))).alias("bitmap"))


def unique_so_far(bitmaps: DataFrame, key: str = "seed_id", order: str = "iteration") -> DataFrame:
    """(key, order, fresh, unique): documents that no earlier row of the key has, and all so far, from bitmaps by key, order and bucket.

    Within a bucket the running union is a window of ORs, whose count grows by what is new; buckets of a key are summed after that.
    """
    upto = Window.partitionBy(key, "bucket").orderBy(order)
    grown = bitmaps.withColumn("held", F.bitmap_count(F.bitmap_or_agg("bitmap").over(upto)))
    grown = grown.withColumn("new", F.col("held") - F.coalesce(F.lag("held").over(upto), F.lit(0)))
    fresh = grown.groupBy(key, order).agg(F.sum("new").alias("fresh"))
    return fresh.withColumn("unique", F.sum("fresh").over(Window.partitionBy(key).orderBy(order)))


def document_sketches(found: DataFrame, by: list[str], doc: str = "doc", bits: int = 14) -> DataFrame:
    """(*by, sketch): a HyperLogLog sketch of each group's documents, whatever their type; its standard error is about 0.8 / 2^(bits / 2)."""
    return found.groupBy(*by).agg(F.hll_sketch_agg(F.col(doc), F.lit(bits)).alias("sketch"))


def unique_by_sketch(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(*by, unique): estimates for unions of sketches; no ``by`` is all of them together."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique"))
