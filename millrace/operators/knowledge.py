"""The knowledge base: entries of explored queries with their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def entries(explorations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Entries with their evidence as an array in order of position; evidence is cut to 500 characters and its score is 0."""
    piece = F.struct("pos", "id", F.substring("text", 1, 500).alias("text"), "source", F.lit(0.0).alias("score"))
    ordered = F.transform(F.array_sort(F.collect_list(piece)), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["source"].alias("source"), x["score"].alias("score")))
    held = evidence.groupBy("query").agg(ordered.alias("evidence"))
    return explorations.select("seed_id", "iteration", "query", "answer", "doc_ids").join(held, "query", "left")


def stats(kb: DataFrame) -> DataFrame:
    """One row: queries, distinct documents, documents per query."""
    docs = kb.select(F.explode("doc_ids").alias("doc")).agg(F.countDistinct("doc").alias("unique_docs"), F.count("*").alias("_all"))
    n = kb.agg(F.count("*").alias("total_queries"))
    return n.join(docs).select("total_queries", "unique_docs", (F.col("_all") / F.greatest("total_queries", F.lit(1))).alias("avg_docs_per_query"))


def recent_context(kb: DataFrame, most: int = 5) -> DataFrame:
    """(seed_id, context): the last entries, oldest first, as question and beginning of the answer."""
    latest = kb.withColumn("_back", F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("iteration")))).where(F.col("_back") <= most)
    answer = F.coalesce(F.nullif(F.substring("answer", 1, 200), F.lit("")), F.lit("No answer available"))
    line = F.concat(F.lit("Q: "), F.col("query"), F.lit("\nA: "), answer)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("iteration", line.alias("line")))), lambda x: x["line"])
    return latest.groupBy("seed_id").agg(F.array_join(lines, "\n\n").alias("context"))


def asked_before(queries: DataFrame, kb: DataFrame) -> DataFrame:
    """The queries that an entry has, by equality."""
    return queries.join(kb.select("query").distinct(), "query", "left_semi")


def document_index(kb: DataFrame) -> DataFrame:
    """(doc, queries): the distinct queries of each document, sorted."""
    return kb.select("query", F.explode("doc_ids").alias("doc")).distinct().groupBy("doc").agg(F.array_sort(F.collect_list("query")).alias("queries"))


def unexplored(questions: DataFrame, explored: DataFrame) -> DataFrame:
    return questions.join(explored.select("query").distinct(), "query", "left_anti")
