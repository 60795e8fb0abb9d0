"""Writers of runs, explorations, knowledge bases and seeds.

What a later run replaces is partitioned by run or seed and overwritten by
partition, so re-running a seed touches its own files alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType

from ..operators import coverage, knowledge, traces


def _by_partition(df: DataFrame, path: str, key: str) -> None:
    # One file or a few for each key: rows of a key are dealt by a salt too, so none fills a task.
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, MapType)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(8)))
    salted.repartition(key, "_salt").drop("_salt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def export_runs(steps: DataFrame, runs: DataFrame, path: str, created_at, streamed: bool = False, settings: DataFrame | None = None) -> None:
    """manifest, configuration, stats, traces, supervised and trajectories of all runs, below ``path``."""
    _by_partition(traces.traces(steps, streamed), f"{path}/traces", "run_id")
    _by_partition(traces.supervised(steps), f"{path}/supervised", "run_id")
    _by_partition(traces.trajectories(steps, streamed), f"{path}/trajectories", "run_id")
    export_summaries(steps, runs, path, created_at, settings)


def export_summaries(steps: DataFrame, runs: DataFrame, path: str, created_at, settings: DataFrame | None = None) -> None:
    """What is known once the steps of a run have been streamed: manifest, configuration (``settings``, or the corpus alone) and statistics."""
    _by_partition(traces.manifest(steps, runs, created_at), f"{path}/manifest", "run_id")
    _by_partition(traces.run_stats(steps), f"{path}/stats", "run_id")
    _by_partition(traces.run_config(steps, "") if settings is None else settings, f"{path}/config", "run_id")


def export_explorations(explorations: DataFrame, path: str) -> None:
    """The log and the coverage of each seed, and the summaries over all seeds that the log then has."""
    _by_partition(explorations, f"{path}/explorations", "seed_id")
    log = explorations.sparkSession.read.schema(explorations.schema).json(f"{path}/explorations")
    _by_partition(coverage.documents_by_seed(explorations), f"{path}/documents_by_seed", "seed_id")
    rows = coverage.per_iteration(log)
    rows.write.mode("overwrite").json(f"{path}/coverage")
    coverage.seed_summary(rows).write.mode("overwrite").json(f"{path}/coverage_by_seed")
    coverage.global_summary(rows).write.mode("overwrite").json(f"{path}/coverage_summary")
    coverage.document_frequency(log).write.mode("overwrite").json(f"{path}/documents_retrieved")
    coverage.queries_explored(log).write.mode("overwrite").json(f"{path}/queries_explored")
    coverage.exploration_summary(log).write.mode("overwrite").json(f"{path}/summary")


def export_knowledge(kb: DataFrame, path: str) -> None:
    _by_partition(kb, f"{path}/knowledge_base", "seed_id")
    whole = kb.sparkSession.read.schema(kb.schema).json(f"{path}/knowledge_base")
    knowledge.stats(whole).write.mode("overwrite").json(f"{path}/knowledge_base_stats")


def write_seeds(seeds: DataFrame, path: str, dataset: str, split: str) -> None:
    """Selected seeds as JSON lines in one file; they are a chosen, bounded number."""
    seeds.select("query", F.lit(dataset).alias("dataset"), F.lit(split).alias("split")).coalesce(1).write.mode("overwrite").json(path)


def record_completed(spark: SparkSession, samples: DataFrame, path: str) -> None:
    """Adds completed samples to a run's ledger; ``operators.traces.pending`` reads it."""
    samples.select("sample_id", F.lit("running").alias("status"), F.lit(True).alias("completed")).write.mode("append").json(path)
