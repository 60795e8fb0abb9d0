"""Scalar functions over trace steps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RETRIEVERS = ("opensearch_retriever", "vector_retriever", "chatnoir_retriever")
PROCESSORS = ("reranker", "filter", "deduplicator", "extractor")
PLANNERS = ("planner", "query_formulator")
SYNTHESIZERS = ("answer_drafter", "finalizer")
VERIFIERS = ("fact_checker", "attribution_gate")
PRICE_PER_THOUSAND = 0.01


def stage(component: Column, streamed: bool = False) -> Column:
    """The workflow stage; planners are ``planning`` in streamed entries and ``initial`` in exported ones."""
    out = F.when(component.isin(*PLANNERS), "planning" if streamed else "initial")
    for names, name in ((RETRIEVERS, "retrieving"), (PROCESSORS, "processing"), (SYNTHESIZERS, "synthesizing"), (VERIFIERS, "verifying")):
        out = out.when(component.isin(*names), name)
    return out.otherwise("unknown")


def _failed(error: Column) -> Column:
    return error.isNotNull() & (error != "")


def reward_exported(error: Column, evidence_count: Column, stop: Column) -> Column:
    return F.when(_failed(error), -0.5).otherwise(1.0) + F.when(evidence_count > 0, 0.2).otherwise(0.0) + F.when(stop == "FINISH", 2.0).otherwise(0.0)


def reward_streamed(error: Column, evidence_count: Column, component: Column) -> Column:
    return F.when(_failed(error), -1.0).otherwise(0.1) + F.when(evidence_count > 0, 0.2).otherwise(0.0) + F.when(component.isin(*SYNTHESIZERS), 0.5).otherwise(0.0)


def evidence_count(data: Column, stored: Column) -> Column:
    """From a step's data as JSON, by the first key that is there (0 counts); else the size of the store."""
    keys = ("retrieved_count", "filtered_count", "reranked_count", "evidence_count")
    return F.coalesce(*(F.get_json_object(data, f"$.{k}").cast("long") for k in keys), F.json_array_length(F.get_json_object(data, "$.subgoals")).cast("long"), stored.cast("long"))


def verdict(success: Column, said: Column) -> Column:
    return F.when(success, F.coalesce(said, F.lit("PROCEED"))).otherwise("FAIL")


def stop_condition(success: Column) -> Column:
    return F.when(success, "CONTINUE").otherwise("ERROR")


def thought(private: Column, said: Column, component: Column) -> Column:
    return F.coalesce(F.nullif(private, F.lit("")), said, F.concat(F.lit("Executed "), component))


def cost(tokens: Column) -> Column:
    return tokens / 1000 * PRICE_PER_THOUSAND
