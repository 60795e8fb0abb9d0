"""Planning, synthesis, verification and control: prompts, parsed responses and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

#: Categories of the components (fixed values).
CATEGORIES = {
    "opensearch_retriever": "retrieval",
    "vector_retriever": "retrieval",
    "chatnoir_retriever": "retrieval",
    "reranker": "processing",
    "deduplicator": "processing",
    "filter": "processing",
    "extractor": "processing",
    "planner": "planning",
    "query_formulator": "planning",
    "answer_drafter": "synthesis",
    "finalizer": "synthesis",
    "fact_checker": "verification",
    "attribution_gate": "verification",
    "condition": "control",
}
_NEED_EVIDENCE = ("processing", "synthesis", "verification")


def planned_goals(response: Column, most: int = 3) -> Column:
    """Sub-goals from the part after SUB-GOALS:, or from the whole response."""
    return T.subgoals(T.after_marker(response, "REASONING:", "SUB-GOALS:"), most)


def formulated_queries(response: Column, subgoals: Column, query: Column) -> Column:
    """The response's queries; without any the sub-goals; without sub-goals the query."""
    asked = F.filter(F.from_json(response, "queries array<string>")["queries"], lambda q: ~T.is_blank(q))
    none = F.coalesce(F.size(asked), F.lit(0)) <= 0
    return F.when(F.coalesce(F.size(subgoals), F.lit(0)) <= 0, F.array(query)).when(none, subgoals).otherwise(asked)


def drafted_answer(response: Column) -> Column:
    """The answer after ANSWER:, or the whole response; null if empty."""
    return F.nullif(T.after_marker(response, "REASONING:", "ANSWER:"), F.lit(""))


def evidence_text(evidence: DataFrame, most: int = 10, width: int = 300) -> DataFrame:
    """(query_id, evidence_text, evidence_used): numbered beginnings of the first pieces of evidence."""
    first = evidence.where(F.col("pos") < most)
    line = F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), F.substring("text", 1, width))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    return first.groupBy("query_id").agg(F.array_join(lines, "\n\n").alias("evidence_text"), F.count("*").alias("evidence_used"))


def citations(evidence: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, citation, doc_id, source, text, score): the first pieces, numbered from 1; a missing score is 0."""
    return evidence.where(F.col("pos") < most).select("query_id", (F.col("pos") + 1).cast("long").alias("citation"), F.col("id").alias("doc_id"), "source", F.substring("text", 1, 200).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))


def checked(queries: DataFrame, evidence: DataFrame, draft: Column, need: int) -> DataFrame:
    """(query_id, success, passed, confidence, evidence_count): enough evidence for a draft; need is 3 for facts, 2 for attribution."""
    held = evidence.groupBy("query_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    there = ~T.is_blank(draft)
    return queries.join(held, "query_id", "left").select("query_id", there.alias("success"), F.when(there, n >= need).alias("passed"), F.when(there, F.least(n / 5, F.lit(1.0))).alias("confidence"), n.cast("long").alias("evidence_count"))


def external_verdict(answer: Column) -> dict[str, Column]:
    """An external answer of over ten characters verifies; its confidence is 0.85, else 0.5."""
    ok = F.coalesce(F.length(T.stripped(answer)) > 10, F.lit(False))
    return {"verified": ok, "confidence": F.when(ok, 0.85).otherwise(0.5)}


def realtime_verdict(answer: Column, response: Column, enabled: bool = True) -> dict[str, Column]:
    """verified and flagged: an answer that says it has none is verified; else the verifier's JSON decides; no JSON flags."""
    if not enabled:
        return {"verified": F.lit(True), "flagged": F.lit(False)}
    plain = T.stripped(response)
    body = F.when(plain.startswith("{"), plain).otherwise(F.coalesce(T.bracket_slice(plain, "{", "}"), plain))
    parsed = F.from_json(body, "verified boolean", {"mode": "PERMISSIVE"})
    valid = F.get_json_object(body, "$").isNotNull()
    verified = F.when(T.cannot_answer(answer), True).when(~F.coalesce(valid, F.lit(False)), False).otherwise(F.coalesce(parsed["verified"], F.lit(True)))
    return {"verified": verified, "flagged": ~verified}


def condition(kind: str, value: Column, threshold: float, on_true: str = "continue", on_false: str = "continue") -> dict[str, Column]:
    """value, met and branch: iteration counts are met up to the threshold, the others from it on; an unknown kind is 0 and not met."""
    if kind not in ("threshold", "evidence_count", "iteration_count"):
        value, met = F.lit(0.0), F.lit(False)
    else:
        met = value <= threshold if kind == "iteration_count" else value >= threshold
    return {"condition_value": value, "condition_met": met, "branch_taken": F.when(met, on_true).otherwise(on_false)}


def available(states: DataFrame, components: DataFrame) -> DataFrame:
    """(query_id, component): what a query can run next; states: query_id, evidence_count; components: component, category.

    Components are a small dimension; the join is on whether they need evidence.
    """
    need = F.col("category").isin(*_NEED_EVIDENCE)
    held = states.select("query_id", F.explode(F.when(F.col("evidence_count") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("needs"))
    return held.join(components.withColumn("needs", need), "needs").select("query_id", "component")


def should_replan(steps: DataFrame, by: str = "run_id") -> DataFrame:
    """With replan: at least two of the last three verdicts failed."""
    last = Window.partitionBy(by).orderBy("seq").rowsBetween(-2, 0)
    return steps.withColumn("replan", F.sum(F.col("verdict").isin("FAIL", "REPLAN").cast("int")).over(last) >= 2)
