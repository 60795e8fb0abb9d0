"""Analytics of trace steps.

steps: run_id, seq, turn, component, verdict, stop_condition, rationale_tag,
llm_input, llm_output, tokens, evidence_count, execution_time_ms, error and,
where there are some, parameters, tool_input and tool_output as JSON. ``seq``
orders a run; ``turn`` may begin anew within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import trace as X


def _run():
    return Window.partitionBy("run_id").orderBy("seq")


def tool_usage(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id", "component").agg(F.count("*").alias("uses"))


def latency_by_tool(steps: DataFrame) -> DataFrame:
    ms = F.coalesce("execution_time_ms", F.lit(0.0))
    return steps.groupBy("run_id", "component").agg(F.count("*").alias("count"), F.sum(ms).alias("total_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.avg(ms).alias("avg_ms"))


def tokens_by_tool(steps: DataFrame) -> DataFrame:
    n = F.coalesce("tokens", F.lit(0))
    return steps.groupBy("run_id", "component").agg(F.count("*").alias("count"), F.sum(n).alias("total"), F.avg(n).alias("avg"))


def run_totals(steps: DataFrame) -> DataFrame:
    """Totals, cost and averages of each run.

    final_evidence_count is the last step's count; compat_final_evidence_count
    is the constant 0 that existing readers of the statistics expect.
    """
    steps_n, ms, tokens = F.count("*"), F.sum(F.coalesce("execution_time_ms", F.lit(0.0))), F.sum(F.coalesce("tokens", F.lit(0)))
    return steps.groupBy("run_id").agg(
        steps_n.alias("total_steps"), ms.alias("total_latency_ms"), tokens.alias("total_tokens"), X.cost(tokens).alias("total_cost"),
        (ms / F.greatest(steps_n, F.lit(1))).alias("avg_latency_per_step_ms"), (tokens / F.greatest(steps_n, F.lit(1))).alias("avg_tokens_per_step"),
        F.max_by("evidence_count", "seq").alias("final_evidence_count"), F.lit(0).cast("long").alias("compat_final_evidence_count"),
    )


def run_stats(steps: DataFrame) -> DataFrame:
    """One row for each run: the totals with the maps by tool, and constants that stand for what is not computed."""
    def by_tool(df: DataFrame, name: str, *values: str) -> DataFrame:
        value = F.struct(*values) if len(values) > 1 else F.col(values[0])
        entries = F.array_sort(F.collect_list(F.struct("component", value.alias("value"))))
        return df.groupBy("run_id").agg(F.map_from_entries(entries).alias(name))

    return (
        run_totals(steps)
        .join(by_tool(tool_usage(steps), "tool_usage", "uses"), "run_id")
        .join(by_tool(latency_by_tool(steps), "latency_by_tool", "count", "total_ms", "min_ms", "max_ms", "avg_ms"), "run_id")
        .join(by_tool(tokens_by_tool(steps), "tokens_by_tool", "count", "total", "avg"), "run_id")
        .withColumns({"rationale_tags": F.expr("map()").cast("map<string,int>"), "decision_labels": F.expr("map()").cast("map<string,int>"), "query_evolution": F.array().cast("array<string>"), "avg_evidence_overlap": F.lit(0.0)})
    )


def manifest(steps: DataFrame, runs: DataFrame, created_at: Column) -> DataFrame:
    """One row for each run: what ``runs`` (run_id, ...) says, when it was made, and its cost."""
    totals = run_totals(steps).select("run_id", "total_steps", "total_latency_ms", "total_tokens", "total_cost")
    return runs.join(totals, "run_id", "left").withColumn("created_at", F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def run_config(steps: DataFrame, default_corpus: str) -> DataFrame:
    """(run_id, corpus): that of the first retriever step which names one, else the default."""
    corpus = F.get_json_object("tool_input", "$.corpus")
    named = F.col("component").isin(*X.RETRIEVERS) & corpus.isNotNull()
    return steps.groupBy("run_id").agg(F.coalesce(F.min_by(F.when(named, corpus), F.when(named, F.col("seq"))), F.lit(default_corpus)).alias("corpus"))


def run_settings(steps: DataFrame, runs: DataFrame, components: list[str], threshold: float, max_iterations: int, endpoint: str = "chatnoir", index: str = "cw12") -> DataFrame:
    """The configuration of each of ``runs`` (run_id, teacher_id, query, expected_answer): with its blocks, limits and search.

    The first retriever step that names a corpus says where a run searched; without one, endpoint and index do.
    """
    blocks = F.array(*(F.struct(F.lit(c).alias("type"), F.lit(c.replace("_", " ").title()).alias("label"), F.lit(False).alias("llm_decided")) for c in components))
    held = F.struct(blocks.alias("blocks"), F.lit(float(threshold)).alias("answer_match_threshold"), F.lit(int(max_iterations)).alias("max_iterations"))
    searched = run_config(steps, "").select("run_id", F.nullif("corpus", F.lit("")).alias("named"))
    rows = runs.join(searched, "run_id", "left")
    return rows.select(
        "run_id", "teacher_id", "query", "expected_answer", held.alias("workflow_config"),
        F.when(F.col("named").isNotNull(), "chatnoir").otherwise(endpoint).alias("search_endpoint"), F.coalesce("named", F.lit(index)).alias("search_index"),
    )


def with_teacher(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows`` of runs with teacher_model, from (run_id, teacher_model); runs that it does not list have none."""
    return rows.join(models.select("run_id", "teacher_model").dropDuplicates(["run_id"]), "run_id", "left")


def evidence_progression(steps: DataFrame) -> DataFrame:
    return steps.select("run_id", "seq", F.col("turn").alias("step_id"), F.coalesce("evidence_count", F.lit(0)).cast("long").alias("evidence_count"), F.lit(0.0).alias("evidence_available_pct"), F.lit(0.0).alias("retrieval_overlap"))


def traces(steps: DataFrame, streamed: bool = False) -> DataFrame:
    """The 16 fields of a trace line; an exported one has neither goal nor private reasoning, a streamed one has both."""
    def held(name: str, else_: Column) -> Column:
        return F.coalesce(F.col(name), else_) if name in steps.columns else else_

    blank = F.lit("")
    return steps.select(
        "run_id", "seq", F.col("turn").alias("step_id"), (held("goal", blank) if streamed else blank).alias("goal"),
        F.struct(F.col("component").alias("tool"), held("parameters", F.lit("{}")).alias("parameters")).alias("action"),
        held("rationale_tag", blank).alias("rationale_tag"), blank.alias("operator_intent"), held("stop_condition", F.lit("CONTINUE")).alias("stop_condition"),
        held("timestamp", F.lit(None).cast("double")).alias("timestamp"), (held("thought", blank) if streamed else blank).alias("private_reasoning"),
        "llm_input", "llm_output", held("tool_input", F.lit("{}")).alias("tool_input"), held("tool_output", F.lit("{}")).alias("tool_output"),
        F.lit(None).cast("string").alias("evidence_retrieved"), F.col("evidence_count").cast("long").alias("evidence_count"), F.col("execution_time_ms"), F.col("error"),
    )


def supervised(steps: DataFrame) -> DataFrame:
    """Pairs of model input and output; both must be there and not empty."""
    both = F.coalesce(F.col("llm_input") != "", F.lit(False)) & F.coalesce(F.col("llm_output") != "", F.lit(False))
    return steps.where(both).select(
        "run_id", "seq", F.col("turn").alias("step_id"), F.col("llm_input").alias("input"), F.col("llm_output").alias("output"), F.col("component").alias("tool"),
        F.coalesce("rationale_tag", F.lit("")).alias("rationale_tag"), F.coalesce("stop_condition", F.lit("CONTINUE")).alias("decision_label"), F.col("execution_time_ms").alias("latency_ms"), "tokens",
    )


def previous_tools(steps: DataFrame) -> DataFrame:
    """With previous_tools: all tools of the run before this step, in order."""
    return steps.withColumn("previous_tools", F.collect_list("component").over(_run().rowsBetween(Window.unboundedPreceding, -1)))


def trajectories(steps: DataFrame, streamed: bool = False) -> DataFrame:
    """State, action, reward, next state and whether it is the end.

    An exported trajectory looks ahead to the run's next step (0, 0 and
    ``done`` at the end); a streamed one is written before that is known, so
    its next state is empty and only FINISH ends it.
    """
    stage = X.stage(F.col("component"), streamed)
    query = F.col("query") if "query" in steps.columns else F.lit("")
    df = previous_tools(steps).withColumn("_stage", stage)
    if streamed:
        reward, done, nothing = X.reward_streamed(F.col("error"), F.col("evidence_count"), F.col("component")), F.coalesce(F.col("stop_condition") == "FINISH", F.lit(False)), F.lit(None)
        following = F.struct(nothing.cast("int").alias("step_id"), nothing.cast("long").alias("evidence_count"), nothing.cast("string").alias("state_stage"))
    else:
        reward, last = X.reward_exported(F.col("error"), F.col("evidence_count"), F.col("stop_condition")), F.lead("seq").over(_run()).isNull()
        done = last | F.coalesce(F.col("stop_condition") == "FINISH", F.lit(False))
        following = F.struct(F.coalesce(F.lead("turn").over(_run()), F.lit(0)).alias("step_id"), F.coalesce(F.lead("evidence_count").over(_run()), F.lit(0)).cast("long").alias("evidence_count"), F.coalesce(F.lead("_stage").over(_run()), F.lit("done")).alias("state_stage"))
    parameters = F.col("parameters") if "parameters" in steps.columns else F.lit("{}")
    return df.select(
        "run_id", "seq",
        F.struct(F.col("turn").alias("step_id"), query.alias("query"), F.col("evidence_count").cast("long").alias("evidence_count"), F.lit(0.0).alias("evidence_available_pct"), F.col("_stage").alias("state_stage"), "previous_tools").alias("state"),
        F.struct(F.col("component").alias("tool"), parameters.alias("parameters"), F.coalesce("rationale_tag", F.lit("")).alias("rationale_tag")).alias("action"),
        reward.alias("reward"), following.alias("next_state"), done.alias("done"),
    )


def corpus_stats(steps: DataFrame, evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: counts of trace lines, trajectories, supervised pairs, distinct documents and queries."""
    a = steps.agg(F.count("*").alias("trace_steps"), F.count("*").alias("trajectory_steps"))
    b = supervised(steps).agg(F.count("*").alias("supervised_pairs"))
    c = evidence.agg(F.countDistinct("id").alias("unique_documents"))
    d = queries.agg(F.countDistinct("query").alias("total_queries"))
    return a.join(b).join(c).join(d)  # one row each


def pending(samples: DataFrame, ledger: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples that a running ledger does not list as completed; a ledger of another status lists none."""
    done = ledger.where("status = 'running' and completed").select(key).distinct()
    return samples.join(done, key, "left_anti")
