"""The state of a workflow over many queries: a few keyed tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EVIDENCE = "query_id string, pos int, source string, id string, text string, title string, score double, query_angle int"
STEPS = "query_id string, seq long, turn int, component string, success boolean, thought string, data string, llm_input string, llm_output string, rationale_tag string, verdict string, stop_condition string, tokens long, evidence_count long, execution_time_ms double, error string"


@dataclass(frozen=True)
class State:
    """queries: one row for each query with query_id, query, subgoals, formulated, draft, final.

    evidence has the pieces in order of pos; seen the ids that were ever
    inserted, which never come back; steps one row for each query and step.
    A transform returns a new state and leaves this one as it is.
    """

    queries: DataFrame
    evidence: DataFrame
    seen: DataFrame
    steps: DataFrame
    turn: int = 0
    seq: int = 0
    chosen: DataFrame | None = field(default=None)

    def but(self, **changes) -> State:
        return replace(self, **changes)

    def part(self, ids: DataFrame, how: str) -> State:
        """The state of the queries that ``ids`` has (left_semi) or has not (left_anti)."""
        return self.but(**{t: getattr(self, t).join(ids, "query_id", how) for t in ("queries", "evidence", "seen", "steps")})

    def joined(self, other: State) -> State:
        """With the queries of another state of the same run."""
        return self.but(**{t: getattr(self, t).unionByName(getattr(other, t)) for t in ("queries", "evidence", "seen", "steps")})

    def found(self, query_id: str, id: str) -> DataFrame:
        """A piece of evidence by its id."""
        return self.evidence.where((F.col("query_id") == query_id) & (F.col("id") == id))

    def summary(self) -> DataFrame:
        """(query_id, evidence_count, step_count, errors, has_answer) of each query."""
        pieces = self.evidence.groupBy("query_id").agg(F.count("*").alias("evidence_count"))
        log = self.steps.groupBy("query_id").agg(F.count("*").alias("step_count"), F.count_if(~F.col("success")).alias("errors"))
        rows = self.queries.join(pieces, "query_id", "left").join(log, "query_id", "left")
        counts = (F.coalesce(c, F.lit(0)).alias(c) for c in ("evidence_count", "step_count", "errors"))
        return rows.select("query_id", *counts, F.coalesce("final", "draft").isNotNull().alias("has_answer"))

    @property
    def spark(self) -> SparkSession:
        return self.queries.sparkSession

    def with_columns(self, found: DataFrame, *names: str) -> State:
        """Replaces columns of queries by those of ``found`` (query_id, ...) where it has a row."""
        held = found.select("query_id", *(F.col(n).alias(f"_{n}") for n in names))
        out = self.queries.join(held, "query_id", "left")
        return self.but(queries=out.withColumns({n: F.coalesce(f"_{n}", n) for n in names}).drop(*(f"_{n}" for n in names)))

    def with_step(self, component: str, rows: DataFrame, **columns: Column) -> State:
        """Adds a step for each row of ``rows``; columns that are not given get their defaults."""
        defaults = {
            "success": F.lit(True), "thought": F.lit(f"Executed {component}"), "data": F.lit("{}"), "llm_input": F.lit(None), "llm_output": F.lit(None), "rationale_tag": F.lit(""),
            "tokens": F.lit(0), "evidence_count": F.lit(0), "execution_time_ms": F.lit(0.0), "error": F.lit(None),
        } | columns
        ok = F.coalesce(defaults["success"].cast("boolean"), F.lit(False))
        defaults |= {"verdict": F.when(ok, columns.get("verdict", F.lit("PROCEED"))).otherwise("FAIL"), "stop_condition": F.when(ok, "CONTINUE").otherwise("ERROR"), "success": ok}
        given = {"query_id": F.col("query_id"), "seq": F.lit(self.seq + 1), "turn": F.lit(self.turn + 1), "component": F.lit(component)} | defaults
        step = rows.select(*(given[f.name].cast(f.dataType).alias(f.name) for f in self.steps.schema))
        return self.but(steps=self.steps.unionByName(step), seq=self.seq + 1, turn=self.turn + 1)


def started(queries: DataFrame) -> State:
    """A fresh state for (query_id, query)."""
    spark, none = queries.sparkSession, F.lit(None)
    strings = none.cast("array<string>")
    rows = queries.select(F.col("query_id").cast("string"), "query", strings.alias("subgoals"), strings.alias("formulated"), none.cast("string").alias("draft"), none.cast("string").alias("final"))
    empty = spark.createDataFrame([], EVIDENCE)
    return State(rows, empty, empty.select("query_id", "id"), spark.createDataFrame([], STEPS))


Model = Callable[[Column], Column]
