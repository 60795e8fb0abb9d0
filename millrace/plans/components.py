"""The components of workflows. Each is a transform of the state of all queries at once."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, trace as X
from ..operators import answers, processing, retrieval
from ..operators.answers import CATEGORIES
from ..sources.shared import written
from . import prompts
from .state import Model, State

REGISTRY: dict[str, type[Component]] = {}


class MissingService(ValueError):
    """A component lacks what it calls."""


@dataclass
class Services:
    """What components call: a language model, a corpus (id, text, title), vectors (id, vector), and others by name.

    consultants: for a component type the names of the models that answer beside it.
    """

    model: Model | None = None
    corpus: DataFrame | None = None
    web: DataFrame | None = None
    vectors: DataFrame | None = None
    embed: Callable[[Column], Column] | None = None
    cross_encoder: Callable[[Column, Column], Column] | None = None
    models: dict[str, Model] = field(default_factory=dict)
    consultants: dict[str, list[str]] = field(default_factory=dict)


def register(name: str):
    def add(cls: type[Component]) -> type[Component]:
        cls.name = name
        REGISTRY[name] = cls
        return cls

    return add


class Component(ABC):
    """``DEFAULTS`` has each configuration key with its default; others are refused by validation, not here."""

    name = ""
    DEFAULTS: dict[str, Any] = {}

    def __init__(self, config: dict[str, Any] | None = None, services: Services | None = None) -> None:
        self.config = {**self.DEFAULTS, **(config or {})}
        self.services = services or Services()

    @property
    def category(self) -> str:
        return CATEGORIES[self.name]

    @abstractmethod
    def apply(self, state: State) -> State: ...

    def _ask(self, prompt: Column) -> Column:
        if self.services.model is None:
            raise MissingService(f"{self.name} needs a language model")
        return self.services.model(prompt)


def categories() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name in sorted(REGISTRY):
        out.setdefault(CATEGORIES[name], []).append(name)
    return out


def _held(state: State) -> DataFrame:
    n = state.evidence.groupBy("query_id").agg(F.count("*").alias("held"))
    return state.queries.join(n, "query_id", "left").withColumn("held", F.coalesce("held", F.lit(0)))


def _asked(rows: DataFrame, prompt: Column, ask: Callable[[Column], Column]) -> DataFrame:
    """With prompt, response, total tokens and failure. The answers are written, so no later use asks the model again."""
    rows = written(rows.withColumn("prompt", prompt).withColumn("said", ask(F.col("prompt"))), "asked")
    return rows.select("*", F.col("said.text").alias("response"), T.usage(F.col("said.usage"))["total_tokens"].alias("total"), F.col("said.error").alias("failure")).drop("said")


class Retriever(Component):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, angle, rank, id, score) for (query_id, angle, query)."""
        raise NotImplementedError

    def asked(self, state: State) -> DataFrame:
        raise NotImplementedError

    def documents(self) -> DataFrame:
        raise NotImplementedError

    skip_empty = True
    source = ""

    def apply(self, state: State) -> State:
        if not self.config.get("enabled", True):
            return state.with_step(self.name, state.queries, data=F.lit('{"skipped": true}'))
        texts = self.documents()
        title = F.col("title") if "title" in texts.columns else F.lit(None)
        hits = self.search(self.asked(state), self.config["k"]).join(texts.select(F.col("id"), "text", title.cast("string").alias("title")), "id")
        if self.skip_empty:
            hits = retrieval.nonempty(hits)
        hits = written(hits, "hits")
        counted = hits.groupBy("query_id").agg(F.count("*").alias("retrieved"))
        fresh = retrieval.inserted(hits, ["angle", "rank"], state.seen)
        front = state.evidence.groupBy("query_id").agg(F.max("pos").alias("last"))
        fresh = fresh.join(front, "query_id", "left").select(
            "query_id", (F.col("pos") + F.coalesce("last", F.lit(-1)) + 1).cast("int").alias("pos"), F.lit(self.source).alias("source"), "id", "text", "title", F.col("score").cast("double"), F.col("angle").cast("int").alias("query_angle"),
        )
        fresh = written(fresh, "fresh")  # later steps read what was found and don't search again
        state = state.but(evidence=state.evidence.unionByName(fresh), seen=state.seen.union(fresh.select("query_id", "id")))
        rows = state.queries.select("query_id").join(counted, "query_id", "left")
        n = F.coalesce("retrieved", F.lit(0))
        return state.with_step(self.name, rows, evidence_count=n, data=F.to_json(F.struct(n.alias("retrieved_count"))))


@register("opensearch_retriever")
class IndexRetriever(Retriever):
    DEFAULTS = {"k": 50, "multi_angle": True, "k_per_query": 20}
    source = "index"

    def documents(self) -> DataFrame:
        if self.services.corpus is None:
            raise MissingService(f"{self.name} needs a corpus")
        return self.services.corpus

    def asked(self, state: State) -> DataFrame:
        goals = F.coalesce("subgoals", F.array().cast("array<string>"))
        return retrieval.angles(state.queries.select("query_id", "query", goals.alias("subgoals")), self.config.get("multi_angle", True), self.config["k"], self.config.get("k_per_query", self.config["k"]))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        most = max(k, self.config.get("k_per_query", k))
        top = retrieval.bm25_top_k(self.documents(), queries, most, by=("query_id", "angle"))
        return top.join(queries.select("query_id", "angle", "k"), ["query_id", "angle"]).where("rank <= k").drop("k")


@register("chatnoir_retriever")
class WebRetriever(IndexRetriever):
    """The same over web pages; a remote index is read beforehand with ``sources.readers.external_search``."""

    DEFAULTS = {"k": 30, "corpus": "msmarco-v2.1-segmented", "enabled": True}
    source = "web"

    def documents(self) -> DataFrame:
        if self.services.web is None:
            raise MissingService(f"{self.name} needs web pages")
        return self.services.web


@register("vector_retriever")
class VectorRetriever(Retriever):
    DEFAULTS = {"k": 25, "num_candidates": 100, "enabled": True}
    skip_empty = False
    source = "vectors"

    def documents(self) -> DataFrame:
        if self.services.vectors is None or self.services.embed is None:
            raise MissingService(f"{self.name} needs vectors and an embedding model")
        return self.services.vectors

    def asked(self, state: State) -> DataFrame:
        """The last two formulated queries, or the query."""
        own = F.when(F.coalesce(F.size("formulated"), F.lit(0)) <= 0, F.array("query")).otherwise(F.slice("formulated", F.greatest(F.size("formulated") - 1, F.lit(1)), 2))
        return state.queries.select("query_id", F.posexplode(own).alias("angle", "query"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        probes = queries.select(F.concat_ws("\u0001", "query_id", F.col("angle").cast("string")).alias("query_id"), self.services.embed(F.col("query")).alias("vector"))
        top = retrieval.knn_top_k(self.documents(), probes, k)
        part = F.split("query_id", "\u0001")
        return top.select(part[0].alias("query_id"), part[1].cast("int").alias("angle"), "rank", "id", "score")


class Processor(Component):
    counted = ""

    def process(self, state: State) -> DataFrame:
        raise NotImplementedError

    def apply(self, state: State) -> State:
        after = written(self.process(state).select(*state.evidence.columns), "evidence")
        counts = processing.counts(state.evidence, after)
        rows = state.queries.select("query_id").join(counts, "query_id", "left").na.fill(0, ["original_count", "kept_count", "removed"])
        data = F.to_json(F.struct("original_count", F.col("kept_count").alias(self.counted), "removed"))
        return state.but(evidence=after).with_step(self.name, rows, evidence_count=F.col("kept_count"), data=data)


@register("filter")
class Filter(Processor):
    DEFAULTS = {"min_length": 30, "max_length": 10_000, "min_score": 0.0, "max_results": 15}
    counted = "filtered_count"

    def process(self, state: State) -> DataFrame:
        return processing.filtered(state.evidence, **{k: self.config[k] for k in self.DEFAULTS})


@register("deduplicator")
class Deduplicator(Processor):
    DEFAULTS = {"method": "text_prefix", "prefix_length": 50, "max_results": 20}
    counted = "unique_count"

    def process(self, state: State) -> DataFrame:
        return processing.deduplicated(state.evidence, **{k: self.config[k] for k in self.DEFAULTS})


@register("extractor")
class Extractor(Processor):
    DEFAULTS = {"max_spans": 20, "span_window": 200}
    counted = "extracted_count"

    def process(self, state: State) -> DataFrame:
        return processing.extracted(state.evidence, self.config["max_spans"])


@register("reranker")
class Reranker(Processor):
    DEFAULTS = {"method": "cross_encoder", "model": "cross-encoder/ms-marco-MiniLM-L-6-v2", "top_k": 20}
    counted = "reranked_count"

    def process(self, state: State) -> DataFrame:
        return processing.reranked(state.evidence, state.queries, self.config["method"], self.config["top_k"], self.services.cross_encoder)


@register("planner")
class Planner(Component):
    DEFAULTS = {"max_subgoals": 3, "temperature": 0.7}

    def apply(self, state: State) -> State:
        most = self.config["max_subgoals"]
        rows = _asked(state.queries, prompts.render("plan", query=F.col("query"), max_subgoals=F.lit(str(most))), self._ask)
        rows = rows.withColumn("goals", answers.planned_goals(F.col("response"), most)).withColumn("ok", F.coalesce(F.size("goals"), F.lit(0)) > 0)
        for model in self.services.models.values():
            more = model(prompts.render("plan", query=F.col("query"), max_subgoals=F.lit(str(most))))
            rows = rows.withColumn("_more", more).withColumn("goals", T.merged_goals(F.col("goals"), answers.planned_goals(F.col("_more.text"), most), most)).drop("_more")
        state = state.with_columns(rows.where("ok").select("query_id", F.col("goals").alias("subgoals")), "subgoals")
        return state.with_step(
            self.name, rows, success=F.col("ok"), llm_input=F.col("prompt"), llm_output=F.col("response"), rationale_tag=F.when(F.col("ok"), "BREADTH").otherwise(""), tokens=F.col("total"), evidence_count=F.coalesce(F.size("goals"), F.lit(0)),
            thought=X.thought(T.reasoning_of(F.col("response"), "REASONING:", "SUB-GOALS:"), F.lit(None).cast("string"), F.lit(self.name)), error=F.when(~F.col("ok"), F.coalesce("failure", F.lit("no sub-goals"))), data=F.to_json(F.struct(F.col("goals").alias("subgoals"))),
        )


@register("query_formulator")
class QueryFormulator(Component):
    DEFAULTS = {"queries_per_subgoal": 2, "temperature": 0.8}

    def apply(self, state: State) -> State:
        prompt = prompts.render("formulate", query=F.col("query"), subgoals=F.array_join("subgoals", "\n"), queries_per_subgoal=F.lit(str(self.config["queries_per_subgoal"])))
        rows = _asked(state.queries, prompt, self._ask)
        rows = rows.withColumn("asked", answers.formulated_queries(F.col("response"), F.col("subgoals"), F.col("query")))
        every = F.concat(F.coalesce("formulated", F.array().cast("array<string>")), F.col("asked"))
        state = state.with_columns(rows.select("query_id", every.alias("formulated")), "formulated")
        return state.with_step(self.name, rows, llm_input=F.col("prompt"), llm_output=F.col("response"), tokens=F.col("total"), data=F.to_json(F.struct(F.col("asked").alias("queries"), F.size("asked").alias("count"))))


@register("answer_drafter")
class AnswerDrafter(Component):
    DEFAULTS = {"max_length": 500, "temperature": 0.1, "max_evidence": 10}

    def apply(self, state: State) -> State:
        texts = answers.evidence_text(state.evidence, self.config["max_evidence"])
        rows = state.queries.join(texts, "query_id", "left")
        rows = _asked(rows, prompts.render("draft", query=F.col("query"), evidence_text=F.col("evidence_text")), self._ask)
        rows = rows.withColumn("answer", answers.drafted_answer(F.col("response"))).withColumn("used", F.coalesce("evidence_used", F.lit(0)))
        state = state.with_columns(rows.select("query_id", F.col("answer").alias("draft")), "draft")
        ok = F.col("answer").isNotNull()
        said = F.concat(F.lit("Generated answer from "), F.col("used").cast("string"), F.lit(" evidence spans"))
        return state.with_step(
            self.name, rows, success=ok, llm_input=F.col("prompt"), llm_output=F.col("response"), tokens=F.col("total"), evidence_count=F.col("used"), thought=X.thought(T.reasoning_of(F.col("response"), "REASONING:", "ANSWER:"), said, F.lit(self.name)),
            error=F.when(~ok, F.coalesce("failure", F.lit("Empty answer generated"))), data=F.to_json(F.struct("answer", F.length("answer").alias("answer_length"), F.col("used").alias("evidence_used"))),
        )


@register("finalizer")
class Finalizer(Component):
    DEFAULTS = {"format": "markdown", "include_citations": True}

    def apply(self, state: State) -> State:
        cited = answers.citations(state.evidence).groupBy("query_id").agg(F.count("*").alias("cited"))
        rows = state.queries.join(cited, "query_id", "left").withColumn("answer", T.stripped(F.col("draft")))
        state = state.with_columns(rows.select("query_id", F.col("answer").alias("final")), "final")
        ok, n = F.col("answer").isNotNull(), F.coalesce("cited", F.lit(0))
        return state.with_step(self.name, rows, success=ok, evidence_count=n, error=F.when(~ok, F.lit("no draft answer")), data=F.to_json(F.struct(F.col("answer").alias("final_answer"), F.length("answer").alias("answer_length"), n.alias("citations_count"))))


class Gate(Component):
    need = 0

    def apply(self, state: State) -> State:
        rows = answers.checked(state.queries, state.evidence, F.col("draft"), self.need)
        return state.with_step(self.name, rows, success=F.col("success"), evidence_count=F.col("evidence_count"), error=F.when(~F.col("success"), F.lit("no draft answer")), data=F.to_json(F.struct("passed", "confidence", "evidence_count", F.lit(self.config["threshold"]).alias("threshold"))))


@register("fact_checker")
class FactChecker(Gate):
    DEFAULTS = {"strict_mode": False, "threshold": 0.75}
    need = 3


@register("attribution_gate")
class AttributionGate(Gate):
    DEFAULTS = {"threshold": 0.85, "strict_mode": True}
    need = 2


@register("condition")
class Condition(Component):
    DEFAULTS = {"condition_type": "threshold", "threshold": 0.6, "on_true": "continue", "on_false": "continue"}

    def apply(self, state: State) -> State:
        kind = self.config["condition_type"]
        value = {"evidence_count": F.col("held").cast("double"), "iteration_count": F.lit(float(state.turn))}.get(kind, F.lit(0.0))
        out = answers.condition(kind, value, self.config["threshold"], self.config["on_true"], self.config["on_false"])
        return state.with_step(self.name, _held(state), evidence_count=F.col("held"), data=F.to_json(F.struct(*(c.alias(n) for n, c in out.items()))))
