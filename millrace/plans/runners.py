"""Runners: standard, adaptive and exploratory simulations over all samples or seeds at once.

Loops on the driver are over rounds, never over rows: a round is one plan
for every query that is still open, and its results are written, so that
lineages stay short and a lost executor repeats one round at most.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.similarity import answer_similarity, exploratory_similarity
from ..operators import answers
from ..operators.knowledge import recent_context
from ..sources.shared import written
from . import prompts
from .components import Services
from .state import Model, State, started
from .workflow import FOLDER, Workflow, executed, loaded

#: Where simulation templates lie.
TEMPLATES = Path(__file__).parent / "simulations"


class Mode(str, Enum):
    STANDARD = "standard"
    ADAPTIVE = "adaptive"
    EXPLORATORY = "exploratory"


class Metric(str, Enum):
    EMBEDDING_COSINE = "embedding_cosine"
    TOKEN_OVERLAP = "token_overlap"
    BLEU = "bleu"
    ROUGE = "rouge"


@dataclass
class ModelSpec:
    """A model by the name that templates use, its id at the provider, and its role. Keys are read from the environment where it is called."""

    name: str
    model_id: str
    role: str = "teacher"
    temperature: float = 0.7


@dataclass
class Dataset:
    name: str
    path: str
    num_samples: int = -1
    sample_strategy: str = "sequential"


@dataclass
class Template:
    """What a simulation runs: models, datasets, workflows, and its limits.

    consulted: for each component type the consultants that answer beside it.
    """

    id: str
    name: str = ""
    mode: Mode = Mode.STANDARD
    teachers: list[ModelSpec] = field(default_factory=list)
    consultants: list[ModelSpec] = field(default_factory=list)
    verifier: ModelSpec | None = None
    workflows: list[str] = field(default_factory=list)
    datasets: list[Dataset] = field(default_factory=list)
    retrieval: dict[str, Any] = field(default_factory=dict)
    consulted: dict[str, list[str]] = field(default_factory=dict)
    verification: dict[str, Any] = field(default_factory=dict)
    max_iterations: int = 5
    threshold: float = 0.6
    metric: Metric = Metric.EMBEDDING_COSINE
    output_dir: str = "simulation_output"
    mode_config: dict[str, Any] = field(default_factory=dict)

    def problems(self, folder: Path = FOLDER) -> list[str]:
        """What keeps the template from running."""
        out = []
        for name in self.workflows:
            try:
                last = loaded(name, folder).components[-1]["type"]
            except FileNotFoundError:
                out.append(f"no workflow {name}")
                continue
            if last not in ("finalizer", "answer_drafter"):
                out.append(f"workflow {name}: the last component must be finalizer or answer_drafter, not {last}")
        if not self.teachers:
            out.append("at least one teacher model is needed")
        if self.mode is not Mode.EXPLORATORY and not self.datasets:
            out.append("a dataset is needed unless the mode is exploratory")
        known = {m.name for m in self.consultants}
        return out + [f"unknown consultant model {m}" for models in self.consulted.values() for m in models if m not in known]

    def exploration(self, models: dict[str, Model], external: Model | None = None) -> Exploration:
        """The settings of an exploratory run; ``models`` has the consultants by name, ``external`` what answers for an external component."""
        c = self.mode_config
        asked = {m.name: models[m.name] for m in self.consultants if m.name in models} if c.get("enable_consultant_reflection", True) else {}
        return Exploration(
            c.get("max_explorations", 10), c.get("use_knowledge_base", True), c.get("execution_mode", "standard"), c.get("questions_per_reflection", 3),
            external if c.get("external_knowledge_component") else None, asked, self.max_iterations, self.threshold, self.metric.value,
        )


def template_of(raw: dict[str, Any], env: Mapping[str, str] | None = None) -> Template:
    """A template from parsed YAML; models that it doesn't name come from the environment (TEACHER_MODELS, CONSULTANT_MODELS, VERIFIER_MODEL)."""
    env = os.environ if env is None else env

    def named(key: str) -> list[str]:
        return [m.strip() for m in env.get(key, "").split(",") if m.strip()]

    def specs(key: str, role: str) -> list[ModelSpec]:
        return [ModelSpec(m["name"], m["model_id"], m.get("role", role), m.get("temperature", 0.7)) for m in raw.get(key) or []]

    teachers = named("TEACHER_MODELS")
    verifier, wanted = raw.get("verifier_model"), named("VERIFIER_MODEL")
    default = Template(raw["id"])
    return Template(
        raw["id"], raw["name"], Mode(raw.get("mode", "standard")),
        specs("teacher_models", "teacher") or [ModelSpec("teacher" if len(teachers) == 1 else f"teacher_{i}", m) for i, m in enumerate(teachers)],
        specs("consultant_models", "consultant") or [ModelSpec(m.split("-")[0], m, "consultant") for m in named("CONSULTANT_MODELS")],
        ModelSpec(verifier["name"], verifier["model_id"], "verifier", verifier.get("temperature", 0.7)) if verifier else ModelSpec("verifier", wanted[0], "verifier") if wanted else None,
        raw.get("workflows") or [], [Dataset(**d) for d in raw.get("datasets") or []], raw.get("retrieval") or {},
        {p["component_type"]: p["consultant_models"] for p in raw.get("parallel_execution") or []}, raw.get("verification") or {},
        int(raw.get("max_iterations", env.get("MAX_ITERATIONS", default.max_iterations))), float(raw.get("similarity_threshold", env.get("SIMILARITY_THRESHOLD", default.threshold))),
        Metric(raw.get("similarity_metric", env.get("SIMILARITY_METRIC", default.metric.value))), raw.get("output_dir", env.get("OUTPUT_DIR", default.output_dir)), raw.get("mode_config") or {},
    )


def template_loaded(name: str, folder: Path = TEMPLATES) -> Template:
    """A template file by its id or path; needs PyYAML."""
    import yaml

    path = Path(name) if Path(name).suffix else folder / f"{name}.yaml"
    return template_of(yaml.safe_load(path.read_text(encoding="utf-8")))


_RESULT = ("query_id", "iteration", "answer", "flagged", "similarity", "success")


def standard(workflow: Workflow, samples: DataFrame, services: Services, max_iterations: int = 5, threshold: float = 0.6, metric: str = "embedding_cosine", verifier: Model | None = None, evidence: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs (query_id, query, gold_answer) until the answer is close enough to the gold one, or the rounds are over.

    Returns results (query_id, iteration, answer, flagged, similarity,
    success; one row for each query: its last round) and the steps of all
    rounds. A flagged answer is tried again without comparing it. ``evidence``
    takes the evidence of each round with its iteration, if given.
    """
    open_rows, results, steps = written(samples.select(F.col("query_id").cast("string"), "query", "gold_answer"), "samples"), None, None
    for i in range(1, max_iterations + 1):
        state = executed(workflow, open_rows.select("query_id", "query"), services)
        step = written(state.steps.withColumn("iteration", F.lit(i)), "steps")
        steps = step if steps is None else steps.unionByName(step)
        if evidence is not None:
            evidence.append(written(state.evidence.withColumn("iteration", F.lit(i)), "evidence"))
        answer = F.coalesce("final", "draft")
        done = _verified(state, verifier).select("query_id", answer.alias("answer"), "flagged").join(open_rows.select("query_id", "gold_answer"), "query_id")
        vectors = [services.embed(c) for c in (F.col("answer"), F.col("gold_answer"))] if services.embed else [None, None]
        near = F.when(F.col("flagged"), 0.0).otherwise(answer_similarity(metric, F.col("answer"), F.col("gold_answer"), *vectors))
        done = done.withColumn("similarity", near).withColumn("success", ~F.col("flagged") & (F.col("similarity") >= threshold)).withColumn("iteration", F.lit(i)).select(*_RESULT)
        done = written(done if i == max_iterations else done, "round")
        final = done if i == max_iterations else done.where("success")
        results = final if results is None else results.unionByName(final)
        if i < max_iterations:
            open_rows = written(open_rows.join(done.where("success"), "query_id", "left_anti"), "open")
            if open_rows.isEmpty():
                break
    return results, steps


def _verified(state: State, verifier: Model | None) -> DataFrame:
    answer = F.coalesce("final", "draft")
    if verifier is None:
        return state.queries.withColumn("flagged", F.lit(False))
    texts = answers.evidence_text(state.evidence, 5, 200)
    prompt = prompts.render("verify", answer=answer, evidence_text=F.col("evidence_text"))
    said = written(state.queries.join(texts, "query_id", "left").withColumn("_said", verifier(prompt)), "verified")
    return said.withColumn("flagged", answers.realtime_verdict(F.coalesce("final", "draft"), F.col("_said.text"))["flagged"])


def chosen_actions(response: Column) -> Column:
    """Component names after DECISION:, or a whole response that is a JSON array."""
    body = T.after_marker(response, "REASONING:", "DECISION:")
    return F.coalesce(F.from_json(F.coalesce(T.bracket_slice(body), body), "array<string>"), F.array().cast("array<string>"))


def adaptive(workflow: Workflow, samples: DataFrame, services: Services, teacher: Model, max_iterations: int = 5, threshold: float = 0.6) -> tuple[State, DataFrame]:
    """The teacher chooses the components of each round from those that a query's evidence allows.

    samples: query_id, query, gold_answer (none: empty, which any answer
    meets). Queries that chose the same list run together, on the state so
    far. A query ends with success when its answer comes as close to the gold
    one as ``threshold``; without, when the teacher chooses nothing or
    ``["finish"]`` alone, or when the rounds are over. ``finish`` among others
    is dropped. Answers are compared by cosine, whatever a template's metric.

    Returns the state and a row for each query: query_id, iteration, answer,
    similarity (0 without success) and success. From a query's second round on
    its steps hold the teacher's decisions.
    """
    types = sorted({p["type"] for p in workflow.components})
    dim = samples.sparkSession.createDataFrame([(t, answers.CATEGORIES[t]) for t in types], "component string, category string")
    gold = F.col("gold_answer") if "gold_answer" in samples.columns else F.lit("")
    waiting = written(samples.select(F.col("query_id").cast("string"), F.coalesce(gold, F.lit("")).alias("gold_answer")), "open")
    state, results = started(samples.select("query_id", "query")), None

    def answered(rows: DataFrame) -> DataFrame:
        return rows.join(state.queries.select("query_id", F.coalesce("final", "draft").alias("answer")), "query_id")

    def ended(rows: DataFrame, i: int, success: bool, similarity: Column) -> None:
        nonlocal results
        out = rows.select("query_id", F.lit(i).alias("iteration"), "answer", similarity.cast("double").alias("similarity"), F.lit(success).alias("success"))
        results = out if results is None else results.unionByName(out)

    for i in range(1, max_iterations + 1):
        rows = _decided(state, waiting, dim, teacher)
        if i > 1:
            state = state.with_step("teacher_decision", rows, thought=F.col("reasoning"), data=F.to_json(F.struct(F.col("actions").alias("decision"))), llm_input=F.col("prompt"), llm_output=F.col("said.text"), tokens=T.usage(F.col("said.usage"))["total_tokens"], evidence_count=F.col("evidence_count"))
        stop = (F.size("actions") == 0) | (F.col("actions") == F.array(F.lit("finish")))
        ended(answered(rows.where(stop)), i, False, F.lit(0.0))
        going = rows.where(~stop).select("query_id", "gold_answer", F.filter("actions", lambda a: a.isin(*types)).alias("actions"))
        lists = [tuple(r["actions"]) for r in going.select("actions").distinct().collect()]  # lists of component names, not of queries
        for names in lists:
            part = going.where(F.col("actions") == (F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"))).select("query_id")
            state = _on_part(state, part, names, services)
        state = _written_state(state)
        vectors = [services.embed(c) for c in (F.nullif(F.trim("answer"), F.lit("")), F.nullif(F.trim("gold_answer"), F.lit("")))] if services.embed else [None, None]
        near = answer_similarity("embedding_cosine", F.col("answer"), F.col("gold_answer"), *vectors)
        compared = answered(going.drop("actions")).withColumn("similarity", near)
        compared = written(compared.withColumn("met", (F.coalesce("answer", F.lit("")) != "") & (F.col("similarity") >= threshold)), "compared")
        ended(compared.where("met"), i, True, F.col("similarity"))
        waiting = compared.where("not met").select("query_id", "gold_answer")
        if i == max_iterations:
            ended(compared.where("not met"), i, False, F.lit(0.0))
        elif waiting.isEmpty():
            break
    return state, results


def _decided(state: State, waiting: DataFrame, dim: DataFrame, teacher: Model) -> DataFrame:
    """The open queries with the prompt, what the teacher said, its actions and its reasoning."""
    held = state.evidence.groupBy("query_id").agg(F.count("*").alias("n"))
    counted = state.queries.join(waiting, "query_id").join(held, "query_id", "left").withColumn("evidence_count", F.coalesce("n", F.lit(0)))
    offer = answers.available(counted, dim).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("component")), ", ").alias("components"))
    prompt = prompts.render("choose", query=F.col("query"), evidence_count=F.col("evidence_count").cast("string"), components=F.col("components"))
    rows = counted.join(offer, "query_id", "left").withColumn("components", F.coalesce("components", F.lit("")))
    rows = written(rows.withColumn("prompt", prompt).withColumn("said", teacher(F.col("prompt"))), "chosen")
    rows = rows.withColumn("actions", chosen_actions(F.col("said.text")))
    marked = T.stripped(F.replace(F.substring_index("said.text", "DECISION:", 1), F.lit("REASONING:"), F.lit("")))
    plain = F.concat(F.lit("Selected "), F.size("actions").cast("string"), F.lit(" components for execution"))
    return rows.withColumn("reasoning", F.when(F.col("said.text").contains("DECISION:"), marked).otherwise(plain))


def _on_part(state: State, ids: DataFrame, names: tuple[str, ...], services: Services) -> State:
    flow = Workflow("chosen", "chosen", [{"type": name} for name in names])
    part = executed(flow, state.part(ids, "left_semi"), services) if names else state.part(ids, "left_semi")
    return state.part(ids, "left_anti").joined(part).but(seq=part.seq)


def _written_state(state: State) -> State:
    return state.but(**{t: written(getattr(state, t), t) for t in ("queries", "evidence", "seen", "steps")})


def explored(seeds: DataFrame, expand: Callable[[DataFrame], DataFrame], max_explorations: int = 10) -> DataFrame:
    """Breadth-first exploration of every seed at once: (seed_id, iteration, query).

    seeds: seed_id, query. ``expand`` maps the queries of a round (seed_id,
    iteration, query) to their questions (seed_id, place, question), in order
    of place.
    Each seed has its own queue: a round takes the first query of each that
    was not explored, so repeats in a queue cost nothing of the budget.
    """
    queue = written(seeds.select("seed_id", F.lit(0).alias("round"), F.lit(0).alias("place"), "query"), "queue")
    done = None
    for i in range(1, max_explorations + 1):
        first = Window.partitionBy("seed_id").orderBy("round", "place")
        head = queue.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("seed_id", F.lit(i).alias("iteration"), "query")
        head = written(head, "head")
        if head.isEmpty():
            break
        done = head if done is None else done.unionByName(head)
        fresh = expand(head).select("seed_id", F.lit(i).alias("round"), "place", F.col("question").alias("query"))
        # Only what this round explored can be new among the explored in the queue; new questions are held against all.
        queue = queue.join(head, ["seed_id", "query"], "left_anti").select("seed_id", "round", "place", "query")
        queue = written(queue.unionByName(fresh.join(done, ["seed_id", "query"], "left_anti").select("seed_id", "round", "place", "query")), "queue")
    return done


def reflected(explorations: DataFrame, context: DataFrame, model: Model, count: int = 3) -> DataFrame:
    """The explorations with prompt, tokens and questions, further ones from the model by the seed's context; null where it gives no JSON list."""
    rows = explorations.join(context, "seed_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    prompt = prompts.render("reflect", count=F.lit(str(count)), context=F.col("context"), query=F.col("query"), answer=F.col("answer"))
    said = written(rows.withColumn("prompt", prompt).withColumn("said", model(F.col("prompt"))), "reflected")
    body = T.code_fence_stripped(F.col("said.text"))
    held = F.filter(T.json_strings(body), lambda q: T.stripped(q) != "")
    return said.withColumn("questions", held).withColumn("tokens", F.coalesce(T.usage(F.col("said.usage"))["total_tokens"], F.lit(0))).drop("said")


@dataclass
class Exploration:
    """How a seed is explored. ``mode`` is standard, adaptive, auto (the teacher chooses for each query) or another name (one plain run).

    external: a model whose own answer to a query the run's answer is compared with.
    """

    max_explorations: int = 10
    use_knowledge: bool = True
    mode: str = "standard"
    questions: int = 3
    external: Model | None = None
    consultants: dict[str, Model] = field(default_factory=dict)
    max_iterations: int = 5
    threshold: float = 0.6
    metric: str = "embedding_cosine"


#: Questions that each consultant is asked for.
_CONSULTED = 2
_VERDICT = "struct<verified: boolean, confidence: double, external_answer: string>"


def exploratory(workflow: Workflow, seeds: DataFrame, services: Services, teacher: Model, how: Exploration | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Explores from every seed: runs the workflow for each query, then asks the teacher and the consultants for more.

    Every query starts from a fresh state and runs as ``how.mode`` says, against
    no gold answer. Returns the explorations (seed_id, iteration, query, answer,
    doc_ids, evidence_count, iterations_taken, similarity_score, mode_used,
    teacher_questions, consultant_questions, external_verification), their
    evidence and their steps, which hold the reflections, the consultants' and
    the external answers beside those of the components. A seed's last entries
    are context for its further questions and, if there are any when a query
    starts, a step of it. The teacher's questions come before those of the
    consultants, who are asked in order of their names.
    """
    how = how or Exploration()
    log: list[DataFrame] = []
    evidence: list[DataFrame] = []
    steps: list[DataFrame] = []

    def expand(head: DataFrame) -> DataFrame:
        keyed = written(head.withColumn("query_id", F.concat_ws("\u0001", F.col("seed_id").cast("string"), F.col("iteration").cast("string"))), "keyed")
        known = recent_context(_together(log)) if how.use_knowledge and log else None
        asked, made = _in_modes(workflow, keyed, services, teacher, how)
        pieces = written(made["evidence"].join(keyed.select("query_id", "seed_id", "query"), "query_id"), "evidence")
        ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
        docs = pieces.groupBy("query_id").agg(F.array_distinct(ids).alias("doc_ids"), F.count("*").alias("evidence_count"))
        rows = asked.join(made["answers"], "query_id").join(docs, "query_id", "left").withColumns({"doc_ids": F.coalesce("doc_ids", F.array().cast("array<string>")), "evidence_count": F.coalesce("evidence_count", F.lit(0)), "answer": F.coalesce("answer", F.lit(""))})
        rows = _externally_verified(rows, services, how)
        state = started(keyed.select("query_id", "query")).but(steps=made["steps"], seq=1_000_000)
        if known is not None:
            state = state.with_step("knowledge_base", rows.join(known, "seed_id"), data=F.to_json(F.struct(F.col("context").alias("knowledge_base"))))
        if how.external is not None:
            state = state.with_step("external_verification", rows, thought=F.lit("Generated external reference answer"), data=F.to_json("external_verification"), llm_input=F.col("external_prompt"), llm_output=F.col("external_verification.external_answer"), tokens=F.col("external_tokens"), evidence_count=F.col("evidence_count"))
        now = recent_context(_together([*log, rows.select(*_KNOWN)])) if how.use_knowledge else rows.select("seed_id", F.lit("").alias("context"))
        told = [("reflection", reflected(rows, now, teacher, how.questions))] + [("consultant_reflection", reflected(rows, now, m, _CONSULTED)) for _, m in sorted(how.consultants.items())]
        for name, said in told:
            state = state.with_step(name, said.where("questions is not null"), thought=F.lit("Generated exploration questions"), data=F.to_json(F.struct("questions")), llm_input=F.col("prompt"), llm_output=F.to_json("questions"), tokens=F.col("tokens"), evidence_count=F.col("evidence_count"))
        steps.append(written(state.steps.join(keyed.select("query_id", "seed_id"), "query_id"), "steps"))
        evidence.append(pieces)
        every = F.array().cast("array<string>")
        for n, (_, said) in enumerate(told):
            rows = rows.join(said.select("query_id", F.coalesce("questions", every).alias(f"_q{n}")), "query_id", "left")
        others = [F.coalesce(f"_q{n}", every) for n in range(1, len(told))]
        rows = rows.withColumn("teacher_questions", F.coalesce("_q0", every)).withColumn("consultant_questions", F.concat(every, *others))
        rows = written(rows.select(*_KNOWN, "evidence_count", "iterations_taken", "similarity_score", "mode_used", "teacher_questions", "consultant_questions", "external_verification"), "explorations")
        log.append(rows)
        return rows.select("seed_id", F.posexplode(F.concat("teacher_questions", "consultant_questions")).alias("place", "question"))

    explored(seeds, expand, how.max_explorations)
    return _together(log), _together(evidence), _together(steps)


_KNOWN = ("seed_id", "iteration", "query", "answer", "doc_ids")


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _in_modes(workflow: Workflow, keyed: DataFrame, services: Services, teacher: Model, how: Exploration) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The queries with mode_used, and the answers (query_id, answer, iterations_taken), evidence and steps of their runs."""
    if how.mode == "auto":
        said = written(keyed.withColumn("said", teacher(prompts.render("mode", query=F.col("query")))), "mode")
        asked = said.select("seed_id", "iteration", "query", "query_id", T.execution_mode(F.col("said.text")).alias("mode_used"))
    else:
        asked = keyed.select("seed_id", "iteration", "query", "query_id", F.lit(how.mode).alias("mode_used"))
    found: dict[str, list[DataFrame]] = {"answers": [], "evidence": [], "steps": []}
    for mode in ("standard", "adaptive") if how.mode == "auto" else (how.mode,):
        samples = asked.where(F.col("mode_used") == mode).select("query_id", "query", F.lit("").alias("gold_answer"))
        if mode == "adaptive":
            state, results = adaptive(workflow, samples, services, teacher, how.max_iterations, how.threshold)
            pieces, log = state.evidence, state.steps
        elif mode == "standard":
            results, log, pieces = _standard_rounds(workflow, samples, services, how.max_iterations, how.threshold, how.metric)
        else:
            state = executed(workflow, samples.select("query_id", "query"), services)
            results = state.queries.select("query_id", F.coalesce("final", "draft").alias("answer"), F.lit(0).alias("iteration"))
            pieces, log = state.evidence, state.steps
        for name, df in (("answers", results.select("query_id", "answer", F.col("iteration").alias("iterations_taken"))), ("evidence", pieces), ("steps", log)):
            found[name].append(written(df, name))
    return asked, {name: _together(parts) for name, parts in found.items()}


def _standard_rounds(workflow: Workflow, samples: DataFrame, services: Services, max_iterations: int, threshold: float, metric: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, steps and evidence of each query's last round, as ``standard`` gives them."""
    kept: list[DataFrame] = []
    results, steps = standard(workflow, samples, services, max_iterations, threshold, metric, evidence=kept)
    last = results.select("query_id", "iteration")
    return results, steps.join(last, ["query_id", "iteration"], "left_semi").drop("iteration"), _together(kept).join(last, ["query_id", "iteration"], "left_semi").drop("iteration")


def _externally_verified(rows: DataFrame, services: Services, how: Exploration) -> DataFrame:
    """With similarity_score and external_verification; the score is 0 unless an external answer is there to compare with."""
    if how.external is None:
        return written(rows.withColumns({"similarity_score": F.lit(0.0), "external_verification": F.lit(None).cast(_VERDICT)}), "verified")
    said = written(rows.withColumn("external_prompt", prompts.render("external", query=F.col("query"))).withColumn("said", how.external(F.col("external_prompt"))), "external")
    text, failed = T.stripped(F.coalesce("said.text", F.lit(""))), F.col("said.error").isNotNull()
    verdict = answers.external_verdict(text)
    held = F.struct(F.when(failed, False).otherwise(verdict["verified"]).alias("verified"), F.when(failed, 0.0).otherwise(verdict["confidence"]).alias("confidence"), text.alias("external_answer"))
    said = said.withColumn("external_verification", held).withColumn("external_tokens", F.coalesce(T.usage(F.col("said.usage"))["total_tokens"], F.lit(0))).drop("said")
    answer, external = F.nullif(F.trim("answer"), F.lit("")), F.nullif(F.trim("external_verification.external_answer"), F.lit(""))
    near = exploratory_similarity(answer, external, services.embed(answer), services.embed(external)) if services.embed else answer_similarity("token_overlap", answer, external)
    return written(said.withColumn("similarity_score", F.when(answer.isNull() | external.isNull(), 0.0).otherwise(near)), "verified")


def iterative(workflow: Workflow, queries: DataFrame, services: Services, max_iterations: int = 3) -> tuple[DataFrame, DataFrame]:
    """Fresh runs of the queries that have no final answer yet: (query_id, iteration, final) and the steps."""
    open_rows, finals, steps = queries.select(F.col("query_id").cast("string"), "query"), None, None
    for i in range(1, max_iterations + 1):
        state = executed(workflow, open_rows, services)
        out = written(state.queries.where("final is not null").select("query_id", F.lit(i).alias("iteration"), "final"), "final")
        step = written(state.steps.withColumn("iteration", F.lit(i)), "steps")
        finals = out if finals is None else finals.unionByName(out)
        steps = step if steps is None else steps.unionByName(step)
        open_rows = written(open_rows.join(out, "query_id", "left_anti"), "open")
        if open_rows.isEmpty():
            break
    return finals, steps
