"""Workflow definitions and their execution: a fold of component transforms over the state."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..operators.answers import evidence_text
from ..sources.shared import written
from . import prompts
from .components import REGISTRY, MissingService, Services
from .state import State, started

FOLDER = Path(__file__).parent / "workflows"


@dataclass
class Workflow:
    id: str
    name: str
    components: list[dict[str, Any]]
    description: str = ""
    reasoning_style: str = ""
    config: dict[str, Any] = field(default_factory=dict)


def parsed(raw: dict[str, Any]) -> Workflow:
    for key in ("id", "name", "components"):
        if not raw.get(key):
            raise ValueError(f"a workflow needs {key}")
    parts = raw["components"]
    if not isinstance(parts, list) or any(not isinstance(p, dict) or "type" not in p for p in parts):
        raise ValueError("components are a list of mappings with a type")
    return Workflow(raw["id"], raw["name"], parts, raw.get("description", ""), raw.get("reasoning_style", ""), raw.get("config") or {})


def loaded(name: str, folder: Path = FOLDER) -> Workflow:
    """A workflow file by its id; needs PyYAML."""
    import yaml

    return parsed(yaml.safe_load((folder / f"{name}.yaml").read_text(encoding="utf-8")))


def catalog(folder: Path = FOLDER) -> list[dict[str, Any]]:
    out = []
    for path in sorted(folder.glob("*.yaml")):
        try:
            w = loaded(path.stem, folder)
            out.append({"id": path.stem, "name": w.name, "description": w.description, "reasoning_style": w.reasoning_style, "components": len(w.components)})
        except (ValueError, KeyError, TypeError) as e:
            out.append({"id": path.stem, "error": str(e)})
    return out


def problems(workflow: Workflow) -> list[str]:
    """Unknown component types and configuration keys."""
    out = []
    for part in workflow.components:
        cls = REGISTRY.get(part["type"])
        if cls is None:
            out.append(f"unknown component {part['type']}")
            continue
        out += [f"{part['type']} has no setting {k}" for k in part.get("config") or {} if k not in cls.DEFAULTS]
    return out


def executed(workflow: Workflow, queries: DataFrame | State, services: Services, max_steps: int | None = None, stop_on_error: bool | None = None) -> State:
    """The state after the workflow's components, in order, over all queries.

    ``queries`` may be an earlier state, which goes on: its turn begins anew
    and its seq goes on. A component that a query fails in leaves a failed
    step for that query, and so does one that raises, for all queries; the
    next one runs, unless ``stop_on_error`` (or the workflow's setting of that
    name) is set: then a query that failed goes no further. A missing service
    is an error of the setup and raises.

    Components with consultants (``services.consultants``) ask these too; what
    they say is a step of its own.
    """
    state = queries.but(turn=0) if isinstance(queries, State) else started(queries)
    most = max_steps or workflow.config.get("max_steps") or len(workflow.components)
    stop = workflow.config.get("stop_on_error", False) if stop_on_error is None else stop_on_error
    done: list[State] = []
    for part in workflow.components[:most]:
        before = state.seq
        state = _applied(part, state, services)
        if services.consultants.get(part["type"]):
            state = _consulted(part["type"], state, services)
        if stop:
            failed = written(state.steps.where((F.col("seq") > before) & ~F.col("success")).select("query_id").distinct(), "failed")
            done.append(state.part(failed, "left_semi"))
            state = state.part(failed, "left_anti")
    for ended in done:
        state = state.joined(ended)
    return state


def _applied(part: dict[str, Any], state: State, services: Services) -> State:
    try:
        if part["type"] not in REGISTRY:
            raise ValueError(f"unknown component {part['type']}")
        return REGISTRY[part["type"]](part.get("config"), services).apply(state)
    except MissingService:
        raise
    except Exception as e:  # a component that fails is a failed step of its queries, and not the end of all
        return state.with_step(part["type"], state.queries, success=F.lit(False), error=F.lit(str(e).splitlines()[0][:1000] if str(e) else type(e).__name__))


def _consulted(component: str, state: State, services: Services) -> State:
    """What the consultants of a component answer, as a step with one entry for each; only drafting has a prompt for them."""
    models = {name: services.models[name] for name in services.consultants[component] if name in services.models}
    if component not in ("answer_drafter", "synthesis") or not models:
        return state.with_step(f"{component}_consultants", state.queries, data=F.lit('{"skipped": true}'))
    texts = evidence_text(state.evidence, 10, 300)
    held = state.but(queries=state.queries.join(texts, "query_id", "left").withColumn("evidence_text", F.coalesce("evidence_text", F.lit(""))))
    prompt = prompts.render("consult", query=F.col("query"), evidence_text=F.col("evidence_text"))
    said = written(consultants(held, prompt, models), "consulted")
    entry = F.struct("model", F.col("response").alias("answer"), "error")
    rows = said.groupBy("query_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("consultants"))).alias("told"))
    return state.with_step(f"{component}_consultants", rows, data=F.col("told"))


def consultants(state: State, prompt, models: dict[str, Any]) -> DataFrame:
    """(query_id, model, response, error): each model's raw answer to the same prompt; one row for each query and model."""
    out = None
    for name, model in models.items():
        said = state.queries.select("query_id", F.lit(name).alias("model"), model(prompt).alias("said")).select("query_id", "model", F.trim("said.text").alias("response"), F.col("said.error").alias("error"))
        out = said if out is None else out.unionByName(said)
    return out
