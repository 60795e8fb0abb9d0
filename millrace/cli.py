"""Command line: list, validate, components, info, run, simulate, discover and seed-select."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence
from pathlib import Path

VERSION = "0.1.0"
#: Settings from the environment with their defaults.
SETTINGS = {"LLM_TIMEOUT": 60, "LLM_MAX_TOKENS": 4096, "MAX_ITERATIONS": 5, "SIMILARITY_THRESHOLD": 0.6}


def setting(name: str):
    """A setting of the default's type; keys of services are read where they are used and never printed."""
    default = SETTINGS[name]
    return type(default)(os.environ.get(name, default))


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _services(spark, args):
    from .plans.components import Services
    from .plans.providers import client_of, completion

    model = None
    if args.model:
        provider = args.provider or "custom"
        make = client_of(provider, args.base_url, args.model, os.environ.get("LLM_API_KEY"), setting("LLM_TIMEOUT"))
        model = lambda prompt: completion(make, prompt)
    corpus = spark.read.parquet(args.corpus).selectExpr(f"cast({args.corpus_id} as string) as id", "text") if args.corpus else None
    return Services(model=model, corpus=corpus, web=corpus)


def _list(args) -> int:
    from .plans.workflow import catalog

    for w in catalog():
        print(f"{w['id']}: {w.get('error') or w['name'] + ' - ' + w['description']}")
    return 0


def _components(args) -> int:
    from .plans.components import categories

    held = categories()
    if args.category and args.category not in held:
        print(f"unknown category {args.category}", file=sys.stderr)
        return 1
    for category, names in held.items():
        if args.category in (None, category):
            print(f"{category}: {', '.join(names)}")
    return 0


def _info(args) -> int:
    from .plans.components import categories

    print(f"millrace {VERSION}")
    for category, names in categories().items():
        print(f"{category}: {len(names)}")
    return 0


def _validate(args) -> int:
    import yaml

    from .plans.workflow import FOLDER, parsed, problems

    path = Path(args.workflow) if Path(args.workflow).exists() else FOLDER / f"{args.workflow}.yaml"
    try:
        found = problems(parsed(yaml.safe_load(path.read_text(encoding="utf-8"))))
    except (OSError, ValueError) as e:
        found = [str(e)]
    print("\n".join(found) or "valid")
    return int(bool(found))


def _run(args) -> int:
    from pyspark.sql import functions as F

    from .plans.workflow import executed, loaded

    spark = _session()
    queries = spark.createDataFrame([("0", args.query)], "query_id string, query string")
    state = executed(loaded(args.workflow), queries, _services(spark, args))
    row = state.queries.select("query", F.coalesce("final", "draft").alias("answer")).first()
    out = {"workflow": args.workflow, "query": row["query"], "answer": row["answer"], "evidence_count": state.evidence.count(), "steps": state.seq, "success": row["answer"] is not None}
    if args.output:
        Path(args.output).write_text(json.dumps(out, ensure_ascii=False, indent=2), encoding="utf-8")
    else:
        print(json.dumps(out, ensure_ascii=False))
    return 0


def _model_of(spec, args, external: bool = False):
    """The model of a template, called at its provider's address, or at --base-url for servers of one's own."""
    from .plans.providers import ADDRESSES, client_of, completion

    provider = args.provider or _provider(spec.model_id)
    key = os.environ.get(f"{provider.upper()}_API_KEY") or os.environ.get("LLM_API_KEY")
    make = client_of(provider, args.base_url if args.provider or provider not in ADDRESSES else None, spec.model_id, key, setting("LLM_TIMEOUT"), 0.1 if external else spec.temperature, setting("LLM_MAX_TOKENS"))
    return lambda prompt: completion(make, prompt)


def _provider(model_id: str) -> str:
    """The provider that a model's name points to; see ``functions.text.provider_of``."""
    from pyspark.sql import functions as F

    from .functions.text import provider_of

    return _session().range(1).select(provider_of(F.lit(model_id)).alias("p")).first()["p"]


def _samples(spark, dataset):
    from pyspark.sql import functions as F

    from .functions.text import sample_id
    from .sources import readers

    n = dataset.num_samples
    strategy = {"sequential": "head"}.get(dataset.sample_strategy, dataset.sample_strategy)
    rows = readers.qa_dataset(spark, dataset.path, n, strategy, strata="answer" if strategy == "stratified" else None)
    return rows.select(sample_id(F.col("sample_no") + (0 if n > 0 else 1)).alias("query_id"), F.coalesce("query", "question").alias("query"), F.coalesce("answer", "gold_answer").alias("gold_answer"), F.coalesce("seed_id", "uid").alias("seed_id")).where("query is not null")


def _simulate(args) -> int:
    """A template, or a workflow over a dataset in standard mode."""
    from .plans.runners import Dataset, Metric, Template, template_loaded

    if args.dataset:
        template = Template(args.workflow, args.workflow, workflows=[args.workflow], datasets=[Dataset("data", args.dataset, args.num_samples)], max_iterations=setting("MAX_ITERATIONS"), threshold=setting("SIMILARITY_THRESHOLD"), metric=Metric(args.metric or "token_overlap"), output_dir=args.output or "simulation_output")
        return _simulated(_session(), template, {"": _services(_session(), args)}, None, None, args)
    template = template_loaded(args.workflow)
    if found := template.problems():
        print("\n".join(found), file=sys.stderr)
        return 1
    template.output_dir = args.output or template.output_dir
    spark, teachers = _session(), {}
    others = {m.name: _model_of(m, args) for m in template.consultants}
    for m in template.teachers:
        held = teachers[m.name] = _services(spark, args)
        held.model, held.models, held.consultants = _model_of(m, args), others, template.consulted
    checked = template.verifier if template.verification.get("enabled", True) else None
    return _simulated(spark, template, teachers, _model_of(checked, args) if checked else None, _model_of(template.verifier or template.teachers[0], args, True), args)


def _simulated(spark, template, teachers, verifier, external, args) -> int:
    """Runs of every teacher, workflow and dataset; results and traces go below the output folder."""
    from pyspark.sql import functions as F

    from .operators.traces import pending, run_settings
    from .plans.runners import Mode, adaptive, exploratory, standard
    from .plans.workflow import loaded
    from .sources import sinks
    from .sources.shared import written

    for (teacher, services), flow, dataset in ((t, loaded(w), d) for t in teachers.items() for w in template.workflows for d in template.datasets):
        out = "/".join(filter(None, (template.output_dir, *((teacher, flow.id, dataset.name) if teacher else ()))))
        samples, ledger = _samples(spark, dataset), f"{out}/ledger"
        if args.resume:
            done = spark.read.schema("sample_id string, status string, completed boolean").json(ledger)
            samples = pending(samples.withColumnRenamed("query_id", "sample_id"), done).withColumnRenamed("sample_id", "query_id")
        samples = written(samples, "samples")
        if template.mode is Mode.EXPLORATORY:
            seeds = samples.select(F.coalesce("seed_id", "query_id").alias("seed_id"), "query")
            log, _, steps = exploratory(flow, seeds, services, services.model, template.exploration(services.models, external))
            sinks.export_explorations(log.select("seed_id", "iteration", "query", "answer", "doc_ids", "evidence_count", "iterations_taken", "similarity_score", "mode_used"), out)
            runs = steps.withColumn("run_id", F.replace("query_id", F.lit("\u0001"), F.lit("_"))).drop("query_id", "seed_id")
        elif template.mode is Mode.ADAPTIVE:
            state, results = adaptive(flow, samples, services, services.model, template.max_iterations, template.threshold)
            runs = state.steps.withColumnRenamed("query_id", "run_id")
        else:
            results, steps = standard(flow, samples, services, template.max_iterations, template.threshold, template.metric.value, verifier)
            runs = steps.withColumn("run_id", F.concat_ws("_", "query_id", "iteration")).drop("query_id", "iteration")
        if template.mode is not Mode.EXPLORATORY:
            results = written(results, "results")
            results.write.mode("append").json(f"{out}/results")
        runs = written(runs.withColumn("tool_input", F.lit("{}")), "runs")
        ids = runs.select("run_id").distinct()
        asked = samples.select(F.col("query_id").alias("q"), "query", F.col("gold_answer").alias("expected_answer"))
        of = F.col("run_id") if template.mode is Mode.ADAPTIVE else F.regexp_replace("run_id", r"_\d+$", "")
        named = ids.join(asked, of == F.col("q"), "left")
        teacher_id = next((m.model_id for m in template.teachers if m.name == teacher), "unknown")
        settings = run_settings(runs, named.withColumn("teacher_id", F.lit(teacher_id)), [p["type"] for p in flow.components], template.threshold, template.max_iterations, template.retrieval.get("type", "chatnoir"), template.retrieval.get("corpus") or "cw12")
        sinks.export_runs(runs, ids, out, F.current_timestamp(), streamed=True, settings=settings)
        sinks.record_completed(spark, samples.select(F.col("query_id").alias("sample_id")), ledger)
    return 0


def _discover(args) -> int:
    from urllib.request import urlopen

    asked = [(u, "/v1/models") for u in args.custom or []] + [(u, "/api/tags") for u in args.ollama or []]
    if not asked:
        print("name an endpoint with --custom or --ollama", file=sys.stderr)
        return 1
    from .sources.readers import discovered_models, model_table

    bodies = []
    for base, path in asked:
        try:
            with urlopen(base.rstrip("/") + path, timeout=10) as answer:
                bodies.append((base, answer.read().decode()))
        except OSError:
            bodies.append((base, "{}"))
    for row in model_table(discovered_models(_session().createDataFrame(bodies, "endpoint string, body string"))).collect():  # a list of models
        print(row["line"])
    return 0


def _seed_select(args) -> int:
    from pyspark.sql import functions as F

    from .operators.retrieval import bm25_top_k, top_k_map
    from .plans.seeds import clustered, selected
    from .sources import readers, sinks

    spark = _session()
    queries = readers.candidates(spark, args.data_dir, args.split, args.max_candidates).select("query").distinct()
    vectors = spark.read.parquet(args.embeddings).select("query", "vector")
    corpus = spark.read.parquet(args.corpus).selectExpr(f"cast({args.corpus_id} as string) as id", "text")
    asked = queries.select(F.col("query").alias("query_id"), "query")
    docs = top_k_map(bm25_top_k(corpus, asked, args.top_k).withColumnRenamed("query_id", "query"))
    rows = clustered(queries.join(vectors, "query"), args.clusters).join(docs, "query", "left")
    picks = selected(rows, readers.prior_documents(spark, args.prior), args.num_seeds, args.novelty, args.mmr_lambda)
    sinks.write_seeds(picks, args.output, args.dataset, args.split)
    return 0


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="millrace")
    sub = parser.add_subparsers(dest="command")

    def command(name, call, *arguments):
        p = sub.add_parser(name)
        p.set_defaults(call=call)
        for flags, how in arguments:
            p.add_argument(*flags, **how)

    model = [(("--model",), {}), (("--provider",), {}), (("--base-url",), {"default": "http://localhost:8000"}), (("--corpus",), {}), (("--corpus-id",), {"default": "doc_id"})]
    command("list", _list)
    command("components", _components, (("--category",), {}))
    command("info", _info)
    command("validate", _validate, (("workflow",), {}))
    command("run", _run, (("workflow",), {}), (("query",), {}), (("--output",), {}), *model)
    command("simulate", _simulate, (("workflow",), {"help": "a workflow, or a simulation template without a dataset"}), (("dataset",), {"nargs": "?"}), (("--output",), {}), (("--num-samples",), {"type": int, "default": 0}), (("--metric",), {}), (("--resume",), {"action": "store_true"}), *model)
    command("discover", _discover, (("--custom",), {"nargs": "*"}), (("--ollama",), {"nargs": "*"}))
    command(
        "seed-select", _seed_select, (("data_dir",), {}), (("--split",), {"default": "train"}), (("--dataset",), {"default": "data"}), (("--embeddings",), {"required": True}), (("--corpus",), {"required": True}), (("--corpus-id",), {"default": "doc_id"}), (("--prior",), {}), (("--output",), {"required": True}),
        (("--num-seeds",), {"type": int, "default": 1000}), (("--clusters",), {"type": int, "default": 100}), (("--top-k",), {"type": int, "default": 20}), (("--max-candidates",), {"type": int, "default": 50_000}), (("--novelty",), {"type": float, "default": 0.6}), (("--mmr-lambda",), {"type": float, "default": 0.7}),
    )
    return parser


def main(argv: Sequence[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if not args.command:
        _parser().print_help()
        return 1
    return args.call(args)


if __name__ == "__main__":
    sys.exit(main())
