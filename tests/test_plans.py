"""Workflows, runners, seeds, sources, sinks and streams with a deterministic model."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import traces
from millrace.plans import components, prompts, runners, seeds, workflow
from millrace.plans.components import Services
from millrace.plans.providers import client_of, scripted
from millrace.sources import readers, sinks
from millrace.streaming import streams

MODEL = scripted(
    plan="REASONING: wide\nSUB-GOALS:\n1. goal one of {query}\n2. red cars and boats",
    formulate='{"queries": ["red cars", "blue boats"]}',
    draft="REASONING: seen\nANSWER: red cars are fast",
    choose='REASONING: ok\nDECISION: ["opensearch_retriever", "answer_drafter"]',
    verify='{"verified": true}',
)


def services(spark):
    texts = ["red cars are fast cars on long roads today", "blue boats are slow boats on wide rivers", "red cars are fast cars on long roads at night", "green trees"]
    return Services(model=MODEL, corpus=spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, text string"))


def asked(spark):
    return spark.createDataFrame([("q1", "red cars"), ("q2", "blue boats")], "query_id string, query string")


def test_shipped_workflows_are_sound():
    assert [w["id"] for w in workflow.catalog()] == ["planned_rag", "simple_rag"]
    assert all(not workflow.problems(workflow.loaded(w["id"])) for w in workflow.catalog())
    bad = workflow.parsed({"id": "x", "name": "x", "components": [{"type": "odd"}, {"type": "filter", "config": {"nope": 1}}]})
    assert workflow.problems(bad) == ["unknown component odd", "filter has no setting nope"]
    with pytest.raises(ValueError):
        workflow.parsed({"id": "x", "name": "x"})
    assert len(components.REGISTRY) == 14 and components.categories()["control"] == ["condition"]


def test_planned_workflow(spark):
    state = workflow.executed(workflow.loaded("planned_rag"), asked(spark), services(spark))
    rows = {r.query_id: r for r in state.queries.collect()}
    assert rows["q1"].subgoals == ["goal one of red cars", "red cars and boats"] and rows["q1"].formulated == ["red cars", "blue boats"]
    assert rows["q2"].final == "red cars are fast"
    steps = state.steps.where("query_id = 'q1'").orderBy("seq").collect()
    assert [s.component for s in steps] == [p["type"] for p in workflow.loaded("planned_rag").components]
    assert all(s.verdict == "PROCEED" for s in steps) and steps[0].thought == "wide" and steps[0].tokens > 0
    evidence = state.evidence.where("query_id = 'q1'").orderBy("pos").collect()
    assert [e.pos for e in evidence] == list(range(len(evidence))) and len({e.id for e in evidence}) == len(evidence) >= 2
    line = traces.supervised(state.steps.withColumnRenamed("query_id", "run_id")).count()
    assert line == 6


def test_missing_services_raise_and_empty_answers_fail(spark):
    with pytest.raises(ValueError):
        workflow.executed(workflow.loaded("simple_rag"), asked(spark), Services())
    mute = services(spark)
    mute.model = scripted(draft="  ")
    state = workflow.executed(workflow.loaded("simple_rag"), asked(spark), mute)
    last = {r.component: r for r in state.steps.where("query_id = 'q1'").collect()}
    assert last["answer_drafter"].verdict == "FAIL" and last["answer_drafter"].error == "Empty answer generated" and last["finalizer"].stop_condition == "ERROR"


def test_standard_runner_stops_what_is_good_enough(spark):
    samples = asked(spark).withColumn("gold_answer", F.when(F.col("query_id") == "q1", "red cars are fast").otherwise("something else"))
    results, steps = runners.standard(workflow.loaded("simple_rag"), samples, services(spark), 2, 0.6, "token_overlap", verifier=MODEL)
    got = {r.query_id: (r.iteration, r.success, round(r.similarity, 3)) for r in results.collect()}
    assert got == {"q1": (1, True, 1.0), "q2": (2, False, 0.0)}
    assert {(r.query_id, r.iteration) for r in steps.collect()} == {("q1", 1), ("q2", 1), ("q2", 2)}


def test_adaptive_runner(spark):
    samples = asked(spark).withColumn("gold_answer", F.when(F.col("query_id") == "q1", "red cars are fast").otherwise("something else"))
    flow = workflow.loaded("simple_rag")

    def run(choose, rounds, of=samples):
        model = scripted(draft="REASONING: seen\nANSWER: red cars are fast", choose=choose)
        held = services(spark)
        held.model = model
        state, results = runners.adaptive(flow, of, held, model, rounds, 0.6)
        return state, {r.query_id: (r.iteration, r.answer, r.similarity, r.success) for r in results.collect()}

    # q1 meets its gold answer in the first round, q2 never does.
    _, got = run('REASONING: ok\nDECISION: ["opensearch_retriever", "answer_drafter"]', 2)
    assert got == {"q1": (1, "red cars are fast", 1.0, True), "q2": (2, "red cars are fast", 0.0, False)}
    # finish among others is dropped and the others run; without a gold answer any answer passes.
    _, got = run('["opensearch_retriever", "answer_drafter", "finish"]', 3, asked(spark))
    assert got == {q: (1, "red cars are fast", 1.0, True) for q in ("q1", "q2")}
    # finish alone, nothing and nonsense end a query; no answer never passes, even against no gold answer.
    for choose in ('["finish"]', "[]", "well"):
        state, got = run(choose, 3)
        assert got == {q: (1, None, 0.0, False) for q in ("q1", "q2")} and state.steps.isEmpty()
    state, got = run('REASONING: look\nDECISION: ["opensearch_retriever", "odd"]', 2, asked(spark))
    assert got == {q: (2, None, 0.0, False) for q in ("q1", "q2")}
    steps = [(r.component, r.thought) for r in state.steps.where("query_id = 'q1'").orderBy("seq").collect()]
    assert [c for c, _ in steps] == ["opensearch_retriever", "teacher_decision", "opensearch_retriever"] and steps[1][1] == "look"


def test_a_failed_query_goes_no_further_if_asked_to_stop(spark):
    def model(prompt):  # only one query gets an answer
        said = scripted(draft="ANSWER: fine")(prompt)
        return said.withField("text", F.when(prompt.contains("Question: red cars"), said["text"]).otherwise(F.lit(" ")))

    held = services(spark)
    held.model = model
    flow = workflow.parsed({"id": "x", "name": "x", "components": [{"type": "opensearch_retriever"}, {"type": "answer_drafter"}, {"type": "odd"}, {"type": "finalizer"}], "config": {"stop_on_error": True}})
    tools = lambda state, q: [(r.component, r.verdict) for r in state.steps.where(F.col("query_id") == q).orderBy("seq").collect()]
    state = workflow.executed(flow, asked(spark), held)
    assert tools(state, "q2") == [("opensearch_retriever", "PROCEED"), ("answer_drafter", "FAIL")]
    assert tools(state, "q1") == [("opensearch_retriever", "PROCEED"), ("answer_drafter", "PROCEED"), ("odd", "FAIL")]
    assert state.queries.count() == 2
    state = workflow.executed(flow, asked(spark), held, stop_on_error=False)
    assert [c for c, _ in tools(state, "q2")] == ["opensearch_retriever", "answer_drafter", "odd", "finalizer"] and tools(state, "q1")[-1] == ("finalizer", "PROCEED")
    rows = {r.query_id: r for r in state.summary().collect()}
    assert rows["q1"].has_answer and not rows["q2"].has_answer and (rows["q1"].errors, rows["q1"].step_count) == (1, 4) and rows["q1"].evidence_count == 2
    assert state.found("q1", "d0").count() == 1 and state.found("q1", "d1").count() == 0


def test_consultants_answer_beside_a_component(spark):
    def broken(prompt):
        return F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("usage"), F.lit("no answer").alias("error"))

    held = services(spark)
    held.models = {"a": lambda p: F.struct(F.concat(F.lit("  by a: "), F.length(p).cast("string")).alias("text"), F.lit("{}").alias("usage"), F.lit(None).cast("string").alias("error")), "b": broken}
    held.consultants = {"answer_drafter": ["a", "b", "unknown"], "finalizer": ["a"]}
    state = workflow.executed(workflow.loaded("simple_rag"), asked(spark), held)
    told = {r.component: json.loads(r.data) for r in state.steps.where("query_id = 'q1'").collect()}
    a, b = told["answer_drafter_consultants"]["consultants"]
    assert a["model"] == "a" and a["answer"].startswith("by a: ") and b == {"model": "b", "error": "no answer"}
    assert told["finalizer_consultants"] == {"skipped": True}


def test_run_settings_and_teachers(spark):
    steps = spark.createDataFrame([("r1", 1, "planner", "{}"), ("r1", 2, "chatnoir_retriever", '{"corpus": "web"}'), ("r2", 1, "planner", '{"corpus": "no"}')], "run_id string, seq long, component string, tool_input string")
    runs = spark.createDataFrame([("r1", "m", "q", "a"), ("r2", "m", "p", None)], "run_id string, teacher_id string, query string, expected_answer string")
    rows = {r.run_id: r for r in traces.run_settings(steps, runs, ["planner", "answer_drafter"], 0.6, 4, "opensearch", "wiki").collect()}
    assert (rows["r1"].search_endpoint, rows["r1"].search_index) == ("chatnoir", "web") and (rows["r2"].search_endpoint, rows["r2"].search_index) == ("opensearch", "wiki")
    assert rows["r1"].workflow_config.asDict(True) == {"blocks": [{"type": "planner", "label": "Planner", "llm_decided": False}, {"type": "answer_drafter", "label": "Answer Drafter", "llm_decided": False}], "answer_match_threshold": 0.6, "max_iterations": 4}
    models = spark.createDataFrame([("r1", "big"), ("r1", "big"), ("r9", "x")], "run_id string, teacher_model string")
    assert {(r.run_id, r.teacher_model) for r in traces.with_teacher(runs, models).collect()} == {("r1", "big"), ("r2", None)}


def test_iterative_runner(spark):
    finals, steps = runners.iterative(workflow.loaded("simple_rag"), asked(spark), services(spark), 3)
    assert {(r.query_id, r.iteration) for r in finals.collect()} == {("q1", 1), ("q2", 1)} and steps.agg(F.max("iteration")).first()[0] == 1


def test_exploration_is_breadth_first_with_a_budget(spark):
    table = {"a": ["b", "c", "b"], "b": ["a", "d"], "c": ["d", "e"], "d": ["a"], "e": ["f"], "f": []}
    edges = spark.createDataFrame([(q, i, x) for q, out in table.items() for i, x in enumerate(out)], "query string, place int, question string")
    starts = {"s1": "a", "s2": "d", "s3": "f"}
    got = runners.explored(spark.createDataFrame(list(starts.items()), "seed_id string, query string"), lambda head: head.join(edges, "query"), 5)
    found = {}
    for r in got.orderBy("seed_id", "iteration").collect():
        found.setdefault(r.seed_id, []).append(r.query)
    want = {}
    for s, start in starts.items():
        queue, done = [start], []
        while queue and len(done) < 5:
            q = queue.pop(0)
            if q not in done:
                done.append(q)
                queue += [x for x in table[q] if x not in done]
        want[s] = done
    assert found == want


def test_exploratory_runner(spark):
    model = scripted(draft="ANSWER of {query}", reflect='```json\n["blue boats", "red cars", " "]\n```')
    held = services(spark)
    held.model = model
    start = spark.createDataFrame([("s", "red cars"), ("t", "green trees")], "seed_id string, query string")
    short = workflow.parsed({"id": "x", "name": "x", "components": [{"type": "opensearch_retriever"}, {"type": "answer_drafter"}]})
    how = runners.Exploration(3, consultants={"c": scripted(reflect='["wide rivers"]'), "d": scripted(reflect="no list")})
    log, evidence, steps = runners.exploratory(short, start, held, model, how)
    got = {}
    for r in log.orderBy("seed_id", "iteration").collect():
        got.setdefault(r.seed_id, []).append(r.query)
    assert got == {"s": ["red cars", "blue boats", "wide rivers"], "t": ["green trees", "blue boats", "red cars"]}
    first = log.where("seed_id = 's' and iteration = 1").first()
    assert first.answer == "ANSWER of red cars" and sorted(first.doc_ids) == ["d0", "d2"] and first.evidence_count == 2
    assert (first.mode_used, first.iterations_taken, first.similarity_score, first.external_verification) == ("standard", 1, 0.0, None)
    assert first.teacher_questions == ["blue boats", "red cars"] and first.consultant_questions == ["wide rivers"]
    assert steps.where("component = 'answer_drafter'").count() == 6 and evidence.where("seed_id = 's'").count() > 0
    counts = {r.component: r["count"] for r in steps.where("seed_id = 's'").groupBy("component").count().collect()}
    assert counts == {"opensearch_retriever": 3, "answer_drafter": 3, "reflection": 3, "consultant_reflection": 3, "knowledge_base": 2}


def test_exploration_by_chosen_modes_and_with_an_external_answer(spark):
    def model(prompt):  # the mode depends on the question
        plain = scripted(draft="red cars are fast", reflect="[]", choose='["answer_drafter"]', external="Red cars are fast cars.")(prompt)
        mode = F.when(prompt.contains("boats"), " Adaptive\n").otherwise("neither")
        return F.when(prompt.startswith("Choose how"), plain.withField("text", mode)).otherwise(plain)

    held = services(spark)
    held.model = model
    start = spark.createDataFrame([("s", "red cars"), ("t", "blue boats")], "seed_id string, query string")
    short = workflow.parsed({"id": "x", "name": "x", "components": [{"type": "opensearch_retriever"}, {"type": "answer_drafter"}]})
    log, _, steps = runners.exploratory(short, start, held, model, runners.Exploration(1, mode="auto", external=model, max_iterations=2))
    rows = {r.seed_id: r for r in log.collect()}
    assert {s: r.mode_used for s, r in rows.items()} == {"s": "standard", "t": "adaptive"}
    assert rows["s"].external_verification.asDict() == {"verified": True, "confidence": 0.85, "external_answer": "Red cars are fast cars."}
    assert 0 < rows["s"].similarity_score < 1 and rows["s"].similarity_score == pytest.approx(rows["t"].similarity_score if rows["t"].answer else rows["s"].similarity_score)
    assert steps.where("component = 'external_verification'").count() == 2
    plain, _, _ = runners.exploratory(short, start, held, model, runners.Exploration(1, mode="once"))
    assert {(r.mode_used, r.iterations_taken, r.answer) for r in plain.collect()} == {("once", 0, "red cars are fast")}


@pytest.mark.parametrize("held", [1, 3, 64])
def test_greedy_seeds_against_a_literal_model(spark, monkeypatch, held):
    r = random.Random(0)
    n = 40
    vectors = np.array([[r.gauss(0, 1) for _ in range(4)] for _ in range(n)])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    clusters, docs = [r.randrange(5) for _ in range(n)], [[str(r.randrange(60)) for _ in range(r.randrange(6))] for _ in range(n)]
    seen, picked, cycle, turn = {"1", "2"}, [], list(dict.fromkeys(clusters)), 0
    while len(picked) < 15 and cycle:
        c, best, top = cycle[turn % len(cycle)], None, -1e9
        for i in range(n):
            if clusters[i] != c or i in picked or not docs[i] or len(set(docs[i]) & seen) / len(docs[i]) > 0.6:
                continue
            gain = len(set(docs[i]) - seen)
            score = gain if not picked else 0.7 * gain - 0.3 * max(float(vectors[i] @ vectors[j]) for j in picked)
            if score > top:
                best, top = i, score
        if best is None:
            cycle.remove(c)
            continue
        picked.append(best)
        seen |= set(docs[best])
        turn += 1
    rows = [(f"q{i:02}", [float(x) for x in vectors[i]], clusters[i], docs[i] or None) for i in range(n)]
    df = spark.createDataFrame(rows, "query string, vector array<double>, cluster int, doc_ids array<string>").repartition(3)
    monkeypatch.setattr(seeds, "HELD", held)
    got = seeds.selected(df, spark.createDataFrame([("1",), ("2",), ("999",)], "doc_id string"), 15, 0.6, 0.7)
    assert [int(r.query[1:]) for r in got.orderBy("pick").collect()] == picked


def test_no_seeds_without_candidates(spark):
    none = spark.createDataFrame([], "query string, vector array<double>, cluster int, doc_ids array<string>")
    assert seeds.selected(none, spark.createDataFrame([], "doc_id string")).count() == 0


def test_candidates(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "Train.jsonl").write_text('{"query": " a "}\n\n{"query": "", "question": "b"}\nbad\n{"x": 1}\n')
    (tmp_path / "train_map.json").write_text(json.dumps({"query": {"1": "c", "2": " "}}))
    (tmp_path / "train_keys.json").write_text(json.dumps({"d": 1, "e": {"z": 2}}))
    (tmp_path / "train_list.json").write_text(json.dumps([{"text": "f"}, {"question": "g", "query": None}]))
    (tmp_path / "train_lines.json").write_text('{"query": "h"}\n{"text": "i"}\n')
    (tmp_path / "test.jsonl").write_text('{"query": "never"}\n')
    assert sorted(r.query for r in readers.candidates(spark, str(tmp_path), "train").collect()) == list("abcdefghi")
    assert [r.query for r in readers.candidates(spark, str(tmp_path), "train", 2).orderBy("query").collect()] == ["a", "b"]


def test_readers(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text("\n".join(json.dumps({"query": f"q{i}", "answer": "x" if i % 2 else "y"}) for i in range(20)) + "\n\nbad\n")
    assert [r.query for r in readers.qa_dataset(spark, f"{tmp_path}/qa.jsonl", 3).orderBy("sample_no").collect()] == ["q0", "q1", "q2"]
    assert readers.qa_dataset(spark, f"{tmp_path}/qa.jsonl").count() == 20
    assert readers.qa_dataset(spark, f"{tmp_path}/qa.jsonl", 5, "random").count() == 5
    assert readers.qa_dataset(spark, f"{tmp_path}/qa.jsonl", 10, "stratified", strata="answer").count() <= 20
    (tmp_path / "prior.jsonl").write_text('{"doc_id": "a"}\n{"doc_id": "a"}\nbad\n{"x": 1}\n')
    assert [r.doc_id for r in readers.prior_documents(spark, f"{tmp_path}/prior.jsonl").collect()] == ["a"]
    assert readers.prior_documents(spark, None).count() == 0
    for name, n in (("c", 5), ("a", 1), ("b", 30)):
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / f"{name}.jsonl").write_text("\n".join(json.dumps({"query": f"{name}{i:02}"}) for i in range(n)) + "\n")
    every = [f"{name}{i:02}" for name, n in (("a", 1), ("b", 30), ("c", 5)) for i in range(n)]
    got = readers.qa_dataset(spark, f"{tmp_path}/many").orderBy("sample_no").collect()
    assert [(r.sample_no, r.query) for r in got] == list(enumerate(every, 1))
    assert [r.query for r in readers.qa_dataset(spark, f"{tmp_path}/many", 3).orderBy("sample_no").collect()] == every[:3]
    assert {r.query for r in readers.candidates(spark, f"{tmp_path}/many", "", 33).collect()} == set(every[:33])
    with gzip.open(tmp_path / "corpus.jsonl.gz", "wt") as f:
        for i in range(6):
            f.write(json.dumps({"turn": i, "component": "planner", "_source": {"run_id": f"r{i % 2}", "dataset": f"d{i % 3}", "sample_id": "s"}}) + "\n")
    assert readers.corpus(spark, f"{tmp_path}/corpus.jsonl.gz", ("d1",), ("r1",)).count() == 1
    assert readers.search_base_url("h") == "http://h:9200" and readers.search_base_url("https://h") == "https://h:443" and readers.search_base_url("h:1") == "http://h:1"
    bodies = spark.createDataFrame([("a", '{"data": [{"id": "m1"}]}'), ("b", '{"models": [{"name": "m2", "size": 2147483648}]}'), ("c", "bad")], "endpoint string, body string")
    assert {tuple(r) for r in readers.discovered_models(bodies).collect()} == {("a", "m1", None), ("b", "m2", "2.00")}


def test_external_search(spark):
    def search(query, k):
        if query == "down":
            raise OSError("no answer")
        return [{"id": f"{query}{i}" if i else " ", "text": "t", "title": None, "score": 1.0} for i in range(k)]

    queries = spark.createDataFrame([("1", "a"), ("2", "down")], "query_id string, query string")
    assert [(r.query_id, r.rank, r.id) for r in readers.external_search(queries, search, 3).orderBy("rank").collect()] == [("1", 1, "a1"), ("1", 2, "a2")]


def test_exports_replace_their_own_runs_and_seeds(spark, tmp_path):
    steps = spark.createDataFrame([(f"r{i % 2}", i, i, "planner", "PROCEED", "CONTINUE", "", "in", "out", 1, 2, 1.0, None, "{}") for i in range(4)], "run_id string, seq long, turn int, component string, verdict string, stop_condition string, rationale_tag string, llm_input string, llm_output string, tokens long, evidence_count long, execution_time_ms double, error string, tool_input string")
    runs, at = steps.select("run_id").distinct(), F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    sinks.export_runs(steps, runs, f"{tmp_path}/runs", at)
    sinks.export_runs(steps.where("run_id = 'r1'").limit(1), runs.where("run_id = 'r1'"), f"{tmp_path}/runs", at)
    counts = {r.run_id: r["count"] for r in spark.read.json(f"{tmp_path}/runs/traces").groupBy("run_id").count().collect()}
    assert counts == {"r0": 2, "r1": 1}
    log = spark.createDataFrame([("s", 1, "q", "a", ["d"]), ("t", 1, "p", "", ["d", "e"])], "seed_id string, iteration int, query string, answer string, doc_ids array<string>")
    sinks.export_explorations(log, f"{tmp_path}/out")
    sinks.export_explorations(log.where("seed_id = 's'").withColumn("query", F.lit("new")), f"{tmp_path}/out")
    assert {(r.seed_id, r.query) for r in spark.read.json(f"{tmp_path}/out/explorations").collect()} == {("s", "new"), ("t", "p")}
    assert spark.read.json(f"{tmp_path}/out/summary").first().unique_docs == 2
    by_seed = {(r.seed_id, r.doc): (r.frequency, r.queries_found_in) for r in spark.read.json(f"{tmp_path}/out/documents_by_seed").collect()}
    assert by_seed == {("s", "d"): (1, ["new"]), ("t", "d"): (1, ["p"]), ("t", "e"): (1, ["p"])}
    sinks.write_seeds(log, f"{tmp_path}/seeds", "set", "train")
    assert spark.read.json(f"{tmp_path}/seeds").count() == 2
    sinks.record_completed(spark, spark.createDataFrame([("a",)], "sample_id string"), f"{tmp_path}/ledger")
    left = traces.pending(spark.createDataFrame([("a",), ("b",)], "sample_id string"), spark.read.json(f"{tmp_path}/ledger"))
    assert [r.sample_id for r in left.collect()] == ["b"]


def test_written_tables_are_released(spark):
    from millrace.sources.shared import release, shared_folder, written

    release(spark)
    df = written(spark.range(3), "some")
    assert df.count() == 3 and shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert release(spark) == 1 and release(spark) == 0


def test_prompts():
    assert prompts.names() == ["choose", "consult", "draft", "external", "formulate", "mode", "plan", "reflect", "verify"]
    assert prompts.variables("formulate") == ["queries_per_subgoal", "query", "subgoals"]
    assert prompts.info("draft")["lines"] > 3
    with pytest.raises(ValueError):
        prompts.render("draft")
    with pytest.raises(ValueError):
        client_of("cohere", "http://x", "m")


def test_append_goes_on_where_it_ended(spark, tmp_path):
    rows = spark.range(5).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        streams.appended(streams.event_stream(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == 5
