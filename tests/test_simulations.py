"""Simulation templates, model clients against a local server, and the command that runs templates."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from millrace import cli
from millrace.plans import runners
from millrace.plans.providers import client_of


class Answers(BaseHTTPRequestHandler):
    """Answers as the providers do; the text depends on the prompt's first words."""

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if "generateContent" in self.path:
            said = {"candidates": [{"content": {"parts": [{"text": "from "}, {"text": self.path.split("/")[-1]}]}}], "usageMetadata": {"promptTokenCount": 2, "candidatesTokenCount": 3}}
        elif self.path == "/v1/messages":
            said = {"content": [{"type": "text", "text": f"key {self.headers['x-api-key']}"}], "usage": {"input_tokens": body["max_tokens"], "output_tokens": 1}}
        else:
            prompt = body["messages"][0]["content"]
            text = {"Choose which": 'REASONING: so\nDECISION: ["opensearch_retriever", "answer_drafter", "finish"]', "Choose how": "adaptive", "Given what": '["red boats"]', "Answer from your": "Red cars are quick."}
            said = {"choices": [{"message": {"content": next((t for s, t in text.items() if prompt.startswith(s)), "REASONING: r\nANSWER: red cars")}}], "usage": {"total_tokens": 5}}
        out = json.dumps(said).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    held = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}"
    held.shutdown()


def test_clients(server):
    assert client_of("anthropic", server, "m", "k", max_tokens=7)()("hi") == {"text": "key k", "usage": {"input_tokens": 7, "output_tokens": 1}}
    assert client_of("google", server, "g-1", "k")()("hi") == {"text": "from g-1:generateContent", "usage": {"promptTokenCount": 2, "candidatesTokenCount": 3}}
    for provider in ("openai", "mistral", "custom", "ollama"):
        assert client_of(provider, server, f"{provider}/m")()("hi")["text"].endswith("ANSWER: red cars")
    for provider, base in (("cohere", server), ("custom", None)):
        with pytest.raises(ValueError):
            client_of(provider, base, "m")


RAW = {"id": "t", "name": "T", "workflows": ["simple_rag"], "datasets": [{"name": "d", "path": "p"}]}


def test_templates_take_models_from_the_environment():
    env = {"TEACHER_MODELS": "gpt-a, claude-b", "CONSULTANT_MODELS": "mistral-c,", "VERIFIER_MODEL": "gpt-d", "MAX_ITERATIONS": "3"}
    t = runners.template_of(RAW, env)
    assert [(m.name, m.model_id) for m in t.teachers] == [("teacher_0", "gpt-a"), ("teacher_1", "claude-b")]
    assert [(m.name, m.role) for m in t.consultants] == [("mistral", "consultant")] and t.verifier.model_id == "gpt-d" and t.max_iterations == 3
    assert t.problems() == [] and t.mode is runners.Mode.STANDARD and t.datasets[0].num_samples == -1
    named = runners.template_of(RAW | {"teacher_models": [{"name": "x", "model_id": "m", "role": "teacher", "api_key": "ignored"}], "mode": "adaptive", "similarity_metric": "bleu", "similarity_threshold": 0.9}, env)
    assert [m.name for m in named.teachers] == ["x"] and named.metric is runners.Metric.BLEU and named.threshold == 0.9 and not hasattr(named.teachers[0], "api_key")


def test_problems_of_templates(tmp_path):
    (tmp_path / "open.yaml").write_text("id: open\nname: open\ncomponents: [{type: planner}]")
    t = runners.template_of(RAW | {"workflows": ["open", "none"], "datasets": [], "parallel_execution": [{"component_type": "planner", "consultant_models": ["who"]}]}, {})
    assert t.problems(tmp_path) == ["workflow open: the last component must be finalizer or answer_drafter, not planner", "no workflow none", "at least one teacher model is needed", "a dataset is needed unless the mode is exploratory", "unknown consultant model who"]
    with pytest.raises(ValueError):
        runners.template_of(RAW | {"mode": "odd"}, {})
    assert all(runners.template_loaded(p.stem).problems() == [] for p in runners.TEMPLATES.glob("*.yaml"))


@pytest.mark.parametrize("mode", ["standard", "adaptive", "exploratory"])
def test_simulate_runs_a_template(spark, server, tmp_path, mode):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "qa.jsonl").write_text("\n".join(json.dumps({"query": q, "answer": "red cars"}) for q in ("red cars", "blue boats")))
    spark.createDataFrame([(0, "red cars are fast"), (1, "blue boats are slow")], "doc_id long, text string").write.parquet(f"{tmp_path}/corpus")
    raw = RAW | {
        "mode": mode, "teacher_models": [{"name": "one", "model_id": "custom/m"}], "consultant_models": [{"name": "two", "model_id": "custom/n"}], "datasets": [{"name": "d", "path": f"{tmp_path}/qa.jsonl"}], "max_iterations": 2,
        "similarity_metric": "token_overlap", "parallel_execution": [{"component_type": "answer_drafter", "consultant_models": ["two"]}], "verification": {"enabled": False}, "mode_config": {"execution_mode": "auto", "max_explorations": 2, "external_knowledge_component": "x"},
    }
    (tmp_path / "t.yaml").write_text(yaml.safe_dump(raw))
    assert cli.main(["simulate", f"{tmp_path}/t.yaml", "--output", f"{tmp_path}/out", "--base-url", server, "--corpus", f"{tmp_path}/corpus"]) == 0
    out = f"{tmp_path}/out/one/simple_rag/d"
    tools = {r.tool for r in spark.read.json(f"{out}/traces").select("action.tool").collect()}
    if mode == "exploratory":
        log = spark.read.json(f"{out}/explorations").collect()
        assert {(r.iteration, r.query) for r in log} == {(1, "red cars"), (1, "blue boats"), (2, "red boats")} and {r.mode_used for r in log} == {"adaptive"} and all(0 <= r.similarity_score <= 1 for r in log)
        assert {"reflection", "consultant_reflection", "external_verification", "knowledge_base"} <= tools
    else:
        assert {(r.query_id, r.success, r.similarity) for r in spark.read.json(f"{out}/results").collect()} == {("sample_002", True, 1.0), ("sample_003", True, 1.0)}
    config = spark.read.json(f"{out}/config").first()
    assert config.teacher_id == "custom/m" and config.workflow_config.max_iterations == 2 and config.search_index == "cw12"
    assert "answer_drafter_consultants" in tools and spark.read.json(f"{out}/ledger").count() == 2
    (tmp_path / "bad.yaml").write_text(yaml.safe_dump(raw | {"workflows": ["none"]}))
    assert cli.main(["simulate", f"{tmp_path}/bad.yaml"]) == 1
