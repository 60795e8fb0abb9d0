"""The command line, without and with a session."""

import json

from millrace import cli


def test_catalogues(capsys):
    assert cli.main([]) == 1
    assert cli.main(["list"]) == 0 and cli.main(["info"]) == 0
    assert cli.main(["components", "--category", "control"]) == 0
    assert cli.main(["components", "--category", "odd"]) == 1
    assert cli.main(["validate", "simple_rag"]) == 0 and cli.main(["validate", "missing"]) == 1
    assert cli.main(["discover"]) == 1
    out = capsys.readouterr().out
    assert "simple_rag: Simple" in out and "control: condition" in out and "retrieval: 3" in out


def test_settings(monkeypatch):
    monkeypatch.setenv("MAX_ITERATIONS", "7")
    assert cli.setting("MAX_ITERATIONS") == 7 and cli.setting("SIMILARITY_THRESHOLD") == 0.6


def test_seed_select(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text("\n".join(json.dumps({"query": f"word{i} red"}) for i in range(12)))
    spark.createDataFrame([(f"word{i} red", [float(i % 3), 1.0]) for i in range(12)], "query string, vector array<float>").write.parquet(f"{tmp_path}/vectors")
    spark.createDataFrame([(i, f"word{i} red text") for i in range(12)], "doc_id long, text string").write.parquet(f"{tmp_path}/corpus")
    args = ["seed-select", f"{tmp_path}/train.jsonl", "--embeddings", f"{tmp_path}/vectors", "--corpus", f"{tmp_path}/corpus", "--output", f"{tmp_path}/out", "--num-seeds", "4", "--clusters", "3", "--top-k", "2"]
    assert cli.main(args) == 0
    rows = spark.read.json(f"{tmp_path}/out").collect()
    assert 1 <= len(rows) <= 4 and {r.split for r in rows} == {"train"}
