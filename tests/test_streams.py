"""State, ledgers and sources of streams, stopped and broken off between batches."""

import gzip
import json

import pytest
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import functions as F

from millrace.functions import tables
from millrace.sources import datasource, readers
from millrace.streaming import streams

STEPS = "run_id long, seq long, ts timestamp, component string, execution_time_ms double"


def steps(spark, rows):
    return spark.createDataFrame(rows, "run_id long, seq long, ts string, component string, execution_time_ms double").withColumn("ts", F.col("ts").cast("timestamp"))


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema(STEPS).parquet(f"{tmp_path}/in")
    with streams.with_rocksdb(spark):
        streams.committed(streams.running_history(stream, **options), f"{tmp_path}/out", f"{tmp_path}/log", "update").awaitTermination()
    return streams.committed_rows(spark, f"{tmp_path}/out", spark.createDataFrame([], streams.HISTORY).schema)


def test_histories_over_restarts_and_their_state(spark, tmp_path):
    rows = [(i % 3, i, f"2024-01-01 00:{i:02}:00", f"c{i % 4}", float(i)) for i in range(30)]
    before = {key: spark.conf.get(key, None) for key in streams._ROCKSDB}
    for low in (0, 10, 20):
        steps(spark, rows[low : low + 10]).write.mode("append").parquet(f"{tmp_path}/in")
        out = run(spark, tmp_path)
    assert {key: spark.conf.get(key, None) for key in streams._ROCKSDB} == before
    last = {r.run_id: r for r in out.orderBy("batch").collect()}
    for k in range(3):
        own = [r for r in rows if r[0] == k]
        assert (last[k].steps, last[k].total_ms, last[k].tools) == (10, sum(r[4] for r in own), sorted({r[3] for r in own}))
        assert last[k].latest == [r[3] for r in own][-streams.LATEST :] and not last[k].closed
    counts = {(r.key.run_id, r.user_map_key.component): r.user_map_value.n for r in streams.state_of(spark, f"{tmp_path}/log", "tools").collect()}
    assert counts == {(k, c): sum(r[0] == k and r[3] == c for r in rows) for k in range(3) for c in {r[3] for r in rows if r[0] == k}}


def test_idle_runs_close_and_lose_their_state(spark, tmp_path):
    for part in ([(1, 0, "2024-01-01 00:00:00", "a", 1.0), (2, 0, "2024-01-01 00:00:00", "b", 2.0)], [(2, 1, "2024-01-03 00:00:00", "c", 3.0)], [(2, 2, "2024-01-03 00:00:01", "d", 4.0)]):
        steps(spark, part).write.mode("append").parquet(f"{tmp_path}/in")
        out = run(spark, tmp_path, idle_ms=3_600_000, delay="1 hour")
    closed = out.where("closed").collect()
    assert [(r.run_id, r.steps, r.tools) for r in closed] == [(1, 1, ["a"])]
    assert {r.key.run_id for r in streams.state_of(spark, f"{tmp_path}/log", "totals").collect()} == {2}


def test_history_modes_exclude_each_other(spark):
    with pytest.raises(ValueError):
        streams.running_history(steps(spark, []), idle_ms=1, keep_ms=1)


def test_a_batch_that_broke_off_before_its_entry_is_written_once(spark, tmp_path, monkeypatch):
    schema = "id long"
    spark.range(10).write.parquet(f"{tmp_path}/in")
    go = lambda: streams.committed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    go()
    spark.range(10, 25).write.mode("append").parquet(f"{tmp_path}/in")
    enter = streams.entered

    def broken(*args):
        raise RuntimeError("stopped between write and entry")

    monkeypatch.setattr(streams, "entered", broken)
    with pytest.raises(StreamingQueryException):
        go()
    held = streams.committed_rows(spark, f"{tmp_path}/out", spark.range(0).schema)
    assert sorted(r.id for r in held.collect()) == list(range(10))
    monkeypatch.setattr(streams, "entered", enter)
    go()
    go()
    held = streams.committed_rows(spark, f"{tmp_path}/out", spark.range(0).schema)
    assert sorted(r.id for r in held.collect()) == list(range(25))


def corpus_files(path):
    lines = [json.dumps({"n": i, "text": "é\n" * (i % 3), "_source": {"dataset": "ab"[i % 2], "run_id": f"r{i % 3}", "sample_id": i}}) for i in range(60)]
    (path / "dataset=a").mkdir(parents=True)
    (path / "dataset=b").mkdir()
    (path / "dataset=a" / "x.jsonl").write_text("\n".join([*lines[::2], "not json", "{}", "3"]))
    (path / "dataset=b" / "x.jsonl.gz").write_bytes(gzip.compress("\n".join(lines[1::2]).encode()))
    return lines


def test_corpus_source(spark, tmp_path, monkeypatch):
    lines = corpus_files(tmp_path)
    datasource.register(spark)
    df = spark.read.format("trace_corpus").load(str(tmp_path))
    assert sorted(r.record for r in df.collect()) == sorted(lines)
    some = df.where("dataset = 'a' and run_id in ('r0', 'r2') and sample_id > '3'")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(dataset,a), In(run_id, [r0,r2])" in plan
    want = [i for i in range(0, 60, 2) if i % 3 != 1 and str(i) > "3"]
    assert sorted(int(r.sample_id) for r in some.collect()) == want
    reader = datasource.CorpusReader(str(tmp_path))
    assert list(reader.pushFilters([datasource.EqualTo(("dataset",), "a"), datasource.EqualTo(("sample_id",), "1")])) == [datasource.EqualTo(("sample_id",), "1")]
    assert [p.path.rsplit("/", 2)[1] for p in reader.partitions()] == ["dataset=a"]
    monkeypatch.setattr(datasource, "SPLIT", 100)
    plain = datasource.CorpusReader(str(tmp_path))
    splits = [p for p in plain.partitions() if p.path.endswith("jsonl")]
    assert len(splits) > 10 and sorted(x for p in splits for b in plain.read(p) for x in b.column("record").to_pylist()) == sorted(lines[::2])


def test_corpus_stream_goes_on(spark, tmp_path):
    lines = corpus_files(tmp_path / "in")
    datasource.register(spark)

    def go():
        stream = spark.readStream.format("trace_corpus").load(str(tmp_path / "in"))
        streams.committed(stream, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
        return sorted(r.record for r in streams.committed_rows(spark, f"{tmp_path}/out", stream.schema).collect())

    assert go() == sorted(lines)
    more = json.dumps({"_source": {"dataset": "c", "run_id": "r", "sample_id": "s"}})
    (tmp_path / "in" / "a-late.json").write_text(more)
    assert go() == sorted([*lines, more])


def test_variants(spark):
    rows = [("a", '{"query":" x ","text":"t"}', True), ("b", '{"query":{"1":" u ","2":"","3":5}}', False), ("c", '{"k1 ":"v","k2":1}', False), ("d", '[{"question":"q"},{"text":"t"},{"z":1},3]', False)]
    rows += [("e", "not", False), ("f", None, False), ("g", '{"query":{}}', False), ("h", "3", False), ("i", "[]", False), ("j", '{"query": 3, "text": "y"}', True)]
    df = spark.createDataFrame(rows, "file string, document string, line boolean")
    got = {(r.file, r.query) for r in readers.from_variants(df).collect()}
    assert got == {("a", "x"), ("b", "u"), ("c", "k1"), ("c", "k2"), ("d", "q"), ("d", "t"), ("j", "y")}


def test_table_functions(spark):
    assert tables.register(spark) == ["planned_goals", "goals_by_key"]
    df = spark.createDataFrame([(1, 2, "- second goal\n- another goal"), (1, 1, "SUB-GOALS:\n1. first goal\n• second goal\nno"), (2, 1, None), (3, 1, "- abc")], "key long, place long, response string")
    got = spark.sql("select * from goals_by_key(table({df}), 3)", df=df)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "first goal"), (1, 2, "second goal"), (1, 3, "another goal")]
    one = spark.sql("select d.key, g.place, g.goal from {df} d, lateral planned_goals(d.response, 1) g", df=df)
    assert sorted(map(tuple, one.collect())) == [(1, 1, "first goal"), (1, 1, "second goal")]
    for wrong in ("select * from range(1), lateral planned_goals('x', 0)", "select * from range(1), lateral planned_goals(3, 1)", "select * from goals_by_key(table(range(3)), 1)"):
        with pytest.raises(AnalysisException):
            spark.sql(wrong).collect()


def test_dataset_samples_have_exact_sizes(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps({"query": f"q{i}", "uid": "ab"[i % 4 == 0]}) for i in range(200)))
    got = readers.qa_dataset(spark, str(tmp_path), 20, "stratified", strata="uid").collect()
    assert len(got) == 20 and sum(r.uid == "b" for r in got) == 5 and sorted(r.sample_no for r in got) == list(range(1, 21))
    assert len(readers.qa_dataset(spark, str(tmp_path), 20, "random").collect()) == 20


def test_the_package_goes_to_running_executors(spark):
    import zipfile

    from millrace.sources.shared import shipped

    archive = shipped(spark)
    names = zipfile.ZipFile(archive).namelist()
    assert "millrace/__init__.py" in names and "millrace/plans/prompts/draft.txt" in names and not any("__pycache__" in n for n in names)
    assert archive.rsplit("/", 1)[1] in spark.sparkContext._python_includes
