"""The pipeline over a small corpus: each stage's decisions take effect and clean documents stay."""

import os
import random
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
from millrace.llm import queries


def test_stages(spark, tmp_path):
    r = random.Random(4)
    words = {"en": "the ing tion and er on re".split(), "fr": "eau que ment ais oux le é".split()}
    prose = lambda lang, n: " ".join("".join(r.choice(words[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, prose(lang, 120), lang, f"s{i % 3}") for i, lang in enumerate(["en", "fr"] * 20)]
    item = prose("en", 30)
    rows += [(100, rows[0][1], "en", "s0"), (101, f"{prose('en', 60)} {item} {prose('en', 60)}", "en", "s1"), (102, f"{prose('en', 50)} token = abcdefabcdefabcdef {prose('en', 50)}", "en", "s1"), (103, "1234", None, None), (104, None, "en", "s2")]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        seen.append({x.doc_id for x in docs.select("doc_id").collect()})
        if name != "source_mixing":
            assert docs.columns == columns
        if name == "secret_redaction":
            assert "[SECRET]" in docs.where("doc_id = 102").first().text
    clean = set(range(40)) | {102}
    assert seen == [clean | {100, 101}, clean | {101}, clean, clean, clean]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 41


def test_stages_on_edges(spark, tmp_path):
    """Empty tables, nulls in every column, a very long text, repeated rows and ties."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _gone long, _bad string, _row int, shard string"
    r = random.Random(9)
    prose = [" ".join("".join(r.choice(["an", "te", "ri", "do", "el"]) for _ in range(r.randint(1, 4))) for _ in range(60)) for _ in range(8)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(prose)] + [(0, prose[0], "en", "s", 1), (1, prose[0], "en", None, None), (None, prose[2], "en", None, None), (None, None, None, None, None), (9, "", "en", "s", 0), (10, " ".join(prose) * 200, "en", "s", 1)]
    spark.createDataFrame([(0, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full = spark.createDataFrame([(*r, 1, "b", 2, "c") for r in rows], schema)
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "source_mixing":
                assert out.columns == docs.columns
            ids = sorted(str(r.doc_id) for r in out.collect())
            if docs is full:
                every = sorted(str(r[0]) for r in rows)
                if name == "language_id":
                    assert ids == sorted(str(i) for i, t, *_ in rows if t)
                elif name == "near_dedup":  # of id 1 the copy of id 0's text goes; a row without id is no witness and stays
                    assert [i for i in ids if i != "None"] == sorted(["0", "0", *"1234567", "9", "10"])
                else:
                    assert ids == every
            else:
                assert ids == []


def _small(spark, path, shift=0):
    r = random.Random(8)
    words = "the ing tion and er on re".split()
    prose = lambda n: " ".join("".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(n))
    item = prose(30)
    rows = [(i + shift, prose(80), "en", f"s{i % 2}", 1) for i in range(12)] + [(50 + shift, f"{prose(40)} {item}", "en", "s0", 1)]
    rows.append((60 + shift, rows[0][1], "en", "s1", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {i + shift for i in range(12)}


def test_stages_may_be_chained_without_writing(spark, tmp_path):
    kept = _small(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} == kept


def test_pipelines_beside_each_other_keep_their_tables(spark, tmp_path):
    kept = [_small(spark, f"{tmp_path}/{n}", 100 * n) for n in range(2)]
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda n: corpus_pipeline.run(spark, f"{tmp_path}/{n}"), range(2)))
    assert [{r.doc_id for r in d.collect()} for d in done] == kept


def test_a_later_stage_deletes_what_nothing_reads(spark, tmp_path):
    _small(spark, tmp_path)
    near, clean = (dict(corpus_pipeline.STAGES)[n] for n in ("near_dedup", "decontamination"))
    out = near(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    tables = set(out.inputFiles())
    out.write.parquet(f"{tmp_path}/out")
    clean(spark, spark.read.parquet(f"{tmp_path}/out"), str(tmp_path))
    assert tables and all("documents.parquet" in t or not os.path.exists(t.removeprefix("file:")) for t in tables)


def test_every_numbered_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
