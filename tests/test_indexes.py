"""Indexes and clusters against brute force, and that they read what they should."""

import hashlib
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import clusters, coverage, retrieval, samples, text_index, vector_index


def vectors(spark, n, dim=16, groups=12, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    x = centres[r.integers(groups, size=n)] + 0.6 * r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(5)


@pytest.fixture(scope="module")
def table(spark):
    return vectors(spark, 3000).unionByName(spark.createDataFrame([(9000, None)], "id long, vector array<float>"))


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return vector_index.built(table, str(tmp_path_factory.mktemp("index")))


def test_recall_and_exact_scores(spark, table, index):
    probes = table.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = {(r.query_id, r.id): (r.rank, r.score) for r in retrieval.knn_top_k(table.where("vector is not null"), probes.where("vector is not null"), 25).collect()}
    got = {(r.query_id, r.id): (r.rank, r.score) for r in vector_index.ann_top_k(spark, index, probes, 25, 100).collect()}
    assert len(got) == 25 * 30 and len(set(got) & set(exact)) / len(exact) >= 0.9
    assert all(got[k][1] == exact[k][1] for k in set(got) & set(exact))
    for q in {k[0] for k in got}:
        rows = sorted((rank, -score, i) for (p, i), (rank, score) in got.items() if p == q)
        assert rows == sorted(rows, key=lambda r: (r[1], r[2])) and [r[0] for r in rows] == list(range(1, 26))


def test_all_cells_and_candidates_are_brute_force(spark, table, index):
    probes = table.where("id in (1, 2)").select(F.col("id").alias("query_id"), "vector")
    want = retrieval.knn_top_k(table.where("vector is not null"), probes, 10)
    got = vector_index.ann_top_k(spark, index, probes, 10, 3000, len(index.centres))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_search_reads_codes_of_the_cells_asked_for(spark, index, monkeypatch):
    seen = []
    base = vector_index._candidates
    monkeypatch.setattr(vector_index, "_candidates", lambda codes, *a: seen.append(codes) or base(codes, *a))
    probe = spark.createDataFrame([("q", index.centres[0].tolist())], "query_id string, vector array<double>")
    vector_index.ann_top_k(spark, index, probe, 5, 20, 2)
    plan = seen[0]._jdf.queryExecution().toString()
    read = plan[plan.rindex("ReadSchema"):]
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(", "").replace("(", "") or "cell#" in plan[plan.rindex("PartitionFilters"):][:200]
    assert "code:binary" in read and "vector" not in read


def test_an_index_is_opened_again_and_blocks_change_nothing(spark, table, index, monkeypatch):
    again = vector_index.opened(spark, index.path)
    assert (again.centres == index.centres).all() and (again.books == index.books).all() and again.cells_asked == index.cells_asked
    probes = table.where("id < 40").select(F.col("id").alias("query_id"), "vector")
    want = sorted(map(tuple, vector_index.ann_top_k(spark, index, probes, 5).collect()))
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 16 * 8 * 10)
    assert sorted(map(tuple, vector_index.ann_top_k(spark, again, probes, 5).collect())) == want and len(want) == 200


def test_small_and_odd_tables(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 0.0, 0.0]) for i in range(7)], "id long, vector array<float>")
    probe = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", None)], "query_id string, vector array<double>")
    index = vector_index.built(same, f"{tmp_path}/same")
    assert [r.id for r in vector_index.ann_top_k(spark, index, probe, 3).orderBy("rank").collect()] == [0, 1, 2]
    empty = vector_index.built(same.limit(0), f"{tmp_path}/none")
    assert vector_index.ann_top_k(spark, empty, probe, 3).count() == 0


def test_kmeans_takes_the_best_start_and_one_cluster(spark, table):
    x = np.array([r.vector for r in table.where("vector is not null").orderBy("id").collect()], float)
    one, inertia = clusters.fitted(table, 1)
    assert np.allclose(one[0], x.mean(axis=0)) and np.isclose(inertia, np.square(x - x.mean(axis=0)).sum())
    best, inertia = clusters.fitted(table, 12, starts=4, rounds=15)
    alone = [clusters.fitted(table, 12, centres=clusters.spread_rows(clusters.sample(table), 12, np.random.default_rng([42, s])), rounds=15)[1] for s in range(4)]
    assert inertia <= min(alone) * (1 + 1e-6)
    rows = clusters.assigned(table, best).collect()
    assert all(r.cluster == (None if r.vector is None else clusters.distances(np.array([r.vector], float), best).argmin()) for r in rows)
    assert clusters.fitted(table.limit(0), 5)[0].size == 0
    few, _ = clusters.fitted(spark.createDataFrame([([1.0, 2.0],)] * 9, "vector array<float>"), 5)
    assert len(few) == 1


def corpus(spark, n, seed=5):
    r = random.Random(seed)
    words = ["the", "of"] * 40 + [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(r.choice(words) for _ in range(r.randrange(k)))
    rows = [(f"d{i:03}", None if i % 17 == 0 else text(6), "" if i % 13 == 0 else text(60)) for i in range(n)]
    return spark.createDataFrame(rows, "id string, title string, text string")


@pytest.fixture(scope="module")
def text(spark, tmp_path_factory):
    index = text_index.opened(spark, str(tmp_path_factory.mktemp("text")), "held", ("title", "text"), 4)
    docs = corpus(spark, 300)
    text_index.appended(index, docs.where("id < 'd120'"), "one")
    text_index.appended(index, docs.where("id >= 'd120'"), "two")
    return docs, text_index.appended(index, docs, "two")


WEIGHTS = {"title": 3.0, "text": 1.0}
QUERIES = [("a", "the w1"), ("b", "the of"), ("c", "w2 w3 w4 the of the"), ("d", "unknown"), ("e", ""), ("f", None), ("g", "w5"), ("h", "the")]


@pytest.mark.parametrize("k", [1, 5, 400])
@pytest.mark.parametrize("prune", [True, False])
def test_scores_are_those_of_a_scan(spark, text, monkeypatch, prune, k):
    docs, index = text
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    want = sorted(map(tuple, retrieval.bm25_top_k(docs, asked, k, WEIGHTS).collect()))
    for rare in (2, 32):
        monkeypatch.setattr(text_index, "RARE", rare)
        assert sorted(map(tuple, text_index.top_k(spark, index, asked, k, WEIGHTS, prune=prune).collect())) == want


def test_small_blocks_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    docs, asked = corpus(spark, 200, 6), spark.createDataFrame(QUERIES, "query_id string, query string")
    index = text_index.appended(text_index.opened(spark, str(tmp_path), "blocks", ("text",), 4), docs, "all")
    assert index.table(spark, "postings").agg(F.max(F.size("ids"))).first()[0] <= 30
    want = sorted(map(tuple, retrieval.bm25_top_k(docs, asked, 5).collect()))
    assert sorted(map(tuple, text_index.top_k(spark, index, asked, 5).collect())) == want
    text_index.dropped(spark, index)
    again = text_index.opened(spark, str(tmp_path), "again", ("text",), 4)
    assert sorted(map(tuple, text_index.top_k(spark, again, asked, 5).collect())) == want


def test_a_search_reads_no_text_and_moves_no_postings(spark, text):
    _, index = text
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weighed = text_index._weighed(spark, index, asked.selectExpr("query_id", "explode(split(query, ' ')) as term"), ["query_id"])
        plan = text_index._postings(spark, index, weighed)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "held_postings" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    path, at = [], depth(lines[scan])  # the operators above the scan, up to the first join
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            path.append(line)
            at = depth(line)
        if "Join" in line and depth(line) == at:
            break
    assert "Join" in path[-1] and "Bucketed: true" in lines[scan] and not any("Exchange" in line or "Sort " in line for line in path)
    assert "title" not in plan


def test_an_append_without_its_sizes_does_not_count(spark, tmp_path):
    docs, asked = corpus(spark, 60, 8), spark.createDataFrame([("q", "w1 w2 the")], "query_id string, query string")
    index = text_index.appended(text_index.opened(spark, str(tmp_path), "broken", ("text",), 4), docs, "one")
    want = text_index.top_k(spark, index, asked, 5).collect()
    index.table(spark, "postings").withColumn("batch", F.lit("two")).coalesce(1).write.mode("append").insertInto("broken_postings")
    assert text_index.top_k(spark, index, asked, 5).collect() == want


def test_samples_are_the_first_hashes_of_each_stratum(spark, monkeypatch):
    rows = [(i, None if i % 50 == 0 else "ab"[i % 7 == 0]) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, s string")
    hashed = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i, s) for i, s in rows)
    counts = {s: sum(r[1] == s for r in rows) for s in (None, "a", "b")}
    for digits, size in ((4, 0), (4, 1), (1, 7), (4, 100), (0, 333), (4, 2000)):
        monkeypatch.setattr(samples, "DIGITS", digits)
        most = min(size, 1000)
        quota = {s: most * n // 1000 for s, n in counts.items()}
        rest = sorted((-(most * n % 1000), s is not None, s or "", s) for s, n in counts.items() if most * n % 1000)
        for *_, s in rest[: most - sum(quota.values())]:
            quota[s] += 1
        want = {i for s in counts for i in [i for _, i, t in hashed if t == s][: quota[s]]}
        got = samples.stratified(df.repartition(7), "id", "s", size).collect()
        assert {r.id for r in got} == want and len(got) == most
        drawn = samples.drawn(df.repartition(5), "id", size).collect()
        assert {r.id for r in drawn} == {i for _, i, _ in hashed[:most]} and len(drawn) == most


def test_bitmaps_are_exact_and_sketches_within_their_error(spark):
    r = random.Random(1)
    rows = [(r.randrange(3), i, [r.randrange(90_000) for _ in range(40)]) for i in range(200)]
    found = spark.createDataFrame(rows, "seed_id long, iteration long, docs array<long>").select("seed_id", "iteration", F.explode("docs").alias("doc"))
    got = {(x.seed_id, x.iteration): (x.fresh, x.unique) for x in coverage.unique_so_far(coverage.documents_as_bitmaps(found, ["seed_id", "iteration"])).collect()}
    seen, want = {0: set(), 1: set(), 2: set()}, {}
    for seed, i, docs in rows:
        new = set(docs) - seen[seed]
        seen[seed] |= new
        want[seed, i] = (len(new), len(seen[seed]))
    assert got == want
    sketches = coverage.document_sketches(found, ["seed_id", "iteration"])
    for by, sets in (([], [set().union(*seen.values())]), (["seed_id"], list(seen.values()))):
        for row in coverage.unique_by_sketch(sketches, by).collect():
            truth = len(sets[row.seed_id if by else 0])
            assert abs(row.unique - truth) <= 5 * 0.8 / 2**7 * truth


class _Service(BaseHTTPRequestHandler):
    asked = []

    def do_GET(self):
        _Service.asked.append((urlparse(self.path).path, parse_qs(urlparse(self.path).query), self.headers.get("Authorization")))
        hits = [{"trec_id": "t1", "title": "T", "snippet": "s", "score": 2}, {"uuid": "u2", "snippet": ""}, {"title": "no id", "snippet": "x"}]
        body = json.dumps({"results": hits}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_search_service(spark, monkeypatch):
    from millrace.sources import datasource

    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("OWN_KEY", "secret")
    datasource.register(spark)
    options = {"url": f"http://127.0.0.1:{server.server_port}", "index": "i", "size": "2", "queries": json.dumps([["a", "red cars"], ["b", "x"]])}
    for style, want in (("seed", [("t1", 1), ("u2", 2)]), ("component", [("t1", 1), ("", 2)])):
        rows = spark.read.format("search_service").options(**options, style=style).load().where("query_id = 'a'").orderBy("rank").collect()
        assert [(r.doc_id, r.rank) for r in rows] == want
    assert {p for p, _, _ in _Service.asked} == {"/_search"} and ["red cars"] in [q["query"] for _, q, _ in _Service.asked]
    monkeypatch.setattr(datasource.os, "environ", {"OWN_KEY": "secret"})
    seed, other = (datasource.SearchReader({**options, "style": s, "key_variable": "OWN_KEY"}).request("q") for s in ("seed", "component"))
    assert "apikey=secret" in seed.full_url and seed.headers == {} and "key=secret" in other.full_url and other.headers["Authorization"] == "Bearer secret"
    server.shutdown()
