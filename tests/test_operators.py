"""Evidence operators against literal list models, with ties, nulls and empty input."""

import random

import numpy as np
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.operators import answers, best, coverage, knowledge, processing, retrieval, traces

EVIDENCE = "query_id string, pos int, source string, id string, text string, title string, score double"
QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
rows = st.lists(st.tuples(st.sampled_from(["é" * 31, "b" * 29, "b" * 30 + "x", "b" * 30 + "y", "", "z" * 60]), st.sampled_from([None, 0.2, 0.5, 0.9])), max_size=12)


def evidence(spark, items):
    return spark.createDataFrame([("q", i, "s", f"d{i}", t, None, s) for i, (t, s) in enumerate(items)], EVIDENCE)


def ids(df):
    return [r.id for r in df.orderBy("pos").collect()]


@QUICK
@given(rows)
def test_filter(spark, items):
    want = [f"d{i}" for i, (t, s) in enumerate(items) if 30 <= len(t) <= 10_000 and (1.0 if s is None else s) >= 0.5][:3]
    assert ids(processing.filtered(evidence(spark, items), min_score=0.5, max_results=3)) == want


@QUICK
@given(rows, st.sampled_from(["text_prefix", "exact"]))
def test_dedup(spark, items, method):
    seen, want = set(), []
    for i, (t, _) in enumerate(items):
        key = t[:30] if method == "text_prefix" else t
        if key not in seen:
            seen.add(key)
            want.append(f"d{i}")
    assert ids(processing.deduplicated(evidence(spark, items), method, 30, 4)) == want[:4]


@QUICK
@given(rows)
def test_simple_rerank_keeps_ties_in_order(spark, items):
    n = len(items)
    score = [round(0.7 * (0.5 if s is None else s) + 0.3 * (1 - i / max(n, 1)), 4) for i, (_, s) in enumerate(items)]
    want = [f"d{i}" for i in sorted(range(n), key=lambda i: -score[i])][:5]
    assert ids(processing.reranked(evidence(spark, items), None, "simple", 5)) == want


def test_unknown_method_is_simple_and_cross_encoder_needs_a_model(spark):
    df = evidence(spark, [("a", 0.1), ("b", 0.9)])
    assert ids(processing.reranked(df, None, "odd")) == ["d1", "d0"]
    try:
        processing.reranked(df, None)
    except ValueError:
        pass
    else:
        raise AssertionError("no model, no scores")


def test_okapi_over_each_query_s_own_evidence(spark):
    import math

    texts = ["a b c", "a a d", "e f", ""]
    df = evidence(spark, [(t, None) for t in texts])
    queries = spark.createDataFrame([("q", "A a d zz")], "query_id string, query string")
    got = {r.id: r.rerank_score for r in processing.okapi_scores(df, queries).collect()}
    docs = [t.split() for t in texts]
    freq = {w: sum(w in x for x in docs) for x in docs for w in x}
    raw = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in freq.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    mean = sum(map(len, docs)) / 4
    for i, x in enumerate(docs):
        want = sum(idf.get(w, 0) * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for w in "a a d zz".split())
        assert abs(got[f"d{i}"] - want) < 1e-9


def test_reranking_by_okapi_moves_no_words(spark):
    df = evidence(spark, [(f"a b w{i}" if i % 3 else "w1 w1 a", None) for i in range(40)])
    queries = spark.createDataFrame([("q", "A w1 w2 w2")], "query_id string, query string")
    scored = {r.pos: round(r.rerank_score, 4) for r in processing.okapi_scores(df, queries).collect()}
    top = processing.reranked(df, queries, "bm25", 5)
    assert [(r.id, r.rerank_score) for r in top.orderBy("pos").collect()] == [(f"d{i}", s) for i, s in sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:5]]
    plan = processing.okapi_scores(df, queries)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "lower(" not in plan  # the plan over what is counted reads no words again


def test_insert_is_first_wins_and_tombstones_stay_out(spark):
    hits = spark.createDataFrame([("q", 0, 1, "a"), ("q", 0, 2, "b"), ("q", 1, 1, "b"), ("q", 1, 2, "c"), ("r", 0, 1, "a")], "query_id string, angle int, rank int, id string")
    got = {(r.query_id, r.pos): r.id for r in retrieval.inserted(hits, ["angle", "rank"]).collect()}
    assert got == {("q", 0): "a", ("q", 1): "b", ("q", 2): "c", ("r", 0): "a"}
    seen = spark.createDataFrame([("q", "a")], "query_id string, id string")
    assert {r.id for r in retrieval.inserted(hits, ["angle", "rank"], seen).where("query_id = 'q'").collect()} == {"b", "c"}


def test_bm25_fields_take_the_best_weighted_one(spark):
    corpus = spark.createDataFrame([("a", "red car", "nothing"), ("b", "nothing", "red red"), ("c", None, "blue")], "id string, title string, body string")
    queries = spark.createDataFrame([("q", "RED")], "query_id string, query string")
    one = {r.id: r.score for r in retrieval.bm25(corpus, queries, {"title": 1.0}).collect()}
    both = {r.id: r.score for r in retrieval.bm25(corpus, queries, {"title": 3.0, "body": 1.0}).collect()}
    assert set(one) == {"a"} and abs(both["a"] - 3 * one["a"]) < 2e-4 and both["b"] > 0


def test_knn_in_blocks_of_probes(spark):
    corpus = spark.createDataFrame([(str(i), [float(i % 7), 1.0]) for i in range(30)], "id string, vector array<float>")
    probes = spark.createDataFrame([(f"p{i}", [1.0, float(i)]) for i in range(6)], "query_id string, vector array<float>")
    whole = sorted(map(tuple, retrieval.knn_top_k(corpus, probes, 4).collect()))
    assert whole == sorted(map(tuple, retrieval.knn_top_k(corpus, probes, 4, most_probes=2).collect())) and len(whole) == 24


def test_vectors_that_are_missing_or_of_another_size_come_last(spark):
    rows = [("a", [1.0, 2.0]), ("b", None), ("c", [9.0]), ("d", [3.0, None]), ("e", [0.0, 1.0]), ("f", [1.0, 2.0])]
    corpus, probes = spark.createDataFrame(rows, "id string, vector array<float>"), spark.createDataFrame([("p", [1.0, 1.0]), ("q", None), ("r", [2.0])], "query_id string, vector array<double>")
    got = {}
    for r in retrieval.knn_top_k(corpus, probes, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got == {"p": [("a", 3.0), ("f", 3.0), ("e", 1.0), ("b", None)], "q": [(i, None) for i in "abcd"], "r": [("c", 18.0), ("a", None), ("b", None), ("d", None)]}


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_the_best_of_parts_are_those_of_the_whole(monkeypatch):
    r = np.random.default_rng(1)
    monkeypatch.setattr(best, "CELLS", 64)
    for k in (1, 3, 50):
        scores, place = r.integers(0, 6, (5, 200)) / 4, r.permutation(200)
        held, got = best.Best(5, k), []
        for begin, end in best.cuts(r.integers(0, 9, 200), 5):
            query, row, value = held.add(scores[:, begin:end], place[begin:end], scores[:, begin:end] > 0)
            got += [(q, -v, place[begin + i]) for q, i, v in zip(query, row, value, strict=True)]
        want = [sorted((q, -s, p) for s, p in zip(scores[q], place, strict=True) if s > 0)[:k] for q in range(5)]
        assert [sorted(x for x in got if x[0] == q)[:k] for q in range(5)] == want


def test_vector_pairs_are_neither_sorted_nor_exchanged(spark):
    r = np.random.default_rng(3)
    x = r.integers(-3, 4, (400, 4)).astype(float)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    top = retrieval.knn_top_k(corpus, corpus.where("id < 20").withColumnRenamed("id", "query_id"), 7)
    order = np.lexsort((np.broadcast_to(np.arange(400), (20, 400)), -(x[:20] @ x.T)))[:, :7]
    assert sorted(map(tuple, top.select("query_id", "rank", "id").collect())) == sorted((q, n + 1, int(i)) for q in range(20) for n, i in enumerate(order[q]))
    assert "Join" not in top._jdf.queryExecution().executedPlan().toString()


def test_bm25_pairs_are_not_exchanged(spark, monkeypatch):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("abcdefghij") * r.randrange(1, 3) for _ in range(n))
    rows = [(f"d{i % 90}" if i < 90 else f"e{i}", None if i % 11 == 0 else text(r.randrange(9)), text(r.randrange(30))) for i in range(300)]
    corpus = spark.createDataFrame(rows, "id string, title string, body string").repartition(3)
    asked = [(q % 7, None if q % 5 == 0 else q, text(5) if q % 6 else None) for q in range(30)] + [(1, 1, "a b zz"), (1, 1, "a")]
    asked = spark.createDataFrame(asked, "q int, angle int, query string")
    fields, keys = {"title": 3.0, "body": 1.0}, ["q", "angle"]
    for wanted in ({"body": 1.0}, fields):
        pairs = retrieval.bm25(corpus, asked, wanted, tuple(keys))
        want = sorted(map(str, retrieval.first_k(pairs, keys, [F.desc("score"), F.col("id")], 6).select(*keys, "rank", "id", "score").collect()))
        for block in (1 << 20, 60):
            monkeypatch.setattr(best, "BLOCK_TERMS", block)
            top = retrieval.bm25_top_k(corpus, asked, 6, wanted, tuple(keys))
            assert sorted(map(str, top.collect())) == want and len(want) > 100
    assert _exchanges(retrieval.bm25_top_k(corpus, asked, 6, {"body": 1.0}, tuple(keys))) == 1


def test_gates(spark):
    queries = spark.createDataFrame([("q", "draft"), ("r", " "), ("s", "x")], "query_id string, draft string")
    got = {r.query_id: r for r in answers.checked(queries, evidence(spark, [("a", None)] * 3), F.col("draft"), 3).collect()}
    assert (got["q"].passed, got["q"].confidence, got["s"].passed, got["r"].success) == (True, 0.6, False, False)


def test_coverage_against_a_list_model(spark):
    sets = [["a", "b"], [], ["b", "c"], ["c", "c"], None, ["a"]]
    df = spark.createDataFrame([("s", i + 1, f"q{i}", d) for i, d in enumerate(sets)], "seed_id string, iteration int, query string, doc_ids array<string>")
    got = [(r.overlap_with_prev, round(r.jaccard_with_prev, 6), r.cumulative_unique_docs) for r in coverage.per_iteration(df).orderBy("iteration").collect()]
    want, before, met = [], set(), set()
    for d in sets:
        own = set(d or [])
        met |= own
        want.append((len(own & before) if before else 0, round(len(own & before) / len(own | before), 6) if before and own | before else 0.0, len(met)))
        before = own
    assert got == want
    summary = coverage.seed_summary(coverage.per_iteration(df)).first()
    assert summary.unique_docs == 3 and abs(summary.avg_jaccard - (0 + 1 / 2 + 0) / 3) < 1e-9
    assert abs(coverage.global_summary(coverage.per_iteration(df)).first().avg_jaccard - (1 / 2) / 5) < 1e-9


def test_document_frequency_may_exceed_the_number_of_queries(spark):
    df = spark.createDataFrame([("s", "q", ["a"]), ("t", "q", ["a", "a"]), ("t", "p", ["a"])], "seed_id string, query string, doc_ids array<string>")
    row = coverage.document_frequency(df).first()
    assert (row.frequency, row.queries_found_in) == (3, 2)


STEPS = "run_id string, seq long, turn int, component string, verdict string, stop_condition string, rationale_tag string, llm_input string, llm_output string, tokens long, evidence_count long, execution_time_ms double, error string"


def test_trajectories_and_replanning(spark):
    steps = spark.createDataFrame([
        ("r", 1, 1, "planner", "PROCEED", "CONTINUE", "BREADTH", "in", "out", 10, 3, 1.0, None),
        ("r", 2, 2, "opensearch_retriever", "FAIL", "ERROR", "", None, None, 0, 0, 2.0, "bad"),
        ("r", 3, 1, "finalizer", "FAIL", "FINISH", "", "in", "", 5, 2, 3.0, None),
    ], STEPS)
    t = traces.trajectories(steps).orderBy("seq").collect()
    assert [r.state.previous_tools for r in t] == [[], ["planner"], ["planner", "opensearch_retriever"]]
    assert [r.next_state.state_stage for r in t] == ["retrieving", "synthesizing", "done"] and [r.done for r in t] == [False, False, True]
    assert [round(r.reward, 4) for r in t] == [1.2, -0.5, 3.2]
    assert [r.seq for r in traces.supervised(steps).collect()] == [1]
    assert [r.replan for r in answers.should_replan(steps).orderBy("seq").collect()] == [False, False, True]
    totals = traces.run_totals(steps).first()
    assert (totals.total_steps, totals.total_tokens, totals.final_evidence_count, totals.compat_final_evidence_count) == (3, 15, 2, 0)
    assert traces.run_stats(steps).first().tool_usage == {"finalizer": 1, "opensearch_retriever": 1, "planner": 1}


def test_knowledge(spark):
    kb = spark.createDataFrame([("s", i, f"q{i}", "" if i == 2 else "a" * 300, ["d"]) for i in range(8)], "seed_id string, iteration int, query string, answer string, doc_ids array<string>")
    lines = knowledge.recent_context(kb, 2).first().context
    assert lines == "Q: q6\nA: " + "a" * 200 + "\n\nQ: q7\nA: " + "a" * 200
    assert tuple(knowledge.stats(kb).first()) == (8, 1, 1.0)
    empty = knowledge.stats(kb.limit(0)).first()
    assert (empty.total_queries, empty.unique_docs) == (0, 0)


def test_numbers_in_two_steps_are_those_of_one(spark, monkeypatch):
    import random

    r = random.Random(2)
    rows = [(None if r.random() < 0.1 else r.choice("abc"), r.randrange(3), r.randrange(40) if r.random() < 0.9 else None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "query_id string, angle int, rank int, id int").repartition(4)
    want, seen = {}, {}
    for q, angle, rank, i in sorted(rows, key=lambda x: (x[0] or "", x[1], -1 if x[2] is None else x[2], x[3])):
        want[i] = seen[q] = seen.get(q, -1) + 1
    for stretch in (1, 7, 4096):
        monkeypatch.setattr(retrieval, "STRETCH", stretch)
        assert {x.id: x.pos for x in retrieval.numbered(df, ["query_id"], ["angle", "rank"], ("id",)).collect()} == want
