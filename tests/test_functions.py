"""Scalar functions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import similarity as S, text as T, trace as X


def value(spark, column, **cells):
    fields = ", ".join(f"{k} {kind}" for k, (kind, _) in cells.items())
    df = spark.createDataFrame([tuple(v for _, v in cells.values())], fields) if cells else spark.range(1)
    return df.select(column.alias("v")).first().v


def text(v):
    return ("string", v)


@pytest.mark.parametrize(("response", "goals"), [
    ("1. First goal\n- Second goal\n• Third goal\n4) Fourth goal", ["First goal", "Second goal", "Third goal"]),
    ("2024 election results\nplain line here", ["election results"]),
    ("1. short\n2. ok no\n3. long enough", ["long enough"]),
    ("", []),
])
def test_subgoals(spark, response, goals):
    assert value(spark, T.subgoals(F.col("r")), r=text(response)) == goals


def test_subgoals_drop_five_characters_and_less(spark):
    assert value(spark, T.subgoals(F.col("r")), r=text("1. abcde\n2. abcdef")) == ["abcdef"]


def test_merged_goals_keep_own_repeats_and_stop_at_twice_the_most(spark):
    merged = T.merged_goals(F.col("a"), F.col("b"), 2)
    assert value(spark, merged, a=("array<string>", ["x", "x"]), b=("array<string>", ["x", "y", "z", "w", "v"])) == ["x", "x", "y", "z", "w"]


def test_markers(spark):
    r = "REASONING: a b\nANSWER: yes ANSWER: no"
    assert value(spark, T.after_marker(F.col("r"), "REASONING:", "ANSWER:"), r=text(r)) == "yes"
    assert value(spark, T.reasoning_of(F.col("r"), "REASONING:", "ANSWER:"), r=text(r)) == "a b"
    assert value(spark, T.after_marker(F.col("r"), "REASONING:", "ANSWER:"), r=text(" ANSWER: x ")) == "ANSWER: x"


def test_json_pieces(spark):
    assert value(spark, T.bracket_slice(F.col("r")), r=text('a [1, [2]] b] c')) == "[1, [2]] b]"
    assert value(spark, T.bracket_slice(F.col("r")), r=text("] [")) is None
    assert value(spark, T.code_fence_stripped(F.col("r")), r=text('```json\n["a"]\n```')) == '["a"]'
    assert value(spark, T.fenced_anywhere(F.col("r")), r=text('see ```json ["a"] ``` ok')) == '["a"]'
    assert value(spark, T.json_strings(F.col("r")), r=text('["a", " ", "b"]')) == ["a", "b"]
    assert value(spark, T.json_strings(F.col("r")), r=text("no")) is None


@pytest.mark.parametrize(("model", "provider"), [("custom/gpt", "custom"), ("ollama/x", "ollama"), ("GPT-4", "openai"), ("Claude", "anthropic"), ("palm", "google"), ("mistral", "mistral"), ("command-r", "cohere"), ("together/x", "together"), ("zzz", "openai")])
def test_provider(spark, model, provider):
    assert value(spark, T.provider_of(F.col("m")), m=text(model)) == provider


def test_small_text_functions(spark):
    assert value(spark, T.cannot_answer(F.col("a")), a=text("I CANNOT Determine it"))
    assert value(spark, T.cannot_answer(F.col("a")), a=text(None)) is False
    assert value(spark, T.title_label(F.lit("query_formulator"))) == "Query Formulator"
    assert value(spark, T.sample_id(F.lit(7))) == "sample_007"
    assert value(spark, T.execution_mode(F.lit(" ADAPTIVE"))) == "adaptive"
    assert value(spark, T.placeholders(F.lit("{b} {a} {b} {not one}"))) == ["a", "b"]
    assert value(spark, T.rendered(F.lit("{{x}} {a}"), {"a": F.lit("1")})) == "{x} 1"
    assert value(spark, T.usage(F.lit('{"input_tokens": 3, "output_tokens": 4}'))["total_tokens"]) == 7
    assert value(spark, T.reformulation(F.lit("find red cars"), F.lit("red CARS"))) == "syntactic"


@pytest.mark.parametrize(("a", "b", "want"), [("a b c", "B C d", 0.5), ("", "a", 0.0), ("a a", "a", 1.0), ("   ", "a", 0.0)])
def test_token_overlap(spark, a, b, want):
    assert value(spark, S.token_overlap(F.col("a"), F.col("b")), a=text(a), b=text(b)) == pytest.approx(want)


def test_vectors(spark):
    vec = ("array<float>", [3.0, 4.0])
    assert value(spark, S.cosine(F.col("a"), F.col("b")), a=vec, b=("array<float>", [4.0, 3.0])) == pytest.approx(0.96)
    assert value(spark, S.cosine(F.col("a"), F.col("b")), a=vec, b=("array<float>", [0.0, 0.0])) == 0
    assert value(spark, S.l2_normalized(F.col("a")), a=vec) == pytest.approx([0.6, 0.8])
    none = value(spark, S.mmr_score(F.lit(4.0), F.col("a"), F.col("s"), 0.7), a=vec, s=("array<array<float>>", []))
    some = value(spark, S.mmr_score(F.lit(4.0), F.col("a"), F.col("s"), 0.7), a=("array<float>", [0.6, 0.8]), s=("array<array<float>>", [[1.0, 0.0], [0.0, 1.0]]))
    assert none == 4 and some == pytest.approx(2.8 - 0.24)


@pytest.mark.parametrize(("metric", "answer", "gold", "want"), [("token_overlap", " ", "", 0.0), ("token_overlap", "a", " ", 1.0), ("bleu", "a", "b", 0.5), ("embedding_cosine", "a b", "a c", 1 / 3)])
def test_answer_similarity(spark, metric, answer, gold, want):
    assert value(spark, S.answer_similarity(metric, F.col("a"), F.col("g")), a=text(answer), g=text(gold)) == pytest.approx(want)


def test_rewards_and_stages(spark):
    error, n, stop, name = F.lit(None).cast("string"), F.lit(2), F.lit("FINISH"), F.lit("finalizer")
    assert value(spark, X.reward_exported(error, n, stop)) == pytest.approx(3.2)
    assert value(spark, X.reward_exported(F.lit("bad"), F.lit(0), F.lit("ERROR"))) == pytest.approx(-0.5)
    assert value(spark, X.reward_streamed(error, n, name)) == pytest.approx(0.8)
    assert value(spark, X.reward_streamed(F.lit("bad"), F.lit(0), F.lit("planner"))) == pytest.approx(-1.0)
    assert value(spark, X.stage(F.lit("planner"))) == "initial" and value(spark, X.stage(F.lit("planner"), True)) == "planning"
    assert value(spark, X.evidence_count(F.lit('{"filtered_count": 0, "evidence_count": 9}'), F.lit(5))) == 0
    assert value(spark, X.evidence_count(F.lit('{"subgoals": ["a"]}'), F.lit(5))) == 1
    assert value(spark, X.cost(F.lit(500))) == pytest.approx(0.005)


def test_sql_forms(spark):
    from millrace.functions.sql import register

    assert register(spark) == ["token_overlap", "cannot_answer", "trace_cost", "subgoals"]
    row = spark.sql("SELECT token_overlap('a b c', 'B C d') a, token_overlap('', 'x') b, cannot_answer('I don''t have enough') c, cannot_answer(null) d, trace_cost(500) e").first()
    assert (row.a, row.b, row.c, row.d, row.e) == (0.5, 0.0, True, False, 0.005)
    assert [r.goal for r in spark.sql("SELECT * FROM subgoals('1. First goal\n- Second goal\n- no', 3) ORDER BY place").collect()] == ["First goal", "Second goal"]
