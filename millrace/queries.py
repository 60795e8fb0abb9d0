"""Queries over the driver's tables, one for each operator, each with its SQL twin.

Bindings: benchmark items are queries and documents the corpus; a source's
documents, in order of id, are the evidence of the query with its number;
events are trace steps (a user is a run) and, by day, explorations (a user
is a seed); conversations are message histories.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions import similarity as S, tables as table_functions, text as T, trace as X
from .operators import answers, clusters, coverage, knowledge, processing, retrieval, samples, text_index, traces, vector_index
from .plans import runners, seeds as seed_plans, workflow
from .plans.components import Services
from .plans.state import started
from .plans.workflow import Workflow
from .sources import datasource, readers
from .sources.shared import shared_folder, written
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# Bindings, in both languages.

def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """A source's documents are its query's evidence, in order of doc_id.

    They are numbered in two steps, within stretches of ids and by the number
    of rows before each stretch, so a source with a third of all rows is not
    sorted in one task.
    """
    docs = _read(spark, d, "documents").withColumn("part", F.floor(F.col("doc_id") / 4096))
    sizes = docs.groupBy(F.col("source").alias("s"), F.col("part").alias("p")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = written(sizes.select("s", "p", before.alias("before")), "stretches")  # of a known size, so that Spark may send it to the texts
    docs = docs.join(sizes, F.expr("source <=> s and part = p"))
    pos = (F.row_number().over(Window.partitionBy("source", "part").orderBy("doc_id")) - 1 + F.col("before")).cast("int")
    score = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 100).cast("double") / 100)
    return docs.select(F.col("source").alias("query_id"), pos.alias("pos"), F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("id"), "text", F.lit(None).cast("string").alias("title"), score.alias("score"))


_EV = """evidence as (select source as query_id, row_number() over (partition by source order by doc_id) - 1 as pos, 'documents' as source,
 cast(doc_id as varchar) as id, text, case when doc_id % 7 <> 0 then cast(doc_id % 100 as double) / 100 end as score from documents)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "benchmark").select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query"))


_Q = "asked as (select 'src' || cast(item_id as varchar) as query_id, text as query from benchmark)"
_TOK = "list_filter(string_split_regex(lower({}), '\\s+'), lambda x: x <> '')"

_COMPONENTS = {"click": "opensearch_retriever", "view": "reranker", "purchase": "finalizer", "signup": "planner", "error": "answer_drafter"}


def _steps(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind, e = F.col("event_type"), F.col("event_id")
    component = F.element_at(F.create_map(*(F.lit(x) for p in _COMPONENTS.items() for x in p)), kind)
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return _read(spark, d, "events").select(
        F.col("user_id").alias("run_id"), seq.alias("seq"), ((seq - 1) % 5 + 1).alias("turn"), component.alias("component"), F.col("value").alias("execution_time_ms"), k.alias("tokens"), (k % 4).alias("evidence_count"),
        F.when(kind == "error", "failed").alias("error"), F.when(kind == "error", "FAIL").when(k % 10 == 0, "REPLAN").otherwise("PROCEED").alias("verdict"),
        F.when(kind == "error", "ERROR").when((kind == "purchase") & (k % 3 == 0), "FINISH").otherwise("CONTINUE").alias("stop_condition"), F.when(kind == "signup", "BREADTH").otherwise("").alias("rationale_tag"),
        F.when(kind.isin("signup", "error"), F.concat(F.lit("prompt "), e.cast("string"))).alias("llm_input"), F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "").otherwise(F.concat(F.lit("reply "), e.cast("string"))).alias("llm_output"),
        F.when((kind == "click") & (k % 2 == 0), F.concat(F.lit('{"corpus": "c'), (k % 9).cast("string"), F.lit('"}'))).otherwise("{}").alias("tool_input"),
    )


_ST = """steps as (select *, (seq - 1) % 5 + 1 as turn, k % 4 as evidence_count from (select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as seq, event_type, event_id, k, value as execution_time_ms, k as tokens,
 case event_type when 'click' then 'opensearch_retriever' when 'view' then 'reranker' when 'purchase' then 'finalizer' when 'signup' then 'planner' else 'answer_drafter' end as component,
 case when event_type = 'error' then 'failed' end as error, case when event_type = 'error' then 'FAIL' when k % 10 = 0 then 'REPLAN' else 'PROCEED' end as verdict,
 case when event_type = 'error' then 'ERROR' when event_type = 'purchase' and k % 3 = 0 then 'FINISH' else 'CONTINUE' end as stop_condition, case when event_type = 'signup' then 'BREADTH' else '' end as rationale_tag,
 case when event_type in ('signup', 'error') then 'prompt ' || cast(event_id as varchar) end as llm_input, case when k % 5 = 0 then null when k % 5 = 1 then '' else 'reply ' || cast(event_id as varchar) end as llm_output,
 case when event_type = 'click' and k % 2 = 0 then 'c' || cast(k % 9 as varchar) end as named_corpus
 from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)))"""
_STAGE = """case when component in ('planner', 'query_formulator') then '{}' when component in ('opensearch_retriever', 'vector_retriever', 'chatnoir_retriever') then 'retrieving'
 when component in ('reranker', 'filter', 'deduplicator', 'extractor') then 'processing' when component in ('answer_drafter', 'finalizer') then 'synthesizing' when component in ('fact_checker', 'attribution_gate') then 'verifying' else 'unknown' end"""


def _explorations(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    docs = _read(spark, d, "events").select(F.col("user_id").alias("seed_id"), F.datediff(F.col("ts"), F.lit("2023-12-31")).alias("iteration"), F.get_json_object("props", "$.k").alias("doc"), "value")
    rows = docs.groupBy("seed_id", "iteration").agg(F.array_sort(F.collect_set("doc")).alias("doc_ids"), F.count("*").alias("evidence_count"), F.round(F.avg("value") / 500, 6).alias("similarity_score"))
    text = F.concat(F.lit("query "), (F.col("iteration") % 7).cast("string"))
    answer = F.when(F.col("iteration") % 5 != 0, F.concat(F.lit("answer "), F.col("iteration").cast("string"))).otherwise("")
    return rows.select("seed_id", "iteration", text.alias("query"), answer.alias("answer"), "doc_ids", "similarity_score", (F.col("iteration") % 3 + 1).alias("iterations_taken"), "evidence_count")


_EX = """explorations as (select seed_id, iteration, 'query ' || cast(iteration % 7 as varchar) as query, case when iteration % 5 <> 0 then 'answer ' || cast(iteration as varchar) else '' end as answer, doc_ids, similarity_score,
 iteration % 3 + 1 as iterations_taken, evidence_count from (select user_id as seed_id, date_diff('day', date '2023-12-31', cast(ts as date)) as iteration, list_sort(list(distinct json_extract_string(props, '$.k'))) as doc_ids,
 count(*) as evidence_count, round(avg(value) / 500, 6) as similarity_score from events group by all))"""


# Retrieval.

_BM25_SQL = """{head}, docs as (select doc_id, len({tok}) as dl, {tok} as words from documents), n as (select count(*) as n, avg(dl) as mean from docs),
 terms as (select distinct {by}, unnest({qtok}) as term from {asked}), hits as (select doc_id, dl, term, count(*) as tf from (select doc_id, dl, unnest(words) as term from docs) where term in (select term from terms) group by all),
 df as (select term, count(*) as df from hits group by term),
 scored as (select {by}, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 4) as score from terms join hits using (term) join df using (term), n group by {by}, doc_id),
 ranked as (select *, row_number() over (partition by {by} order by score desc, cast(doc_id as varchar)) as rank from scored)"""


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")


@query("with " + _BM25_SQL.format(head=_Q, tok=_TOK.format("text"), by="query_id", qtok=_TOK.format("query"), asked="asked") + " select query_id, rank, cast(doc_id as varchar) as id, score from ranked where rank <= 20")
def bm25_topk(spark, d):
    return retrieval.bm25_top_k(_corpus(spark, d), _asked(spark, d), 20).withColumn("rank", F.col("rank").cast("long"))


_ANGLES = _Q + ", angles as (select query_id, i as angle, string_split(query, '.')[i + 1] as query, 20 as k from asked, unnest(range(len(string_split(query, '.')))) u(i) where len(string_split(query, '.')) > 1 union all select query_id, 0, query, 50 from asked where len(string_split(query, '.')) <= 1)"


@query("with " + _BM25_SQL.format(head=_ANGLES, tok=_TOK.format("text"), by="query_id, angle", qtok=_TOK.format("query"), asked="angles") + " select query_id, cast(angle as bigint) as angle, rank, cast(doc_id as varchar) as id, score from ranked join angles using (query_id, angle) where rank <= k")
def bm25_multi_angle(spark, d):
    asked = _asked(spark, d).withColumn("subgoals", F.split("query", r"\."))
    top = retrieval.multi_angle_top_k(_corpus(spark, d), asked)
    return top.select("query_id", F.col("angle").cast("long").alias("angle"), F.col("rank").cast("long").alias("rank"), "id", "score")


@query("""with p as (select vec_id as q, embedding as a from embeddings where vec_id % 100 = 0), s as (select q, vec_id, round(list_sum(list_transform(list_zip(a, embedding), lambda x: cast(x[1] as double) * cast(x[2] as double))), 4) as score from p, embeddings),
 r as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from s) select q as query_id, rank, vec_id as id, score from r where rank <= 25""")
def knn_cosine_topk(spark, d):
    """Queries are the vectors whose id is divisible by 100, against all vectors."""
    vectors = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    probes = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return retrieval.knn_top_k(vectors, probes).withColumn("rank", F.col("rank").cast("long"))


def _hits(spark, d):
    return _read(spark, d, "events").select(F.col("user_id").alias("query_id"), F.get_json_object("props", "$.k").alias("id"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("angle"), F.col("event_id").alias("rank"))


_HITS = "hits as (select user_id as query_id, json_extract_string(props, '$.k') as id, dense_rank() over (partition by user_id order by event_type) as angle, event_id as rank from events)"


@query(f"with {_HITS}, f as (select *, row_number() over (partition by query_id, id order by angle, rank) as n from hits) select query_id, id, rank, row_number() over (partition by query_id order by angle, rank, id) - 1 as pos from f where n = 1")
def evidence_insert_dedup(spark, d):
    return retrieval.inserted(_hits(spark, d), ["angle", "rank"]).select("query_id", "id", "rank", F.col("pos").cast("long").alias("pos"))


@query(f"with {_HITS}, f as (select *, row_number() over (partition by query_id, id order by angle, rank) as n from hits h where not exists (select 1 from hits s where s.query_id = h.query_id and s.id = h.id and s.rank % 5 = 0)) select query_id, id, rank, row_number() over (partition by query_id order by angle, rank, id) - 1 as pos from f where n = 1")
def evidence_tombstone(spark, d):
    hits = _hits(spark, d)
    return retrieval.inserted(hits, ["angle", "rank"], hits.where("rank % 5 = 0")).select("query_id", "id", "rank", F.col("pos").cast("long").alias("pos"))


@query(f"with {_Q}, {_BM25_SQL.format(head='x as (select 1)', tok=_TOK.format('text'), by='query_id', qtok=_TOK.format('query'), asked='asked')} select query, string_agg(cast(doc_id as varchar), ',' order by rank) as doc_ids from ranked join asked using (query_id) where rank <= 20 group by query")
def topk_map(spark, d):
    asked = _asked(spark, d)
    top = retrieval.bm25_top_k(_corpus(spark, d), asked, 20).join(asked, "query_id")
    return retrieval.top_k_map(top).select("query", F.array_join("doc_ids", ",").alias("doc_ids"))


# Processing.

def _kept(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.col("pos").cast("long").alias("pos"))


@query(f"with {_EV} select query_id, id, pos from (select *, row_number() over (partition by query_id order by pos0) - 1 as pos from (select query_id, id, pos as pos0 from evidence where length(text) between 30 and 10000 and coalesce(score, 1.0) >= 0.0)) where pos < 15")
def filter_quality(spark, d):
    return _kept(processing.filtered(_evidence(spark, d)))


@query(f"with {_EV} select query_id, id, pos from (select *, row_number() over (partition by query_id order by pos0) - 1 as pos from (select query_id, id, pos as pos0 from evidence where length(text) between 30 and 10000 and coalesce(score, 1.0) >= 0.5)) where pos < 15")
def filter_min_score_default(spark, d):
    return _kept(processing.filtered(_evidence(spark, d), min_score=0.5))


_DEDUP = "with {ev}, f as (select *, row_number() over (partition by query_id, {key} order by pos) as n from evidence) select query_id, id, pos from (select query_id, id, row_number() over (partition by query_id order by pos) - 1 as pos from f where n = 1) where pos < 20"


@query(_DEDUP.format(ev=_EV, key="left(text, 50)"))
def dedup_text_prefix(spark, d):
    return _kept(processing.deduplicated(_evidence(spark, d)))


@query(_DEDUP.format(ev=_EV, key="text"))
def dedup_exact(spark, d):
    return _kept(processing.deduplicated(_evidence(spark, d), "exact"))


@query(f"with {_EV} select query_id, id, pos from evidence where pos < 20")
def extract_head(spark, d):
    return _kept(processing.extracted(_evidence(spark, d)))


@query(f"""with {_EV}, s as (select *, round(0.7 * coalesce(score, 0.5) + 0.3 * (1 - (cast(pos as double) / greatest(count(*) over (partition by query_id), 1))), 4) as rerank_score from evidence)
 select query_id, id, rerank_score, p as pos from (select *, row_number() over (partition by query_id order by rerank_score desc, pos) - 1 as p from s) where p < 20""")
def rerank_simple(spark, d):
    return processing.reranked(_evidence(spark, d), _asked(spark, d), "simple").select("query_id", "id", "rerank_score", F.col("pos").cast("long").alias("pos"))


@query(f"""with {_EV}, {_Q}, w as (select query_id, pos, id, {_TOK.format('text')} as words from evidence), sets as (select query_id, count(*) as n, avg(len(words)) as mean from w group by 1),
 tf as (select query_id, pos, dl, term, count(*) as tf from (select query_id, pos, len(words) as dl, unnest(words) as term from w) group by all),
 df as (select query_id, term, ln(n - df + 0.5) - ln(df + 0.5) as raw, mean from (select query_id, term, count(*) as df from tf group by all) join sets using (query_id)),
 m as (select query_id, avg(raw) as mean_idf from df group by 1), q as (select query_id, term, count(*) as times from (select query_id, unnest({_TOK.format('query')}) as term from asked) group by all),
 s as (select query_id, pos, sum(times * (case when raw < 0 then 0.25 * mean_idf else raw end) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))) as s from tf join q using (query_id, term) join df using (query_id, term) join m using (query_id) group by all),
 r as (select query_id, id, round(coalesce(s, 0), 4) as rerank_score, w.pos from w left join s using (query_id, pos))
 select query_id, id, rerank_score, p as pos from (select *, row_number() over (partition by query_id order by rerank_score desc, pos) - 1 as p from r) where p < 20""")
def rerank_bm25(spark, d):
    return processing.reranked(_evidence(spark, d), _asked(spark, d), "bm25").select("query_id", "id", "rerank_score", F.col("pos").cast("long").alias("pos"))


@query(f"""with {_EV}, s as (select *, round(0.7 * coalesce(score, 0.5) + 0.3 * (1 - (cast(pos as double) / count(*) over (partition by query_id))), 4) as r from evidence), t as (select *, row_number() over (partition by query_id order by r desc, pos) as n from s)
 select query_id, string_agg(printf('%.4f', r) || ': ' || left(text, 80), chr(10) order by n) as narrative from t where n <= 3 group by 1""")
def rerank_narrative(spark, d):
    return processing.rerank_narrative(processing.reranked(_evidence(spark, d), _asked(spark, d), "simple"))


@query(f"with {_EV} select query_id, cast(count(*) as bigint) as original_count, least(count(*) filter (length(text) between 30 and 10000), 15) as kept_count, count(*) - least(count(*) filter (length(text) between 30 and 10000), 15) as removed from evidence group by 1")
def filter_counts(spark, d):
    before = _evidence(spark, d)
    return processing.counts(before, processing.filtered(before))


@query(f"with {_EV} select query_id, pos + 1 as citation, id as doc_id, source, left(text, 200) as text, coalesce(score, 0.0) as score from evidence where pos < 10")
def citations(spark, d):
    return answers.citations(_evidence(spark, d))


@query(f"with {_EV} select query_id, string_agg('[' || cast(pos + 1 as varchar) || '] ' || left(text, 300), chr(10) || chr(10) order by pos) as evidence_text, count(*) as evidence_used from evidence where pos < 10 group by 1")
def draft_prompt(spark, d):
    return answers.evidence_text(_evidence(spark, d))


# Parsing of responses: responses are made of documents' lines.

def _responses(spark, d):
    line = F.concat(F.lit("REASONING: because "), F.col("lang"), F.lit("\nSUB-GOALS:\n1. find "), F.col("text"), F.lit("\n- "), F.col("text"), F.lit("\n• abc\nplain\n2024 elections of "), F.col("source"), F.lit("\n3) last goal here"))
    line = F.when(F.col("doc_id") % 5 == 0, F.replace(line, F.lit("SUB-GOALS:"), F.lit(""))).otherwise(line)
    return _read(spark, d, "documents").select("doc_id", line.alias("response"), "text", "lang", "source")


_RESP = """responses as (select doc_id, lang, source, text, case when doc_id % 5 = 0 then replace(r, 'SUB-GOALS:', '') else r end as response from (select *, 'REASONING: because ' || lang || chr(10) || 'SUB-GOALS:' || chr(10) || '1. find ' || text || chr(10) || '- ' || text || chr(10) || '• abc' || chr(10) || 'plain' || chr(10) || '2024 elections of ' || source || chr(10) || '3) last goal here' as r from documents))"""
_WS = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"


@query(f"""with {_RESP}, body as (select doc_id, case when contains(response, 'SUB-GOALS:') then split_part(response, 'SUB-GOALS:', 2) else response end as b from responses),
 l as (select doc_id, list_filter(list_transform(list_filter(list_transform(string_split(b, chr(10)), lambda s: {_WS.format('s')}), lambda s: regexp_matches(s, '^[0-9•-]')), lambda s: {_WS.format("regexp_replace(s, '^[0-9.•)-]+', '')")}), lambda s: length(s) > 5)[1:3] as g from body)
 select doc_id, array_to_string(g, '|') as goals, cast(len(g) as integer) as n from l""")
def parse_subgoals(spark, d):
    goals = answers.planned_goals(F.col("response"), 3)
    return _responses(spark, d).select("doc_id", goals.alias("g")).select("doc_id", F.array_join("g", "|").alias("goals"), F.size("g").alias("n"))


@query(f"select doc_id, nullif({_WS.format('text')}, '') as answer from documents")
def parse_answer_marker(spark, d):
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("REASONING: why\nANSWER: "), "text")).otherwise(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", answers.drafted_answer(said).alias("answer"))


@query("select doc_id, case when doc_id % 4 = 0 then null else '[\"' || source || '\", \"' || lang || '\"]' end as list, case when doc_id % 4 = 0 then null else source || '|' || lang end as items from documents")
def parse_json_bracket(spark, d):
    said = F.when(F.col("doc_id") % 4 == 0, F.lit("no list")).otherwise(F.concat(F.lit("Here: [\""), "source", F.lit("\", \""), "lang", F.lit("\"] done")))
    part = T.bracket_slice(said)
    return _read(spark, d, "documents").select("doc_id", part.alias("list"), F.array_join(T.json_strings(part), "|").alias("items"))


@query("select doc_id, case doc_id % 3 when 2 then lang || ' plain' else '{\"a\": \"' || source || '\"}' end as body from documents")
def strip_code_fence(spark, d):
    body = F.concat(F.lit('{"a": "'), "source", F.lit('"}'))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" ```\n"), body, F.lit("\n``` more"))).otherwise(F.concat("lang", F.lit(" plain")))
    return _read(spark, d, "documents").select("doc_id", T.code_fence_stripped(said).alias("body"))


@query("""select doc_id, array_to_string(list_concat(own, list_filter(list_distinct_in_order, lambda x: not list_contains(own, x))[1:greatest(6 - len(list_distinct(own)), 0)]), '|') as goals from (select doc_id, [lang, source, lang] as own,
 list_filter([source, 'a', 'b', 'c', 'd', 'e'], lambda x: true) as list_distinct_in_order from documents)""")
def consultant_merge(spark, d):
    own, others = F.array("lang", "source", "lang"), F.array(F.col("source"), *(F.lit(x) for x in "abcbde"))
    return _read(spark, d, "documents").select("doc_id", F.array_join(T.merged_goals(own, others, 3), "|").alias("goals"))


@query("select doc_id, case doc_id % 4 when 0 then source || ' x|' || lang when 1 then source || '|' || lang when 2 then source || '|' || lang else 'the query' end as queries from documents")
def query_formulator_fallback(spark, d):
    n = F.col("doc_id") % 4
    said = F.when(n == 0, F.concat(F.lit('{"queries": ["'), "source", F.lit(' x", " ", "'), "lang", F.lit('"]}'))).when(n == 1, "not json").otherwise('{"queries": []}')
    goals = F.when(n != 3, F.array("source", "lang"))
    return _read(spark, d, "documents").select("doc_id", F.array_join(answers.formulated_queries(said, goals, F.lit("the query")), "|").alias("queries"))


# Verification and control.

_GATE = "with " + _EV + ", held as (select query_id, count(*) as n from evidence group by 1), {q} select query_id, query_id <> 'src3' as success, case when query_id <> 'src3' then coalesce(n, 0) >= {need} end as passed, case when query_id <> 'src3' then least(coalesce(n, 0) / 5.0, 1.0)::double end as confidence, coalesce(n, 0) as evidence_count from asked left join held using (query_id)"


@query(_GATE.format(q=_Q, need=3))
def fact_check(spark, d):
    return answers.checked(_asked(spark, d), _evidence(spark, d), F.when(F.col("query_id") != "src3", "draft"), 3)


@query(_GATE.format(q=_Q, need=2))
def attribution_gate(spark, d):
    return answers.checked(_asked(spark, d), _evidence(spark, d), F.when(F.col("query_id") != "src3", "draft"), 2)


def _condition(spark, d, kind: str, value: Column, threshold: float):
    out = answers.condition(kind, value, threshold, "finish", "continue")
    return _read(spark, d, "events").select("event_id", *(c.alias(n) for n, c in out.items()))


@query("select event_id, value / 500 as condition_value, value / 500 >= 0.6 as condition_met, case when value / 500 >= 0.6 then 'finish' else 'continue' end as branch_taken from events")
def condition_threshold(spark, d):
    return _condition(spark, d, "threshold", F.col("value") / 500, 0.6)


_KSQL = "cast(json_extract_string(props, '$.k') as bigint)"


@query(f"select event_id, {_KSQL} as condition_value, {_KSQL} >= 50 as condition_met, case when {_KSQL} >= 50 then 'finish' else 'continue' end as branch_taken from events")
def condition_evidence_count(spark, d):
    return _condition(spark, d, "evidence_count", F.get_json_object("props", "$.k").cast("long"), 50)


@query(f"select event_id, {_KSQL} as condition_value, {_KSQL} <= 50 as condition_met, case when {_KSQL} <= 50 then 'finish' else 'continue' end as branch_taken from events")
def condition_iteration_count(spark, d):
    return _condition(spark, d, "iteration_count", F.get_json_object("props", "$.k").cast("long"), 50)


def _conversation_answers(spark, d):
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("I CANNOT answer: "), "text")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" The Evidence doesn't contain it"))).otherwise(F.col("text"))
    return _read(spark, d, "conversations").select("conv_id", "turn", t.alias("answer"))


@query("""select conv_id, turn, regexp_matches(lower(case turn % 3 when 0 then 'i cannot answer: ' || text when 1 then text || ' the evidence doesn''t contain it' else text end),
 'cannot answer|cannot provide|insufficient evidence|not enough information|no information|unable to answer|don''t have enough|cannot determine|not provided in the evidence|evidence does not contain|evidence doesn''t contain') as cannot_answer from conversations""")
def cannot_answer_flag(spark, d):
    return _conversation_answers(spark, d).select("conv_id", "turn", T.cannot_answer(F.col("answer")).alias("cannot_answer"))


@query(f"select doc_id, v as verified, case when v then 0.85 else 0.5 end::double as confidence from (select doc_id, coalesce(length({_WS.format("case doc_id % 3 when 0 then ' ' || source when 1 then '' else text end")}) > 10, false) as v from documents)")
def external_verification(spark, d):
    n = F.col("doc_id") % 3
    out = answers.external_verdict(F.when(n == 0, F.concat(F.lit(" "), "source")).when(n == 1, "").otherwise(F.col("text")))
    return _read(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in out.items()))


@query("select doc_id, v as verified, not v as flagged from (select doc_id, case doc_id % 5 when 0 then true when 1 then false when 2 then true when 3 then false else true end as v from documents)")
def realtime_verification(spark, d):
    n = F.col("doc_id") % 5
    answer = F.when(n == 0, "Cannot determine this").otherwise("an answer")
    said = F.when(n == 1, 'so: {"verified": false, "reason": "x"} ok').when(n == 2, '{"verified": true}').when(n == 3, "no json").otherwise('{"reason": "y"}')
    out = answers.realtime_verdict(answer, said)
    return _read(spark, d, "documents").select("doc_id", *(c.alias(k) for k, c in out.items()))


_CAT = ", ".join(f"('{k}', '{v}')" for k, v in answers.CATEGORIES.items())


@query(f"with c(component, category) as (values {_CAT}), s as (select event_id as query_id, {_KSQL} % 2 as n from events) select query_id, component from s, c where n > 0 or category not in ('processing', 'synthesis', 'verification')")
def available_components(spark, d):
    dim = spark.createDataFrame(list(answers.CATEGORIES.items()), "component string, category string")
    states = _read(spark, d, "events").select(F.col("event_id").alias("query_id"), (F.get_json_object("props", "$.k").cast("long") % 2).alias("evidence_count"))
    return answers.available(states, dim)


@query(f"with {_ST} select run_id, seq, sum(case when verdict in ('FAIL', 'REPLAN') then 1 else 0 end) over (partition by run_id order by seq rows between 2 preceding and current row) >= 2 as replan from steps")
def should_replan(spark, d):
    return answers.should_replan(_steps(spark, d)).select("run_id", "seq", "replan")


# Similarity.

@query(f"""with b as (select item_id, unnest(list_distinct({_TOK.format('text')})) as t from benchmark), d as (select doc_id, unnest(list_distinct({_TOK.format('text')})) as t from documents),
 n as (select item_id, count(*) as n from b group by 1), m as (select doc_id, count(*) as m from d group by 1), c as (select item_id, doc_id, count(*) as c from b join d using (t) group by all)
 select item_id, doc_id, round(c / (n + m - c), 6) as overlap from c join n using (item_id) join m using (doc_id)""")
def token_overlap(spark, d):
    """The benchmark's items are the queries, against all documents; pairs without a common token have none and no row."""
    items, docs = _read(spark, d, "benchmark").select("item_id", "text"), _read(spark, d, "documents").select("doc_id", "text")
    return retrieval.token_overlaps(items, docs, "item_id", "doc_id").withColumn("overlap", F.round("overlap", 6))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: cast(x[1] as double) * cast(x[2] as double)))"
_NORM = "sqrt(list_sum(list_transform({a}, lambda x: cast(x as double) * cast(x as double))))"


@query(f"select a.vec_id as a, b.vec_id as b, round({_DOT.format(a='a.embedding', b='b.embedding')} / ({_NORM.format(a='a.embedding')} * {_NORM.format(a='b.embedding')}), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def embedding_cosine(spark, d):
    e = _read(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.expr("b = a + 1")).select("a", "b", F.round(S.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(f"""with t as (select doc_id, case when doc_id % 4 = 0 then ' ' else text end as a, case when doc_id % 3 = 0 then '' else replace(text, 'er', 'ar') end as g from documents), s as (select doc_id, a, g, list_distinct({_TOK.format('a')}) as x, list_distinct({_TOK.format('g')}) as y from t)
 select doc_id, case when doc_id % 4 = 0 then 0.0 when doc_id % 3 = 0 then 1.0 when len(x) = 0 or len(y) = 0 then 0.0 else round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) end as overlap, case when doc_id % 4 = 0 then 0.0 when doc_id % 3 = 0 then 1.0 else 0.5 end::double as bleu from s""")
def similarity_dispatch(spark, d):
    a = F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("text"))
    g = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.replace("text", F.lit("er"), F.lit("ar")))
    return _read(spark, d, "documents").select("doc_id", F.round(S.answer_similarity("token_overlap", a, g), 6).alias("overlap"), S.answer_similarity("bleu", a, g).alias("bleu"))


@query(f"select vec_id, round(list_sum(list_transform(embedding, lambda x: abs(cast(x as double) / ({_NORM.format(a='embedding')} + 1e-8)))), 6) as l1, round(cast(embedding[1] as double) / ({_NORM.format(a='embedding')} + 1e-8), 6) as first from embeddings")
def l2_normalize(spark, d):
    v = _read(spark, d, "embeddings").select("vec_id", S.l2_normalized(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"), F.round(F.col("v")[0], 6).alias("first"))


@query(f"with s as (select embedding as y, vec_id as p from embeddings where vec_id < 5) select vec_id, round(0.7 * (vec_id % 20) - 0.3 * max({_DOT.format(a='embedding', b='y')}), 5) as score from embeddings, s group by vec_id")
def mmr_step(spark, d):
    """One step: all vectors against the first five, which are picked already."""
    e = _read(spark, d, "embeddings")
    picked = e.where("vec_id < 5").agg(F.collect_list("embedding").alias("picked"))  # five rows
    return e.join(F.broadcast(picked)).select("vec_id", F.round(S.mmr_score((F.col("vec_id") % 20).cast("double"), F.col("embedding"), F.col("picked"), 0.7), 5).alias("score"))


@query(f"with {_EX} select seed_id, iteration, round(len(list_filter(doc_ids, lambda x: cast(x as integer) < 30)) / greatest(len(doc_ids), 1), 6) as overlap, len(list_filter(doc_ids, lambda x: cast(x as integer) < 30)) / greatest(len(doc_ids), 1) <= 0.6 as novel, cast(len(list_filter(doc_ids, lambda x: cast(x as integer) >= 30)) as integer) as marginal from explorations")
def novelty_step(spark, d):
    seen = F.array(*(F.lit(str(i)) for i in range(30)))
    share = S.overlap_share(F.col("doc_ids"), seen)
    return _explorations(spark, d).select("seed_id", F.col("iteration").cast("long").alias("iteration"), F.round(share, 6).alias("overlap"), (share <= 0.6).alias("novel"), F.size(F.array_except("doc_ids", seen)).alias("marginal"))


# Traces.

@query(f"with {_ST} select run_id, seq, {_STAGE.format('initial')} as stage from steps")
def stage_batch(spark, d):
    return _steps(spark, d).select("run_id", "seq", X.stage(F.col("component")).alias("stage"))


@query(f"with {_ST} select run_id, seq, {_STAGE.format('planning')} as stage from steps")
def stage_stream(spark, d):
    return _steps(spark, d).select("run_id", "seq", X.stage(F.col("component"), True).alias("stage"))


_REWARD = "round((case when error is not null then -0.5 else 1.0 end + case when evidence_count > 0 then 0.2 else 0 end + case when stop_condition = 'FINISH' then 2.0 else 0 end)::double, 4)"
_REWARD_S = "round((case when error is not null then -1.0 else 0.1 end + case when evidence_count > 0 then 0.2 else 0 end + case when component in ('answer_drafter', 'finalizer') then 0.5 else 0 end)::double, 4)"


@query(f"with {_ST} select run_id, seq, {_REWARD} as reward from steps")
def reward_batch(spark, d):
    return _steps(spark, d).select("run_id", "seq", F.round(X.reward_exported(F.col("error"), F.col("evidence_count"), F.col("stop_condition")), 4).alias("reward"))


@query(f"with {_ST} select run_id, seq, {_REWARD_S} as reward from steps")
def reward_stream(spark, d):
    return _steps(spark, d).select("run_id", "seq", F.round(X.reward_streamed(F.col("error"), F.col("evidence_count"), F.col("component")), 4).alias("reward"))


@query(f"select event_id, case {_KSQL} % 6 when 0 then 0 when 1 then {_KSQL} when 2 then 7 when 3 then {_KSQL} + 1 when 4 then 2 else 99 end as evidence_count from events")
def evidence_count_resolution(spark, d):
    k = F.get_json_object("props", "$.k")
    n = k.cast("long") % 6
    data = F.when(n == 0, '{"retrieved_count": 0, "evidence_count": 5}').when(n == 1, F.concat(F.lit('{"filtered_count": '), k, F.lit("}"))).when(n == 2, '{"reranked_count": 7, "subgoals": []}').when(n == 3, F.concat(F.lit('{"evidence_count": '), (k.cast("long") + 1).cast("string"), F.lit("}"))).when(n == 4, '{"subgoals": ["a", "b"]}').otherwise("{}")
    return _read(spark, d, "events").select("event_id", X.evidence_count(data, F.lit(99)).alias("evidence_count"))


@query(f"select event_id, case when event_type = 'error' then 'FAIL' when {_KSQL} % 3 = 0 then 'REPLAN' else 'PROCEED' end as verdict, case when event_type = 'error' then 'ERROR' else 'CONTINUE' end as stop_condition, case {_KSQL} % 3 when 0 then 'because' when 1 then 'said' else 'Executed ' || event_type end as thought from events")
def verdict(spark, d):
    ok, n = F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("long") % 3
    none = F.lit(None).cast("string")
    return _read(spark, d, "events").select("event_id", X.verdict(ok, F.when(n == 0, "REPLAN")).alias("verdict"), X.stop_condition(ok).alias("stop_condition"), X.thought(F.when(n == 0, "because").when(n == 1, ""), F.when(n == 1, "said").otherwise(none), F.col("event_type")).alias("thought"))


@query(f"with {_ST} select run_id, component, count(*) as uses from steps group by all")
def tool_usage(spark, d):
    return traces.tool_usage(_steps(spark, d))


def _rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query(f"with {_ST} select run_id, component, count(*) as count, round(sum(execution_time_ms), 7) as total_ms, min(execution_time_ms) as min_ms, max(execution_time_ms) as max_ms, round(avg(execution_time_ms), 7) as avg_ms from steps group by all")
def latency_by_tool(spark, d):
    return _rounded(traces.latency_by_tool(_steps(spark, d)), "total_ms", "avg_ms", places=7)


@query(f"with {_ST} select run_id, component, count(*) as count, cast(sum(tokens) as bigint) as total, round(avg(tokens), 4) as avg from steps group by all")
def tokens_by_tool(spark, d):
    return _rounded(traces.tokens_by_tool(_steps(spark, d)), "avg")


_TOTALS = "select run_id, count(*) as total_steps, round(sum(execution_time_ms), 4) as total_latency_ms, cast(sum(tokens) as bigint) as total_tokens, round(sum(tokens) / 1000.0 * 0.01, 6)::double as total_cost"


@query(f"with {_ST} {_TOTALS}, round(sum(execution_time_ms) / count(*), 4) as avg_latency_per_step_ms, round(sum(tokens) / count(*), 4)::double as avg_tokens_per_step, arg_max(evidence_count, seq) as final_evidence_count, 0::bigint as compat_final_evidence_count from steps group by run_id")
def run_totals(spark, d):
    out = _rounded(traces.run_totals(_steps(spark, d)), "total_latency_ms", "avg_latency_per_step_ms", "avg_tokens_per_step")
    return _rounded(out, "total_cost", places=6)


@query(f"with {_ST}, t as ({_TOTALS} from steps group by run_id) select *, 'run ' || cast(run_id as varchar) as name, '2024-01-02T03:04:05.000006Z' as created_at from t")
def manifest(spark, d):
    steps = _steps(spark, d)
    runs = steps.select("run_id").distinct().withColumn("name", F.concat(F.lit("run "), F.col("run_id").cast("string")))
    at = F.expr("timestamp_ntz'2024-01-02 03:04:05.000006'")
    return _rounded(_rounded(traces.manifest(steps, runs, at), "total_latency_ms"), "total_cost", places=6)


@query(f"with {_ST} select run_id, coalesce(arg_min(named_corpus, seq) filter (named_corpus is not null), 'default') as corpus from steps group by run_id")
def run_config(spark, d):
    return traces.run_config(_steps(spark, d), "default")


@query(f"with {_ST} select run_id, string_agg(component || '=' || cast(n as varchar), ',' order by component) as tool_usage from (select run_id, component, count(*) as n from steps group by all) group by run_id")
def run_stats(spark, d):
    entries = F.array_sort(F.map_entries("tool_usage"))
    return traces.run_stats(_steps(spark, d)).select("run_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("tool_usage"))


@query(f"with {_ST} select run_id, seq, turn as step_id, evidence_count, 0.0::double as evidence_available_pct, 0.0::double as retrieval_overlap from steps")
def evidence_progression(spark, d):
    return traces.evidence_progression(_steps(spark, d))


@query(f"with {_ST} select run_id, seq, turn as step_id, component as tool, rationale_tag, stop_condition, llm_input, llm_output, evidence_count, execution_time_ms, error, '' as private_reasoning from steps")
def trace_lines(spark, d):
    return traces.traces(_steps(spark, d)).select("run_id", "seq", "step_id", "action.tool", "rationale_tag", "stop_condition", "llm_input", "llm_output", "evidence_count", "execution_time_ms", "error", "private_reasoning")


@query(f"with {_ST} select run_id, seq, turn as step_id, component as tool, {_REWARD} as reward, coalesce(lead(turn) over w, 0) as next_step_id, coalesce(lead(evidence_count) over w, 0) as next_evidence_count, coalesce(lead({_STAGE.format('initial')}) over w, 'done') as next_stage, lead(seq) over w is null or stop_condition = 'FINISH' as done from steps window w as (partition by run_id order by seq)")
def trajectory_next_state(spark, d):
    t = traces.trajectories(_steps(spark, d))
    return t.select("run_id", "seq", "state.step_id", "action.tool", F.round("reward", 4).alias("reward"), F.col("next_state.step_id").alias("next_step_id"), F.col("next_state.evidence_count").alias("next_evidence_count"), F.col("next_state.state_stage").alias("next_stage"), "done")


@query(f"with {_ST} select run_id, seq, {_REWARD_S} as reward, {_STAGE.format('planning')} as state_stage, stop_condition = 'FINISH' as done from steps")
def trajectory_streamed(spark, d):
    return traces.trajectories(_steps(spark, d), True).select("run_id", "seq", F.round("reward", 4).alias("reward"), "state.state_stage", "done")


@query(f"with {_ST} select run_id, seq, coalesce(string_agg(component, ',') over (partition by run_id order by seq rows between unbounded preceding and 1 preceding), '') as previous_tools from steps")
def previous_tools(spark, d):
    return traces.previous_tools(_steps(spark, d)).select("run_id", "seq", F.array_join("previous_tools", ",").alias("previous_tools"))


@query(f"with {_ST} select run_id, seq, turn as step_id, llm_input as input, llm_output as output, component as tool, rationale_tag, stop_condition as decision_label, execution_time_ms as latency_ms, tokens from steps where llm_input <> '' and llm_output <> ''")
def supervised_pairs(spark, d):
    return traces.supervised(_steps(spark, d))


@query(f"with {_ST}, {_EV}, {_Q} select (select count(*) from steps) as trace_steps, (select count(*) from steps) as trajectory_steps, (select count(*) from steps where llm_input <> '' and llm_output <> '') as supervised_pairs, (select count(distinct id) from evidence) as unique_documents, (select count(distinct query) from asked) as total_queries")
def corpus_stats(spark, d):
    return traces.corpus_stats(_steps(spark, d), _evidence(spark, d), _asked(spark, d))


@query("select doc_id as sample_id, source from documents where not (doc_id % 3 = 0)")
def resume_pending(spark, d):
    samples = _read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "source")
    ledger = samples.where("sample_id % 6 in (0, 3, 1)").select("sample_id", F.when(F.col("sample_id") % 3 == 0, "running").otherwise("completed").alias("status"), F.lit(True).alias("completed"))
    return traces.pending(samples, ledger)


# Coverage and knowledge.

_COV = f"""{_EX}, l as (select *, coalesce(lag(doc_ids) over w, []) as before, row_number() over w as seed_iteration from explorations window w as (partition by seed_id order by iteration)),
 o as (select *, len(list_intersect(doc_ids, before)) as overlap, len(doc_ids) + len(before) - len(list_intersect(doc_ids, before)) as u from l),
 fr as (select seed_id, iteration, count(*) as fresh from (select seed_id, doc, min(iteration) as iteration from (select seed_id, iteration, unnest(doc_ids) as doc from explorations) group by all) group by all),
 cov as (select o.seed_id, seed_iteration, o.iteration, query, doc_ids, len(doc_ids) as docs_count, overlap as overlap_with_prev, case when len(before) = 0 then 0.0 else overlap / u end as jaccard_with_prev, sum(coalesce(fresh, 0)) over (partition by o.seed_id order by o.iteration) as cumulative_unique_docs, len(before) > 0 as has_prev from o left join fr using (seed_id, iteration))"""


@query(f"with {_COV} select seed_id, seed_iteration, iteration, docs_count, overlap_with_prev, round(jaccard_with_prev, 6) as jaccard_with_prev, cast(cumulative_unique_docs as bigint) as cumulative_unique_docs from cov")
def coverage_per_iteration(spark, d):
    return _rounded(coverage.per_iteration(_explorations(spark, d)), "jaccard_with_prev", places=6).select("seed_id", F.col("seed_iteration").cast("long").alias("seed_iteration"), F.col("iteration").cast("long").alias("iteration"), F.col("docs_count").cast("long").alias("docs_count"), F.col("overlap_with_prev").cast("long").alias("overlap_with_prev"), "jaccard_with_prev", "cumulative_unique_docs")


@query(f"with {_COV} select seed_id, count(*) as iterations, cast(max(cumulative_unique_docs) as bigint) as unique_docs, round(coalesce(avg(case when has_prev then jaccard_with_prev end), 0.0), 6) as avg_jaccard from cov group by seed_id")
def coverage_seed_summary(spark, d):
    return _rounded(coverage.seed_summary(coverage.per_iteration(_explorations(spark, d))), "avg_jaccard", places=6)


@query(f"with {_COV} select count(distinct seed_id) as seeds, count(*) as iterations, round(avg(case when seed_iteration > 1 then jaccard_with_prev end), 6) as avg_jaccard, (select count(distinct doc) from (select unnest(doc_ids) as doc from cov)) as unique_docs from cov")
def coverage_global_summary(spark, d):
    return _rounded(coverage.global_summary(coverage.per_iteration(_explorations(spark, d))), "avg_jaccard", places=6)


@query(f"with {_COV} select seed_id, iteration, cast(cumulative_unique_docs as bigint) as cumulative_unique_docs from cov")
def cumulative_unique_docs(spark, d):
    return coverage.per_iteration(_explorations(spark, d)).select("seed_id", F.col("iteration").cast("long").alias("iteration"), "cumulative_unique_docs")


@query(f"with {_EX}, f as (select distinct seed_id, query, unnest(doc_ids) as doc from explorations) select doc, count(*) as frequency, count(distinct query) as queries_found_in from f group by doc")
def doc_frequency(spark, d):
    return coverage.document_frequency(_explorations(spark, d))


@query(f"with {_EX} select count(*) as total_queries, (select count(distinct doc) from (select unnest(doc_ids) as doc from explorations)) as unique_docs, round(sum(len(doc_ids)) / count(*), 6)::double as avg_docs_per_query from explorations")
def kb_stats(spark, d):
    return _rounded(knowledge.stats(_explorations(spark, d)), "avg_docs_per_query", places=6)


@query(f"with {_EX}, r as (select *, row_number() over (partition by seed_id order by iteration desc) as back from explorations) select seed_id, string_agg('Q: ' || query || chr(10) || 'A: ' || case when answer = '' then 'No answer available' else left(answer, 200) end, chr(10) || chr(10) order by iteration) as context from r where back <= 5 group by 1")
def kb_recent_context(spark, d):
    return knowledge.recent_context(_explorations(spark, d))


@query("with r as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) select conv_id as seed_id, string_agg('Q: ' || role || chr(10) || 'A: ' || case when text = '' then 'No answer available' else left(text, 200) end, chr(10) || chr(10) order by turn) as context from r where back <= 3 group by 1")
def message_context(spark, d):
    rows = _read(spark, d, "conversations").select(F.col("conv_id").alias("seed_id"), F.col("turn").alias("iteration"), F.col("role").alias("query"), F.col("text").alias("answer"))
    return knowledge.recent_context(rows, 3)


@query(f"with {_EX} select doc, string_agg(query, '|' order by query) as queries from (select distinct query, unnest(doc_ids) as doc from explorations) group by doc")
def kb_document_index(spark, d):
    return knowledge.document_index(_explorations(spark, d)).select("doc", F.array_join("queries", "|").alias("queries"))


@query(f"with {_EX}, {_EV} select e.seed_id, e.iteration, e.query, (select count(*) from evidence v where v.query_id = 'src' || cast(e.iteration % 20 as varchar) and v.pos < 20) as pieces from explorations e")
def kb_entries(spark, d):
    rows = _explorations(spark, d).withColumn("asked", F.col("query")).withColumn("query", F.concat(F.lit("src"), (F.col("iteration") % 20).cast("string")))
    held = knowledge.entries(rows, processing.extracted(_evidence(spark, d)).withColumnRenamed("query_id", "query"))
    return held.select("seed_id", F.col("iteration").cast("long").alias("iteration"), F.concat(F.lit("query "), (F.col("iteration") % 7).cast("string")).alias("query"), F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("pieces"))


@query(f"with {_EX} select distinct conv_id, turn from conversations where 'query ' || cast(turn as varchar) in (select query from explorations)")
def kb_search(spark, d):
    asked = _read(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("query "), F.col("turn").cast("string")).alias("query"))
    return knowledge.asked_before(asked, _explorations(spark, d)).select("conv_id", "turn")


@query(f"with {_EX} select conv_id, turn from conversations where 'query ' || cast(turn as varchar) not in (select query from explorations where iteration % 7 < 4)")
def explored_filter(spark, d):
    asked = _read(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("query "), F.col("turn").cast("string")).alias("query"))
    return knowledge.unexplored(asked, _explorations(spark, d).where("iteration % 7 < 4")).select("conv_id", "turn")


@query(f"with {_EX} select count(*) as total_explorations, count(distinct seed_id) as seeds, count(distinct query) as unique_queries, (select count(distinct doc) from (select unnest(doc_ids) as doc from explorations)) as unique_docs from explorations")
def exploration_summary(spark, d):
    return coverage.exploration_summary(_explorations(spark, d))


@query(f"with {_EX} select seed_id, cast(sum(iterations_taken) as bigint) as total_iterations, cast(sum(evidence_count) as bigint) as total_evidence, round(sum(similarity_score) / count(*), 4) as avg_similarity from explorations group by 1")
def exploratory_aggregate(spark, d):
    return _rounded(coverage.run_aggregate(_explorations(spark, d)), "avg_similarity")


@query(f"with {_EX}, q as (select distinct seed_id, query from explorations union all select distinct null, query from explorations) select seed_id, string_agg(query, '|' order by query) as queries, count(*) as total from q group by 1")
def queries_explored(spark, d):
    return coverage.queries_explored(_explorations(spark, d)).withColumn("queries", F.array_join("queries", "|"))


@query(f"with {_EX} select seed_id, iteration, query from explorations where seed_id % 10 <> 0 union all select seed_id, iteration, 'new' from explorations where seed_id % 10 = 0 and iteration < 9")
def exploration_log_merge(spark, d):
    old = _explorations(spark, d).select("seed_id", F.col("iteration").cast("long").alias("iteration"), "query")
    return coverage.replaced_by_seed(old, old.where("seed_id % 10 = 0 and iteration < 9").withColumn("query", F.lit("new")))


@query(f"with {_EX}, x as (select seed_id, unnest(doc_ids) as doc from explorations), b as (select seed_id, count(distinct doc) as unique_docs, count(*) as total from x group by 1) select seed_id, count(*) as queries, round(avg(length(query)), 6) as avg_query_length, round(count(distinct query) / count(*), 6) as distinct_query_ratio, any_value(unique_docs) as unique_docs, round(1 - any_value(unique_docs) / any_value(total), 6) as redundancy from explorations join b using (seed_id) group by 1")
def breadth_redundancy(spark, d):
    return _rounded(coverage.breadth_and_redundancy(_explorations(spark, d)), "avg_query_length", "distinct_query_ratio", "redundancy", places=6)


# Small functions.

@query(f"""with c as (select doc_id, text as a, case doc_id % 3 when 0 then 'First, ' || text when 1 then text else 'xq ' || text end as b from documents), t as (select doc_id, b, {_TOK.format('a')} as ta, {_TOK.format('b')} as tb from c)
 select doc_id, case when doc_id % 3 = 0 then 'procedural' when len(list_filter(tb, lambda x: not list_contains(ta, x))) = 0 then 'syntactic' else 'conceptual' end as kind from t""")
def reformulation_class(spark, d):
    a, n = F.col("text"), F.col("doc_id") % 3
    b = F.when(n == 0, F.concat(F.lit("First, "), a)).when(n == 1, a).otherwise(F.concat(F.lit("xq "), a))
    return _read(spark, d, "documents").select("doc_id", T.reformulation(a, b).alias("kind"))


_MODELS = ("custom/x", "ollama/gpt", "GPT-4o", "claude-3", "Gemini-pro", "mistral-7b", "command-r", "together-x", "o1-mini", "unknown")
_MODEL_SQL = "['" + "', '".join(_MODELS) + "'][cast(event_id % 10 as integer) + 1]"


@query(f"""select event_id, case when m like 'custom/%' then 'custom' when m like 'ollama/%' then 'ollama' when regexp_matches(lower(m), 'gpt|openai|o1|davinci|turbo') then 'openai' when regexp_matches(lower(m), 'claude|anthropic') then 'anthropic'
 when regexp_matches(lower(m), 'gemini|palm|bison') then 'google' when contains(lower(m), 'mistral') then 'mistral' when regexp_matches(lower(m), 'cohere|command') then 'cohere' when contains(lower(m), 'together') then 'together' else 'openai' end as provider from (select event_id, {_MODEL_SQL} as m from events)""")
def provider_detect(spark, d):
    m = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("event_id") % 10 + 1).cast("int"))
    return _read(spark, d, "events").select("event_id", T.provider_of(m).alias("provider"))


@query("""select event_id, printf('sample_%03d', event_id + 1) as sample, case event_type when 'click' then 'Click Event' when 'view' then 'View Event' when 'error' then 'Error Event' when 'signup' then 'Signup Event' else 'Purchase Event' end as label,
 case event_id % 4 when 0 then 'adaptive' when 1 then 'standard' else 'standard' end as mode, round(value / 1000 * 0.01, 8) as cost from events""")
def labels_and_costs(spark, d):
    n = F.col("event_id") % 4
    mode = F.when(n == 0, " Adaptive ").when(n == 1, "STANDARD").when(n == 2, "auto").otherwise(F.lit(None))
    return _read(spark, d, "events").select("event_id", T.sample_id(F.col("event_id") + 1).alias("sample"), T.title_label(F.concat("event_type", F.lit("_event"))).alias("label"), T.execution_mode(mode).alias("mode"), F.round(X.cost(F.col("value")), 8).alias("cost"))


@query(f"select event_id, {_KSQL} as prompt_tokens, event_id % 7 as completion_tokens, {_KSQL} + event_id % 7 + case when event_id % 3 = 0 then 1 else 0 end as total_tokens from events")
def usage_normalization(spark, d):
    k, c = F.get_json_object("props", "$.k"), (F.col("event_id") % 7).cast("string")
    n = F.col("event_id") % 3
    total = (k.cast("long") + F.col("event_id") % 7 + 1).cast("string")
    raw = F.when(n == 0, F.concat(F.lit('{"prompt_tokens": '), k, F.lit(', "completion_tokens": '), c, F.lit(', "total_tokens": '), total, F.lit("}"))).when(n == 1, F.concat(F.lit('{"input_tokens": '), k, F.lit(', "output_tokens": '), c, F.lit("}"))).otherwise(F.concat(F.lit('{"prompt_eval_count": '), k, F.lit(', "eval_count": '), c, F.lit("}")))
    return _read(spark, d, "events").select("event_id", *(v.alias(name) for name, v in T.usage(raw).items()))


@query("select doc_id, 'lang,source' as names, 'In ' || lang || ' {x} from ' || source as prompt from documents")
def prompt_render(spark, d):
    template = F.lit("In {lang} {{x}} from {source}")
    names = F.array_sort(F.array_remove(T.placeholders(template), "x"))
    return _read(spark, d, "documents").select("doc_id", F.array_join(names, ",").alias("names"), T.rendered(template, {"lang": F.col("lang"), "source": F.col("source")}).alias("prompt"))


# Sources.

def _lines(spark, d):
    n = F.col("doc_id") % 5
    body = F.regexp_replace("text", r'["\\\s]+', " ")
    line = F.when(n == 0, F.concat(F.lit('{"query": " '), body, F.lit(' ", "text": "t"}'))).when(n == 1, F.concat(F.lit('{"query": "", "question": "'), body, F.lit('"}'))).when(n == 2, F.concat(F.lit('{"text": "'), body, F.lit('"}'))).when(n == 3, '{"other": 1}').otherwise("not json")
    return _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), line.alias("line"))


_BODY = "regexp_replace(text, '[\"\\\\\\s]+', ' ', 'g')"


@query(f"select cast(doc_id as varchar) as file, {_WS.format(_BODY)} as query from documents where doc_id % 5 < 3 and {_WS.format(_BODY)} <> '' union all select cast(doc_id as varchar), 't' from documents where doc_id % 5 = 0 and {_WS.format(_BODY)} = ''")
def candidate_key_precedence(spark, d):
    return readers.from_json_lines(_lines(spark, d))


@query("select cast(doc_id as varchar) as file, unnest([lang, source]) as query from documents")
def candidate_dict_values(spark, d):
    doc = F.concat(F.lit('{"query": {"1": " '), "lang", F.lit('", "2": "'), "source", F.lit('", "3": ""}}'))
    return readers.from_id_map(_read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), doc.alias("document")))


@query("select cast(doc_id as varchar) as file, unnest([lang, source]) as query from documents")
def candidate_dict_keys(spark, d):
    doc = F.concat(F.lit('{"'), "lang", F.lit(' ": "1", "'), "source", F.lit('": "2"}'))
    return readers.from_keys(_read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), doc.alias("document")))


@query("select cast(doc_id as varchar) as file, unnest([lang, source]) as query from documents")
def candidate_records(spark, d):
    doc = F.concat(F.lit('[{"query": "", "question": "'), "lang", F.lit('"}, {"text": " '), "source", F.lit('"}, {"x": "y"}]'))
    return readers.from_records(_read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), doc.alias("document")))


# Set operations and lookups.

@query(f"with {_EX}, l as (select *, coalesce(lag(doc_ids) over (partition by seed_id order by iteration), []) as before from explorations) select seed_id, iteration, len(list_intersect(doc_ids, before)) as met, len(doc_ids) - len(list_intersect(doc_ids, before)) as fresh, len(doc_ids) + len(before) - len(list_intersect(doc_ids, before)) as either, len(doc_ids) + len(before) as listed from l")
def document_set_operations(spark, d):
    df = _explorations(spark, d).withColumn("before", F.coalesce(F.lag("doc_ids").over(Window.partitionBy("seed_id").orderBy("iteration")), F.array().cast("array<string>")))
    return df.select("seed_id", F.col("iteration").cast("long").alias("iteration"), *(F.size(x).cast("long").alias(n) for n, x in (("met", F.array_intersect("doc_ids", "before")), ("fresh", F.array_except("doc_ids", "before")), ("either", F.array_union("doc_ids", "before")), ("listed", F.concat("doc_ids", "before")))))


@query("select d.doc_id, coalesce(l.quality, -1) as quality, d.source from documents d left join labels l using (doc_id)")
def lookup_with_default(spark, d):
    return _read(spark, d, "documents").select("doc_id", "source").join(_read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "source")


# Iteration, seeds and streams.

@query()
def bfs_explore(spark, d):
    """Every user explores from the kind of its first event along a fixed table of questions."""
    first = _read(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("query")).withColumnRenamed("user_id", "seed_id")
    table = spark.createDataFrame([(a, i, b) for a, out in {"click": ("view", "click", "purchase"), "view": ("error", "click"), "purchase": ("signup", "view"), "error": ("view",), "signup": ("error", "purchase")}.items() for i, b in enumerate(out)], "query string, place int, question string")
    return runners.explored(first, lambda head: head.join(table, "query"), 4)


@query()
def kmeans_clusters(spark, d):
    v = _read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return seed_plans.clustered(v, 10).select("vec_id", "cluster")


@query()
def seed_select(spark, d):
    """Seeds among the vectors, with their labels as clusters and four neighbouring numbers as documents."""
    docs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("vec_id") * 3 + i) % 400).cast("string"))
    rows = _read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("query"), F.col("embedding").alias("vector"), F.col("label").alias("cluster"), docs.alias("doc_ids"))
    prior = spark.range(40).select((F.col("id") * 10).cast("string").alias("doc_id"))
    return seed_plans.selected(rows, prior, 40)


def _streamed(spark, stream, name: str, mode: str = "append") -> DataFrame:
    base = f"{shared_folder(spark).rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{id(stream)}"
    streams.appended(stream, f"{base}/out", f"{base}/log", "parquet").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _event_stream(spark, d):
    return streams.event_stream(spark, f"{d}/events.parquet*", _read(spark, d, "events").schema)


@query(f"select distinct user_id, {_KSQL} as k from events")
def stream_dedup(spark, d):
    rows = _event_stream(spark, d).select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "ts")
    return _streamed(spark, streams.first_seen(rows, ["user_id", "k"], delay="400 days"), "dedup").select("user_id", "k")


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as g from e),
 w as (select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from s group by user_id, g) select * from w where session_end <= (select max(ts) from events) - interval 1 day""")
def stream_sessions(spark, d):
    """Only sessions that the watermark has passed are out."""
    out = _streamed(spark, streams.sessions(_event_stream(spark, d), "user_id"), "sessions")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "n")


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as g from e)
 select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from s group by user_id, g""")
def batch_sessions(spark, d):
    return streams.batch_sessions(_read(spark, d, "events"), "user_id")


# The flagship: retrieve, insert, filter, dedup and cite, for all queries in one plan.

_FLAG = f"""with {_Q}, {_BM25_SQL.format(head='x as (select 1)', tok=_TOK.format('text'), by='query_id', qtok=_TOK.format('query'), asked='asked')},
 f as (select query_id, r.doc_id, d.text, r.rank, row_number() over (partition by query_id order by r.rank) - 1 as pos, score from ranked r join documents d using (doc_id) where r.rank <= 20 and length(d.text) between 30 and 10000 and d.text <> ''),
 t as (select *, row_number() over (partition by query_id, left(text, 50) order by pos) as n from f where pos < 15),
 c as (select *, row_number() over (partition by query_id order by pos) as citation from t where n = 1)
 select query_id, citation, cast(doc_id as varchar) as doc_id, 'index' as source, left(text, 200) as text, score from c where citation <= 10"""


@query(_FLAG)
def flagship_cited_evidence(spark, d):
    corpus, asked = _corpus(spark, d), _asked(spark, d)
    top = written(retrieval.bm25_top_k(corpus, asked, 20), "top")  # of a known size, so that Spark may send it to the texts
    hits = written(top.join(corpus, "id"), "hits").withColumn("angle", F.lit(0)).withColumn("source", F.lit("index"))
    evidence = retrieval.inserted(retrieval.nonempty(hits), ["angle", "rank"])
    return answers.citations(processing.deduplicated(processing.filtered(evidence)))


# Runs of workflows with scripted models, and what is kept of them.

def _scripted(choice: str, draft: str):
    """A model that drafts the same answer for all, and ends items whose number ends in 4."""
    def model(prompt):
        said = F.when(prompt.startswith("Choose which"), F.when(prompt.rlike(r"Question: item \d*4\n"), '["finish"]').otherwise(choice)).otherwise(draft)
        return F.struct(said.alias("text"), F.lit("{}").alias("usage"), F.lit(None).cast("string").alias("error"))

    return model


@query("""select cast(item_id as varchar) as query_id, case when item_id % 10 = 4 then 1 when item_id % 3 < 2 then 1 else 2 end as iteration, case when item_id % 10 <> 4 then 'red cars' end as answer,
 case when item_id % 10 <> 4 and item_id % 3 < 2 then 1.0 else 0.0 end::double as similarity, item_id % 10 <> 4 and item_id % 3 < 2 as success from benchmark""")
def adaptive_results(spark, d):
    """Gold answers that the scripted answer meets, that are empty, and that it does not meet."""
    model = _scripted('REASONING: so\nDECISION: ["answer_drafter", "finish"]', "REASONING: so\nANSWER: red cars")
    n = F.col("item_id") % 3
    samples = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("query"), F.when(n == 0, "red cars").when(n == 1, "").otherwise(F.col("text")).alias("gold_answer"))
    flow = Workflow("chosen", "chosen", [{"type": "answer_drafter"}])
    _, results = runners.adaptive(flow, samples, Services(model=model), model, 2, 0.6)
    return results.select("query_id", F.col("iteration").cast("long").alias("iteration"), "answer", "similarity", "success")


@query("""select cast(item_id as varchar) as query_id, m.model, case when m.model = 'a' then 'item ' || cast(item_id as varchar) end as response, case when m.model = 'b' then 'no answer' end as error from benchmark, (values ('a'), ('b')) m(model)""")
def consultant_answers(spark, d):
    none = F.lit(None).cast("string")
    models = {"a": lambda p: F.struct(F.concat(F.lit(" "), p, F.lit(" ")).alias("text"), none.alias("usage"), none.alias("error")), "b": lambda p: F.struct(none.alias("text"), none.alias("usage"), F.lit("no answer").alias("error"))}
    asked = _read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("query"))
    return workflow.consultants(started(asked), F.col("query"), models)


@query(f"with {_EX} select seed_id, doc, count(distinct query) as frequency, string_agg(distinct query, '|' order by query) as queries from (select seed_id, query, unnest(doc_ids) as doc from explorations) group by all")
def documents_by_seed(spark, d):
    return coverage.documents_by_seed(_explorations(spark, d)).select("seed_id", "doc", "frequency", F.array_join("queries_found_in", "|").alias("queries"))


@query(f"with {_ST}, t as (select distinct run_id, case run_id % 3 when 0 then 'small' when 1 then 'large' end as teacher_model from steps where run_id % 3 < 2) select run_id, seq, teacher_model from steps left join t using (run_id)")
def run_teachers(spark, d):
    steps = _steps(spark, d)
    models = steps.where("run_id % 3 < 2").select("run_id", F.when(F.col("run_id") % 3 == 0, "small").otherwise("large").alias("teacher_model"))
    return traces.with_teacher(steps, models).select("run_id", "seq", "teacher_model")


@query(f"""with {_ST}, c as (select run_id, min_by(named_corpus, seq) filter (component in ('opensearch_retriever', 'vector_retriever', 'chatnoir_retriever') and named_corpus is not null) as named from steps group by 1)
 select run_id, 'teacher' as teacher_id, 'planner,answer_drafter' as blocks, 0.6::double as threshold, 4 as max_iterations, case when named is not null then 'chatnoir' else 'opensearch' end as search_endpoint, coalesce(named, 'wiki') as search_index from c""")
def run_settings(spark, d):
    steps = _steps(spark, d)
    runs = steps.select("run_id").distinct().select("run_id", F.lit("teacher").alias("teacher_id"), F.lit("q").alias("query"), F.lit(None).cast("string").alias("expected_answer"))
    held = traces.run_settings(steps, runs, ["planner", "answer_drafter"], 0.6, 4, "opensearch", "wiki")
    return held.select("run_id", "teacher_id", F.array_join("workflow_config.blocks.type", ",").alias("blocks"), F.col("workflow_config.answer_match_threshold").alias("threshold"), F.col("workflow_config.max_iterations").alias("max_iterations"), "search_endpoint", "search_index")


# Indexes that outlive a call.

def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query()
def knn_ann_topk(spark, d):
    """As ``knn_cosine_topk``, by an approximate index over all vectors: 100 candidates for each query, ranked exactly."""
    vectors = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = vector_index.built(vectors, _place(spark, "vectors"))
    probes = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return vector_index.ann_top_k(spark, index, probes, 25, 100).withColumn("rank", F.col("rank").cast("long"))


@query(f"""with {_Q}, docs as (select 'title' as field, 3.0::double as w, doc_id, {_TOK.format("split_part(text, chr(10), 1)")} as words from documents where text is not null union all select 'text', 1.0, doc_id, {_TOK.format('text')} from documents where text is not null),
 n as (select field, w, count(*) as n, avg(len(words)) as mean from docs group by all), terms as (select distinct query_id, unnest({_TOK.format('query')}) as term from asked),
 hits as (select field, doc_id, dl, term, count(*) as tf from (select field, doc_id, len(words) as dl, unnest(words) as term from docs) where term in (select term from terms) group by all), df as (select field, term, count(*) as df from hits group by all),
 scored as (select query_id, field, doc_id, round(any_value(w) * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 4) as score from terms join hits using (term) join df using (field, term) join n using (field) group by query_id, field, doc_id),
 best as (select query_id, doc_id, max(score) as score from scored group by all), ranked as (select *, row_number() over (partition by query_id order by score desc, cast(doc_id as varchar)) as rank from best)
 select query_id, rank, cast(doc_id as varchar) as id, score from ranked where rank <= 20""")
def bm25_multi_field(spark, d):
    """Best of two fields over an index that is made by two appends; the search reads no text."""
    docs = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.substring_index("text", "\n", 1).alias("title"), "text")
    index = text_index.opened(spark, _place(spark, "postings"), f"postings_{uuid.uuid4().hex}", ("title", "text"), 16)
    for n, batch in enumerate(("even", "odd")):
        text_index.appended(index, docs.where(F.pmod("doc_id", F.lit(2)) == n), batch)
    return text_index.top_k(spark, index, _asked(spark, d), 20, {"title": 3.0, "text": 1.0}).withColumn("rank", F.col("rank").cast("long"))


_NEAREST = "select vec_id, x, arg_min(cluster, (far, cluster)) as cluster from (select vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as far from v, {centres}) group by all"
_MOVED = "select cluster, list(m order by i) as c from (select cluster, i, avg(x[i]) as m from {rows}, range(1, 65) r(i) group by all) group by cluster"


@query(f"""with v as (select vec_id, embedding::double[] as x from embeddings), c0 as (select vec_id as cluster, x as c from v where vec_id < 10), a0 as materialized ({_NEAREST.format(centres='c0')}), c1 as materialized ({_MOVED.format(rows='a0')}),
 a1 as materialized ({_NEAREST.format(centres='c1')}), c2 as materialized ({_MOVED.format(rows='a1')}), a2 as ({_NEAREST.format(centres='c2')}) select vec_id, cluster::integer as cluster from a2""")
def kmeans_lloyd(spark, d):
    """Two rounds from given centres, the first ten vectors."""
    v = _read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    first = [r["vector"] for r in v.where("vec_id < 10").orderBy("vec_id").collect()]  # ten rows
    centres, _ = clusters.fitted(v, len(first), rounds=2, tolerance=0.0, centres=np.array(first, float))
    return clusters.assigned(v, centres).select("vec_id", "cluster")


# Streams that stop and go on.

_STAGES = 3


def _stages(rows: DataFrame, name: str):
    """A folder that gets the rows by seq, a part at a time: after each part the caller runs its stream."""
    spark, into = rows.sparkSession, _place(rows.sparkSession, name)
    last = rows.agg(F.max("seq")).first()[0] or 0
    for n in range(_STAGES):
        rows.where((F.floor(F.col("seq") * _STAGES / (last + 1))) == n).write.mode("append").parquet(into)
        yield spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(into)


@query("""with r as (select conv_id as run_id, role, length(text) as n, row_number() over (partition by conv_id order by turn desc) as back from conversations)
 select run_id, count(*) as steps, sum(n)::double as total_ms, string_agg(distinct role, ',' order by role) as tools, string_agg(role, ',' order by back desc) filter (back <= 5) as latest from r group by run_id""")
def stream_history(spark, d):
    """Histories of conversations after three micro-batches, between which the query stops; its state is all that it remembers."""
    base = _place(spark, "history")
    rows = _read(spark, d, "conversations").select(
        F.col("conv_id").cast("long").alias("run_id"), F.col("turn").cast("long").alias("seq"), F.timestamp_seconds("turn").alias("ts"), F.col("role").alias("component"), F.length("text").cast("double").alias("execution_time_ms"))
    for stream in _stages(rows, "steps"):
        with streams.with_rocksdb(spark):
            streams.committed(streams.running_history(stream), base, f"{base}/log", "update").awaitTermination()
    rows = streams.committed_rows(spark, base, spark.createDataFrame([], streams.HISTORY).schema)
    last = rows.groupBy("run_id").agg(F.max_by(F.struct("steps", "total_ms", "tools", "latest"), "batch").alias("h"))
    return last.select("run_id", "h.steps", "h.total_ms", F.array_join("h.tools", ",").alias("tools"), F.array_join("h.latest", ",").alias("latest"))


@query("select doc_id, lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by all")
def stream_resume(spark, d):
    """How often each document is there after a query has stopped twice and gone on."""
    base = _place(spark, "resumed")
    rows = _read(spark, d, "documents").select(F.col("doc_id").alias("seq"), "lang", "n_chars")
    for stream in _stages(rows, "arrived"):
        streams.committed(stream, base, f"{base}/log").awaitTermination()
    rows = streams.committed_rows(spark, base, rows.schema)
    return rows.groupBy(F.col("seq").alias("doc_id"), "lang").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"))


# Sources and table functions.

@query("select lang as dataset, source as run_id, cast(doc_id as varchar) as sample_id, md5(text) as digest from documents where lang in ('en', 'de') and source <> 'src1'")
def corpus_scan(spark, d):
    """A corpus of compressed JSON lines by the registered source, which reads the files of two data sets alone."""
    datasource.register(spark)
    path = _place(spark, "corpus")
    origin = F.struct(F.col("lang").alias("dataset"), F.col("source").alias("run_id"), F.col("doc_id").cast("string").alias("sample_id"))
    lines = _read(spark, d, "documents").select("text", origin.alias("_source"), F.col("lang").alias("dataset"))
    lines.write.partitionBy("dataset").option("compression", "gzip").json(path)
    rows = spark.read.format("trace_corpus").load(path).where(F.col("dataset").isin("en", "de") & (F.col("run_id") != "src1"))
    return rows.select("dataset", "run_id", "sample_id", F.md5(F.get_json_object("record", "$.text")).alias("digest"))


_GOALS = _RESP + f""", body as (select doc_id, case when contains(response, 'SUB-GOALS:') then split_part(response, 'SUB-GOALS:', 2) else response end as b from responses),
 l as (select doc_id, list_filter(list_transform(list_filter(list_transform(string_split(b, chr(10)), lambda s: {_WS.format('s')}), lambda s: regexp_matches(s, '^[0-9•-]')), lambda s: {_WS.format("regexp_replace(s, '^[0-9.•)-]+', '')")}), lambda s: length(s) > 5)[1:3] as g from body)"""


@query(f"with {_GOALS} select doc_id, unnest(range(1, len(g) + 1))::integer as place, unnest(g) as goal from l")
def subgoals_udtf(spark, d):
    """The goals of ``parse_subgoals`` by a table function in a lateral join."""
    table_functions.register(spark)
    return spark.sql("select r.doc_id, g.place, g.goal from {r} r, lateral planned_goals(r.response, 3) g", r=_responses(spark, d).select("doc_id", "response"))


@query(f"""with g as (select conv_id, turn, place, goal from (select conv_id, turn, unnest(range(1, len(g) + 1)) as place, unnest(g) as goal from (select conv_id, turn,
 list_filter(list_transform(list_filter(list_transform(string_split('- ' || role || ' speaks' || chr(10) || '2. ' || text, chr(10)), lambda s: {_WS.format('s')}), lambda s: regexp_matches(s, '^[0-9•-]')), lambda s: {_WS.format("regexp_replace(s, '^[0-9.•)-]+', '')")}), lambda s: length(s) > 5)[1:4] as g from conversations))),
 f as (select conv_id, goal, min((turn, place)) as spot from g group by all) select conv_id, number::integer as number, goal from (select conv_id, goal, row_number() over (partition by conv_id order by spot) as number from f) where number <= 4""")
def goals_by_key(spark, d):
    """The first four distinct goals of a conversation, by a table function that asks for its rows in order."""
    table_functions.register(spark)
    said = F.concat(F.lit("- "), "role", F.lit(" speaks\n2. "), "text")
    rows = _read(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("place"), said.alias("response"))
    return spark.sql("select key as conv_id, number, goal from goals_by_key(table({r}), 4)", r=rows)


@query(f"""select cast(doc_id as varchar) as file, {_WS.format(_BODY)} as query from documents where doc_id % 4 = 0 and {_WS.format(_BODY)} <> '' union all select cast(doc_id as varchar), 't' from documents where doc_id % 4 = 0 and {_WS.format(_BODY)} = ''
 union all select cast(doc_id as varchar), unnest([lang, source]) from documents where doc_id % 4 <> 0""")
def candidate_variant(spark, d):
    """Candidate queries of every shape, mixed in one table, in one pass."""
    n, body = F.col("doc_id") % 4, F.regexp_replace("text", r'["\\\s]+', " ")
    line = F.concat(F.lit('{"query": " '), body, F.lit(' ", "text": "t"}'))
    named = F.concat(F.lit('{"query": {"1": " '), "lang", F.lit('", "2": "'), "source", F.lit('", "3": "", "4": 5}}'))
    keyed = F.concat(F.lit('{"'), "lang", F.lit(' ": "1", "'), "source", F.lit('": "2"}'))
    listed = F.concat(F.lit('[{"query": "", "question": "'), "lang", F.lit('"}, {"text": " '), "source", F.lit('"}, {"x": "y"}, 7]'))
    document = F.when(n == 0, line).when(n == 1, named).when(n == 2, keyed).otherwise(listed)
    rows = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), document.alias("document"), (n == 0).alias("line"))
    return readers.from_variants(rows).select("file", "query")


@query("select cast(doc_id as varchar) as uid, row_number() over (order by doc_id) as sample_no, md5(text) as digest from documents")
def dataset_scan(spark, d):
    """A data set of JSON lines, written in order of id, with the numbers that its lines have over all files."""
    path = _place(spark, "dataset")
    rows = _read(spark, d, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.select(F.col("text").alias("query"), F.col("doc_id").cast("string").alias("uid")).write.json(path)
    return readers.qa_dataset(spark, path).select("uid", "sample_no", F.md5("query").alias("digest"))


@query("select distinct cast(doc_id // 2 as varchar) as doc_id from documents where doc_id % 5 <> 0")
def prior_scan(spark, d):
    """Known documents of a file with repeats and lines that are no objects."""
    path = _place(spark, "prior")
    line = F.when(F.col("doc_id") % 5 == 0, "not json").otherwise(F.concat(F.lit('{"doc_id": "'), F.floor(F.col("doc_id") / 2).cast("string"), F.lit('"}')))
    _read(spark, d, "documents").select(line.alias("value")).write.text(path)
    return readers.prior_documents(spark, path)


# Samples and sketches.

@query("""with c as (select lang, count(*) as n from documents group by 1), q as (select lang, n, total // 10 as size, (total // 10 * n) // total as whole, (total // 10 * n) % total as rest from c, (select sum(n)::bigint as total from c)),
 r as (select lang, whole + case when row_number() over (order by rest desc, lang) <= (select max(size) - sum(whole) from q) then 1 else 0 end as quota from q),
 p as (select doc_id, lang, row_number() over (partition by lang order by md5('42:' || cast(doc_id as varchar))) as place from documents) select doc_id, lang from p join r using (lang) where place <= quota""")
def sample_stratified(spark, d):
    """A tenth of the documents, each language's share exactly."""
    docs = _read(spark, d, "documents").select("doc_id", "lang")
    return samples.stratified(docs, "doc_id", "lang", docs.count() // 10)


@query("select doc_id, source from documents order by md5('7:' || cast(doc_id as varchar)) limit (select count(*) // 20 from documents)")
def sample_random(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "source")
    return samples.drawn(docs, "doc_id", docs.count() // 20, 7)


@query("""with found as (select lang || ':' || source as part, n_chars // 100 as step, doc_id // 3 as doc from documents), f as (select part, step, count(*) as fresh from (select part, doc, min(step) as step from found group by all) group by all), s as (select distinct part, step from found)
 select part, step, coalesce(fresh, 0) as fresh, sum(coalesce(fresh, 0)) over (partition by part order by step)::bigint as unique_docs from s left join f using (part, step)""")
def coverage_bitmaps(spark, d):
    """Documents (three ids are one) that each step of a language's source brings, and all met so far, by merged bitmaps."""
    part, step = F.concat_ws(":", "lang", "source").alias("part"), F.floor(F.col("n_chars") / 100).alias("step")
    found = _read(spark, d, "documents").select(part, step, F.floor(F.col("doc_id") / 3).alias("doc"))
    rows = coverage.unique_so_far(coverage.documents_as_bitmaps(found, ["part", "step"]), "part", "step")
    return rows.withColumnRenamed("unique", "unique_docs")


@query()
def unique_documents_sketch(spark, d):
    """About how many distinct beginnings texts of a language and size have, from a sketch for each source."""
    size = F.floor(F.col("n_chars") / 200).alias("size")
    found = _read(spark, d, "documents").select("lang", size, "source", F.substring("text", 1, 40).alias("doc"))
    return coverage.unique_by_sketch(coverage.document_sketches(found, ["lang", "size", "source"], bits=10), ["lang", "size"])


@query(f"""select a.vec_id, case when trim(lang) = '' or a.vec_id % 5 = 0 then 0.0 else round({_DOT.format(a='a.embedding', b='b.embedding')} / ({_NORM.format(a='a.embedding')} * {_NORM.format(a='b.embedding')}), 6) end as similarity
 from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 join documents on doc_id = a.vec_id""")
def exploratory_similarity(spark, d):
    e = _read(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    rows = a.join(b, F.expr("b = a + 1")).join(_read(spark, d, "documents").select("doc_id", "lang"), F.expr("doc_id = a"))
    external = F.when(F.col("a") % 5 == 0, " ").otherwise("an answer")
    return rows.select(F.col("a").alias("vec_id"), F.round(S.exploratory_similarity(F.col("lang"), external, F.col("x"), F.col("y")), 6).alias("similarity"))


@query(f"""with {_EV}, {_Q}, s as (select query_id, id, pos, list_distinct({_TOK.format('query')}) as x, list_distinct({_TOK.format('left(text, 512)')}) as y from evidence join asked using (query_id)),
 r as (select query_id, id, pos, round(case when len(x) = 0 or len(y) = 0 then 0.0 else len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) end, 4) as rerank_score from s)
 select query_id, id, rerank_score, p as pos from (select *, row_number() over (partition by query_id order by rerank_score desc, pos) - 1 as p from r) where p < 20""")
def rerank_cross_encoder(spark, d):
    """A model of query and text as a column: here the overlap of their tokens."""
    top = processing.reranked(_evidence(spark, d), _asked(spark, d), "cross_encoder", cross_encoder=S.token_overlap)
    return top.select("query_id", "id", "rerank_score", F.col("pos").cast("long").alias("pos"))
