"""Readers. All give explicit schemas, so that no pass over the data infers one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import stripped
from ..operators import samples

QA = "query string, question string, answer string, gold_answer string, seed_id string, uid string"
STEP = "run_id string, seq long, turn int, component string, thought string, parameters string, tool_input string, tool_output string, verdict string, rationale_tag string, stop_condition string, llm_input string, llm_output string, execution_time_ms double, tokens long, evidence_count long, error string"
_KEYS = ("query", "question", "text")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the non-blank lines of text files, compressed or not."""
    read = _placed(spark.read.option("recursiveFileLookup", "true").text(path))
    return read.select(F.col("_file").alias("file"), F.col("value").alias("line"), "_at", "_line").where(F.length(stripped(F.col("line"))) > 0)


#: Columns that put the lines of files in order: the file, the stretch of it that a task reads, and the line's place in that.
_ORDER = ("_file", "_at", "_line")


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})


def _records(spark: SparkSession, path: str, schema: str, placed: bool = False) -> DataFrame:
    """The lines that are JSON objects, by an explicit schema; ``placed`` adds the columns of ``_ORDER``."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull())
    lines = _placed(lines) if placed else lines
    return lines.select(F.from_json("value", schema).alias("r"), *(_ORDER if placed else ())).select("r.*", *(_ORDER if placed else ()))


def qa_dataset(spark: SparkSession, path: str, num_samples: int = 0, strategy: str = "head", seed: int = 42, strata: str | None = None) -> DataFrame:
    """Samples of JSON-lines files: the first ``num_samples`` in the order of files and lines (0 or less: all), random ones, or each stratum's share.

    Lines that are no JSON object are left out. Adds ``sample_no`` from 1, in
    that order and without gaps: lines are numbered within the stretch that a
    task reads, and stretches by the lines before them.
    """
    rows = _records(spark, path, QA, placed=True)
    key = F.concat_ws(":", *_ORDER)
    if num_samples > 0 and strategy == "random":
        rows = samples.drawn(rows.withColumn("_key", key), "_key", num_samples, seed).drop("_key")
    elif num_samples > 0 and strategy == "stratified":
        rows = samples.stratified(rows.withColumn("_key", key), "_key", strata, num_samples, seed).drop("_key")
    elif num_samples > 0:
        rows = rows.orderBy(*_ORDER).limit(num_samples)
    sizes = rows.groupBy(F.col("_file").alias("f"), F.col("_at").alias("a")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sizes.select("f", "a", before.alias("before")), F.expr("_file = f and _at = a"))
    number = F.row_number().over(Window.partitionBy("_file", "_at").orderBy("_line")) + F.col("before")
    return rows.withColumn("sample_no", number.cast("long")).drop(*_ORDER, "f", "a", "before")


def first_key(record: Column, keys: tuple[str, ...] = _KEYS) -> Column:
    """The first of the keys whose value is not empty, stripped; null if all are."""
    return F.coalesce(*(F.nullif(stripped(F.get_json_object(record, f"$.{k}")), F.lit("")) for k in keys))


def from_json_lines(lines: DataFrame) -> DataFrame:
    """(file, query) from lines with a JSON object each; other lines are left out."""
    return lines.select("file", first_key(F.col("line")).alias("query"), *(c for c in lines.columns if c.startswith("_"))).where("query is not null")


def from_id_map(documents: DataFrame) -> DataFrame:
    """(file, query) from objects {"query": {id: text}}: the texts."""
    texts = F.map_values(F.from_json(F.get_json_object("document", "$.query"), "map<string,string>"))
    return documents.select("file", F.explode(texts).alias("query")).withColumn("query", stripped(F.col("query"))).where("query <> ''")


def from_keys(documents: DataFrame) -> DataFrame:
    """(file, query) from other objects: their keys."""
    keys = F.map_keys(F.from_json("document", "map<string,string>"))
    return documents.select("file", F.explode(keys).alias("query")).withColumn("query", stripped(F.col("query"))).where("query <> ''")


def from_records(documents: DataFrame) -> DataFrame:
    """(file, query) from arrays of objects, by the same keys as lines."""
    records = F.from_json("document", "array<map<string,string>>")
    found = F.coalesce(*(F.nullif(stripped(F.try_element_at(F.col("record"), F.lit(k))), F.lit("")) for k in _KEYS))
    return documents.select("file", F.explode(records).alias("record")).select("file", found.alias("query")).where("query is not null")


def from_variants(documents: DataFrame) -> DataFrame:
    """(file, place, query) from JSON texts of every shape, in one pass: documents has file, document and, for texts that are lines of a file, line (true).

    A line is an object with a query by the usual keys, an array holds such objects, {"query": {id: text}} gives its texts and
    another object its keys. What doesn't parse, and values that are no strings, give nothing.
    """
    def text(of: str, path: str) -> Column:
        found = f"try_variant_get({of}, '{path}', 'variant')"
        return F.when(F.expr(f"schema_of_variant({found}) = 'STRING'"), F.nullif(stripped(F.expr(f"try_variant_get({of}, '{path}', 'string')")), F.lit("")))

    whole = F.when(F.col("line"), F.concat(F.lit("["), "document", F.lit("]"))).otherwise(F.col("document"))
    parsed = documents.select("file", F.try_parse_json(whole).alias("v")).where(F.col("v").isNotNull())
    kind = F.when(F.expr("schema_of_variant(v) like 'ARRAY%'"), "records").when(F.expr("schema_of_variant(try_variant_get(v, '$.query', 'variant')) like 'OBJECT%'"), "map").when(F.expr("schema_of_variant(v) like 'OBJECT%'"), "keys")
    shaped = parsed.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn("held", F.when(F.col("kind") == "map", F.expr("try_variant_get(v, '$.query', 'variant')")).otherwise(F.col("v")))
    each = shaped.lateralJoin(shaped.sparkSession.tvf.variant_explode(F.col("held").outer())).select("file", "kind", "pos", "key", "value")
    record = F.coalesce(*(text("value", f"$.{k}") for k in _KEYS))
    query = F.when(F.col("kind") == "records", record).when(F.col("kind") == "map", text("value", "$")).otherwise(F.nullif(stripped(F.col("key")), F.lit("")))
    return each.select("file", F.col("pos").alias("place"), query.alias("query")).where("query is not null")


def candidates(spark: SparkSession, path: str, split: str, most: int = 50_000) -> DataFrame:
    """(file, query): candidate queries of the files below ``path`` whose name has ``split`` in it.

    JSON-lines files come before JSON documents, files by name and lines by
    place; ``most`` cuts in that order (0 or less: all). A JSON document that
    does not parse as a whole is read by line.
    """
    named = F.lower(F.element_at(F.split("file", "/"), -1)).contains(split.lower())
    lines = _lines(spark, path).where(named)
    out = from_json_lines(lines.where(F.col("file").rlike(r"(?i)\.jsonl(\.gz)?$"))).withColumn("kind", F.lit(0))
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), stripped(F.col("value")).alias("document")).where(named & F.col("file").rlike(r"(?i)\.json$"))
    parsed = F.try_parse_json(F.concat(F.lit("["), "document", F.lit("]"))).isNotNull()  # one value, not several in a row
    listed, of_map = F.col("document").startswith("["), F.get_json_object("document", "$.query").startswith("{")
    valid = whole.where(parsed)
    broken = whole.where(~parsed).select("file", F.explode(F.split("document", "\n")).alias("line"))
    plain = valid.where(~listed & ~F.coalesce(of_map, F.lit(False)))
    for part in (from_records(valid.where(listed)), from_id_map(valid.where(~listed & of_map)), from_keys(plain), from_json_lines(broken)):
        # A document is read whole by one task, so its entries come in their order.
        out = out.unionByName(part.withColumns({"kind": F.lit(1), "_at": F.lit(0).cast("long"), "_line": F.monotonically_increasing_id()}))
    return (out.orderBy("kind", "file", "_at", "_line").limit(most) if most > 0 else out).select("file", "query")


def prior_documents(spark: SparkSession, path: str | None) -> DataFrame:
    """(doc_id): distinct ids of a JSON-lines file; lines that don't parse are left out, and no path is no rows."""
    if path is None:
        return spark.createDataFrame([], "doc_id string")
    return _records(spark, path, "doc_id string").where("doc_id is not null").distinct()


def corpus(spark: SparkSession, path: str, datasets: tuple[str, ...] = (), runs: tuple[str, ...] = ()) -> DataFrame:
    """A published corpus of (compressed) JSON lines with _source{run_id, dataset, sample_id}, by dataset and run."""
    rows = _records(spark, path, f"{STEP}, input string, output string, tool string, decision_label string, latency_ms double, _source struct<run_id:string,dataset:string,sample_id:string>")
    if datasets:
        rows = rows.where(F.col("_source.dataset").isin(*datasets))
    return rows.where(F.col("_source.run_id").isin(*runs)) if runs else rows


def search_base_url(host: str, default_port: int = 9200) -> str:
    """scheme://host:port of a search host that may lack scheme and port."""
    parts = urlparse(host if "://" in host else f"http://{host}")
    return f"{parts.scheme}://{parts.hostname}:{parts.port or (443 if parts.scheme == 'https' else default_port)}"


def external_search(queries: DataFrame, search: Callable[[str, int], list[dict]], k: int = 30, parallel: int = 4) -> DataFrame:
    """(query_id, rank, id, text, title, score) from a search service.

    ``search(query, k)`` is called on the executors, by at most ``parallel``
    tasks at a time, so that a service's rate limit can be kept. Hits without
    an id are left out; a failed search gives none.
    """
    schema = "query_id string, rank int, id string, text string, title string, score double"

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for query_id, query in zip(frame["query_id"], frame["query"], strict=True):
                try:
                    hits = search(query, k)
                except OSError:
                    hits = []
                kept = [h for h in hits if str(h.get("id") or "").strip()]
                rows += [(query_id, i, h["id"], h.get("text"), h.get("title"), h.get("score")) for i, h in enumerate(kept, 1)]
            yield pd.DataFrame(rows, columns=["query_id", "rank", "id", "text", "title", "score"])

    return queries.select(F.col("query_id").cast("string"), "query").coalesce(parallel).mapInPandas(ask, schema)


def discovered_models(responses: DataFrame) -> DataFrame:
    """(endpoint, model, size_gb) from the JSON that model servers list theirs with; what does not parse gives none."""
    lists = F.coalesce(*(F.from_json(F.get_json_object("body", f"$.{k}"), "array<struct<id:string,name:string,size:long>>") for k in ("data", "models")))
    rows = responses.select("endpoint", F.explode(lists).alias("m"))
    return rows.select("endpoint", F.coalesce("m.id", "m.name").alias("model"), F.format_number(F.col("m.size") / (1 << 30), 2).alias("size_gb")).where("model is not null")


def model_table(models: DataFrame) -> DataFrame:
    """(line): the discovered models as a table of text, by endpoint and model."""
    size = F.coalesce(F.concat("size_gb", F.lit(" GB")), F.lit("-"))
    return models.orderBy("endpoint", "model").select(F.concat(F.rpad("endpoint", 40, " "), F.rpad("model", 40, " "), size).alias("line"))
