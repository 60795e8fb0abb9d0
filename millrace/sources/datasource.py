"""Python data sources: a published corpus of traces, in batches and as a stream, and a search service.

``register`` makes them known to a session by name: ``spark.read.format("trace_corpus").load(path)`` and
``spark.read.format("search_service")``.
"""

from __future__ import annotations

import gzip
import io
import json
import os
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

CORPUS = "dataset string, run_id string, sample_id string, record string"
HITS = "query_id string, rank int, doc_id string, title string, snippet string, score double"
#: Bytes of a file that a task reads (a compressed file is read by one task, as a stream), and of the lines of a batch.
SPLIT, BATCH = 64 << 20, 1 << 20
#: Columns whose filters are applied where files are read.
PUSHED = ("dataset", "run_id")


def register(spark: SparkSession) -> None:
    """Registers both sources and lets Spark hand them filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TraceCorpus, SearchService):
        spark.dataSource.register(source)


def _files(path: str) -> tuple[pa.fs.FileSystem, list[pa.fs.FileInfo]]:
    files, at = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{os.path.abspath(path)}")
    named = [f for f in files.get_file_info(pa.fs.FileSelector(at, recursive=True)) if f.is_file and not f.base_name.startswith(("_", ".")) and ".json" in f.base_name]
    return files, sorted(named, key=lambda f: f.path)


@dataclass
class Split(InputPartition):
    """A stretch of a file: the lines that begin in it."""

    path: str
    begin: int
    end: int


@dataclass
class _Reader:
    """What batches and streams have in common: splits of files, and their lines as Arrow batches."""

    path: str

    def splits(self, infos: Iterable[pa.fs.FileInfo]) -> list[Split]:
        out = []
        for f in infos:
            step = f.size if f.base_name.endswith(".gz") else SPLIT
            out += [Split(f.path, at, min(at + step, f.size)) for at in range(0, f.size, max(step, 1))]
        return out

    def lines(self, split: Split) -> Iterator[bytes]:
        files, _ = pa.fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:/") else f"file://{os.path.abspath(self.path)}")
        with files.open_input_file(split.path) as f:
            if split.path.endswith(".gz"):
                yield from gzip.GzipFile(fileobj=f)
                return
            # A line belongs to the split that its first byte lies in.
            f.seek(max(split.begin - 1, 0))
            read = io.BufferedReader(f, 1 << 20)
            at = max(split.begin - 1, 0) + (len(read.readline()) if split.begin else 0)
            while at < split.end:
                line = read.readline()
                if not line:
                    return
                at += len(line)
                yield line

    def batches(self, split: Split, wanted: dict[str, set]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for line in self.lines(split):
            try:
                text = line.decode().strip()
                found = json.loads(text)["_source"]
                row = tuple(found.get(k) for k in ("dataset", "run_id", "sample_id"))
            except (ValueError, KeyError, TypeError, AttributeError):
                continue
            if all(row[i] in wanted[k] for i, k in enumerate(PUSHED) if k in wanted):
                rows.append((*(None if v is None else str(v) for v in row), text))
                held += len(line)
            if held > BATCH:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["dataset", "run_id", "sample_id", "record"])


class CorpusReader(DataSourceReader):
    """Lines of a corpus; filters on dataset and run leave out files by the names of their folders, and lines before they reach Spark."""

    def __init__(self, path: str) -> None:
        self.files, self.wanted = _Reader(path), {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in PUSHED:
                yield f
            else:
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values

    def _may_hold(self, info: pa.fs.FileInfo) -> bool:
        named = dict(part.split("=", 1) for part in info.path.split("/") if "=" in part)
        return all(urllib.parse.unquote(named[k]) in values for k, values in self.wanted.items() if k in named)

    def partitions(self) -> list[Split]:
        return self.files.splits(f for f in _files(self.files.path)[1] if self._may_hold(f)) or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.files.batches(partition, self.wanted) if partition.path else iter(())


class CorpusStream(DataSourceStreamReader):
    """New files of a corpus in the order in which they came; an offset is the time and name of the last file read."""

    def __init__(self, path: str) -> None:
        self.files = _Reader(path)

    def initialOffset(self) -> dict:
        return {"time": 0, "name": ""}

    def _placed(self) -> list[tuple[int, str, pa.fs.FileInfo]]:
        return sorted(((f.mtime_ns, f.path, f) for f in _files(self.files.path)[1]), key=lambda f: f[:2])

    def latestOffset(self) -> dict:
        held = self._placed()
        return {"time": held[-1][0], "name": held[-1][1]} if held else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Split]:
        after, upto = ((o["time"], o["name"]) for o in (start, end))
        return self.files.splits(f for time, name, f in self._placed() if after < (time, name) <= upto)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.files.batches(partition, {})


class TraceCorpus(DataSource):
    """JSON lines, compressed or not, with _source{dataset, run_id, sample_id}; record is the line. Other lines are left out."""

    @classmethod
    def name(cls) -> str:
        return "trace_corpus"

    def schema(self) -> str:
        return CORPUS

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options["path"])

    def streamReader(self, schema) -> CorpusStream:
        return CorpusStream(self.options["path"])


@dataclass
class Asked(InputPartition):
    queries: list


class SearchReader(DataSourceReader):
    """Asks a search service on the executors; some queries are one task's.

    The two styles of the service's callers differ in the key's parameter and in what they drop: ``seed``
    sends ``apikey`` and drops hits without an id, ``component`` sends ``key`` with a bearer header and drops
    hits without a snippet. A failing request fails its task, which Spark repeats.
    """

    def __init__(self, options: dict) -> None:
        self.url, self.index, self.size = options["url"].rstrip("/"), options["index"], int(options.get("size", "30"))
        self.style, self.queries = options.get("style", "component"), json.loads(options["queries"])
        self.parallel, self.key = int(options.get("parallel", "4")), options.get("key_variable", "SEARCH_API_KEY")
        if self.style not in ("seed", "component"):
            raise ValueError(f"unknown style {self.style}")

    def partitions(self) -> list[Asked]:
        parts = max(min(self.parallel, len(self.queries)), 1)
        return [Asked(self.queries[i::parts]) for i in range(parts)]

    def request(self, query: str) -> urllib.request.Request:
        params, headers, key = {"query": query, "index": self.index, "size": self.size}, {}, os.environ.get(self.key)
        if key and self.style == "seed":
            params["apikey"] = key
        elif key:
            params["key"], headers["Authorization"] = key, f"Bearer {key}"
        return urllib.request.Request(f"{self.url}/_search?{urllib.parse.urlencode(params)}", headers=headers)

    def read(self, partition: Asked) -> Iterator[tuple]:
        for query_id, query in partition.queries:
            with urllib.request.urlopen(self.request(query), timeout=60) as reply:
                found = json.load(reply).get("results", [])
            hits = [(h.get("trec_id", h.get("uuid", "")) or "", h.get("title", ""), h.get("snippet", ""), float(h.get("score") or 0.0)) for h in found]
            kept = [h for h in hits if h[0]][: self.size] if self.style == "seed" else [h for h in hits if h[2]]
            yield from ((str(query_id), rank, *hit) for rank, hit in enumerate(kept, 1))


class SearchService(DataSource):
    """Options: url, index, size, style, parallel, key_variable (where the executors' environment has the key) and queries, JSON of pairs (query_id, query)."""

    @classmethod
    def name(cls) -> str:
        return "search_service"

    def schema(self) -> str:
        return HITS

    def reader(self, schema) -> SearchReader:
        return SearchReader(dict(self.options))
