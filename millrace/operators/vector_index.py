"""Approximate vector search: an inverted file of cells with product-quantised residuals.

``built`` fits coarse centres and code books on a bounded sample (``SAMPLE`` rows), but every vector
is indexed: its cell is the nearest centre, and its code names, for each part of
what the centre leaves over, the nearest entry of that part's book. Codes and vectors lie in one
table partitioned by cell, so a search reads the codes of the cells that its probes ask for and the vectors
of candidates' cells alone. How many cells a probe asks for is measured on the sample: the fewest in which
``recall`` of the sample's own nearest neighbours lie.

``ann_top_k`` scores codes by tables of inner products, keeps ``num_candidates`` for each probe and
ranks these by their exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.similarity import dot
from ..sources.shared import shared_folder
from .clusters import distances, matrix, sample, spread_rows
from .retrieval import PLACES, first_k

#: Rows that centres and books are fitted on, those whose hash comes first.
SAMPLE = 16_384
#: Most cells, entries of a book, and vectors of a cell that one task writes.
MOST_CELLS, ENTRIES, TASK_ROWS = 4096, 256, 250_000
#: Bytes of probes, and candidates, that a block may have: both go to every task.
BLOCK_BYTES, BLOCK_CANDIDATES = 32 << 20, 1 << 20


@dataclass(frozen=True)
class VectorIndex:
    """Where the table is, the centres, the books (part, entry, number), the cells that a probe asks for and the type of ids."""

    path: str
    centres: np.ndarray
    books: np.ndarray
    cells_asked: int
    id_type: str

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"id {self.id_type}, vector array<float>, code binary, cell int").parquet(f"{self.path}/cells")


def _lloyd(x: np.ndarray, clusters: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """K-means of a sample, in the driver."""
    centres = spread_rows(x, clusters, rng)
    for _ in range(rounds):
        own = distances(x, centres).argmin(axis=1)
        total = np.zeros(centres.shape)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(count > 0, total / np.maximum(count, 1), centres)
    return centres


def _cells_for(x: np.ndarray, centres: np.ndarray, own: np.ndarray, recall: float, k: int) -> int:
    """The fewest cells, by inner product with the centres, that hold ``recall`` of the nearest ``k`` rows of some rows."""
    asked = x[:: max(len(x) // 128, 1)]
    found = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[found], axis=1).ravel())
    return int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1]) + 1


def _encode(x: np.ndarray, centres: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = distances(x, centres).argmin(axis=1)
    rest = (x - centres[own]).reshape(len(x), len(books), -1)
    return own, np.stack([distances(rest[:, p], books[p]).argmin(axis=1) for p in range(len(books))], axis=1).astype(np.uint8)


def built(vectors: DataFrame, path: str | None = None, cells: int | None = None, parts: int | None = None, recall: float = 0.97, k: int = 25, seed: int = 42) -> VectorIndex:
    """The index of vectors (id, vector of one length), written below ``path``, which defaults to a folder of the shared one.

    cells: by default the root of the number of rows, ``MOST_CELLS`` at most; parts: of a code, a byte each, by default one for two
    numbers. Rows without a vector are left
    out; an empty table gives an index without cells.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("id", "vector").where("vector is not null")
    path = path or f"{shared_folder(spark).rstrip('/')}/vectors-{seed}-{abs(hash(vectors.semanticHash()))}"
    rows, x = vectors.count(), sample(vectors, SAMPLE, seed)
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    parts = next((p for p in range(min(parts or max(dim // 2, 1), dim), 0, -1) if dim % p == 0), 1)
    centres = _lloyd(x, min(cells or max(int(rows**0.5), 1), MOST_CELLS, max(len(x) // 4, 1)), rng) if len(x) else np.zeros((0, dim))
    own = distances(x, centres).argmin(axis=1) if len(x) else np.zeros(0, int)
    rest = (x - centres[own]).reshape(len(x), parts, dim // parts)
    books = [_lloyd(rest[:, p], min(ENTRIES, len(x)), rng) for p in range(parts)] if len(x) else []
    books = np.array([np.vstack((b, np.repeat(b[:1], ENTRIES - len(b), axis=0))) for b in books])  # where rows repeat a book has fewer entries
    asked = _cells_for(x, centres, own, recall, k) if len(x) else 0
    # Salts by the share that a cell has of the sample: no task writes a hot cell alone.
    share = np.bincount(own, minlength=len(centres)) / max(len(x), 1)
    salts = np.maximum(np.ceil(share * rows / TASK_ROWS), 1).astype(np.int64)
    held = spark.sparkContext.broadcast((centres, books, salts))
    kind = vectors.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books, salts = held.value
        for batch in batches:
            if batch.num_rows:
                cell, code = _encode(matrix(batch.column(1)), centres, books)
                salt = batch.column(2).to_numpy().view(np.uint64) % salts[cell].astype(np.uint64)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(cell.astype(np.int32)), pa.array(salt.astype(np.int32))], names=["id", "vector", "code", "cell", "salt"])

    coded = vectors.select("id", F.col("vector").cast("array<float>"), F.xxhash64("id").alias("h")).mapInArrow(encode, f"id {kind}, vector array<float>, code binary, cell int, salt int")
    coded.repartition("cell", "salt").drop("salt").write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(f"{path}/cells")
    model = [("centre", i, c.tolist()) for i, c in enumerate(centres)] + [("book", i, b.ravel().tolist()) for i, b in enumerate(books)] + [("asked", asked, []), (f"id {kind}", 0, [])]
    spark.createDataFrame(model, "kind string, number int, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return VectorIndex(path, centres, books, asked, kind)


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """An index that an earlier session has written."""
    rows = sorted(spark.read.parquet(f"{path}/model").collect(), key=lambda r: (r["kind"], r["number"]))  # cells and books are few
    centres = np.array([r["numbers"] for r in rows if r["kind"] == "centre"])
    books = np.array([np.reshape(r["numbers"], (ENTRIES, -1)) for r in rows if r["kind"] == "book"])
    return VectorIndex(path, centres, books, next(r["number"] for r in rows if r["kind"] == "asked"), next(r["kind"][3:] for r in rows if r["kind"].startswith("id ")))


def _candidates(codes: DataFrame, index: VectorIndex, asked: np.ndarray, cells: np.ndarray, most: int) -> DataFrame:
    """(q, cell, id, score): of each batch the best ``most`` for each probe, by codes."""
    by_cell = {int(c): np.flatnonzero((cells == c).any(axis=1)) for c in np.unique(cells)}
    held = codes.sparkSession.sparkContext.broadcast((index.centres, index.books, asked, by_cell))
    kind = codes.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books, asked, by_cell = held.value
        width = asked.shape[1] // len(books)
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, len(books))
            number = batch.column(2).to_numpy()
            for cell in np.unique(number).tolist():
                rows = np.flatnonzero(number == cell)
                for some in np.array_split(by_cell.get(cell, np.zeros(0, int)), max(len(by_cell.get(cell, ())) // 128, 1)):
                    if not len(some):
                        continue
                    table = np.einsum("qpw,pew->qpe", asked[some].reshape(len(some), len(books), width), books)
                    score = (asked[some] @ centres[cell])[:, None] + sum(table[:, p][:, code[rows, p]] for p in range(len(books)))
                    best = np.argpartition(-score, most - 1, axis=1)[:, :most] if len(rows) > most else np.tile(np.arange(len(rows)), (len(some), 1))
                    flat = rows[best.ravel()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(some, best.shape[1]).astype(np.int32)), pa.array(np.full(len(flat), cell, np.int32)), batch.column(0).take(pa.array(flat)), pa.array(np.take_along_axis(score, best, axis=1).ravel())], names=["q", "cell", "id", "score"]
                    )

    return codes.mapInArrow(scan, f"q int, cell int, id {kind}, score double")


def ann_top_k(spark: SparkSession, index: VectorIndex, probes: DataFrame, k: int = 25, num_candidates: int = 100, cells_asked: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the best ``k`` by inner product among each probe's candidates. probes: query_id, vector.

    The probes are a stated query set, taken in blocks by the bytes that they and their candidates have. Candidates
    are the best ``num_candidates`` by codes in the ``cells_asked`` nearest cells; their scores and ranks are exact, ties by
    id. Probes without a vector get no rows.
    """
    table, num = index.table(spark), max(num_candidates, k)
    probes = probes.select("query_id", F.col("vector").cast("array<double>")).where("vector is not null")
    width = max(index.centres.shape[1] if index.centres.ndim == 2 else 1, 1)
    block_rows = max(min(BLOCK_BYTES // (8 * width), BLOCK_CANDIDATES // num), 1)
    blocks = max(-(-2 * probes.count() // block_rows), 1) if probes.limit(block_rows + 1).count() > block_rows else 1
    parts = []
    for b in range(blocks):
        some = (probes if blocks == 1 else probes.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        if not some.num_rows or not len(index.centres):
            continue
        asked = matrix(some.column("vector"))
        near = np.argsort(-(asked @ index.centres.T), axis=1, kind="stable")[:, : cells_asked or index.cells_asked]
        numbered = spark.createDataFrame(some.append_column("q", pa.array(np.arange(some.num_rows, dtype=np.int32))))
        codes = table.where(F.col("cell").isin(np.unique(near).tolist())).select("id", "code", "cell")
        found = first_k(_candidates(codes, index, asked, near, num), ["q"], [F.desc("score"), F.col("id")], num, "place").select("q", "cell", "id")
        # A block's probes and candidates are bounded above, so both may be sent to the tasks that read the vectors.
        exact = table.select("id", "cell", "vector").join(F.broadcast(found), ["cell", "id"]).join(F.broadcast(numbered.withColumnRenamed("vector", "probe")), "q")
        parts.append(exact.select("query_id", "id", F.round(dot(F.col("probe"), F.col("vector")), PLACES).alias("score")))
    if not parts:
        kinds = [probes.schema["query_id"].dataType.simpleString(), table.schema["id"].dataType.simpleString()]
        return spark.createDataFrame([], f"query_id {kinds[0]}, rank int, id {kinds[1]}, score double")
    return first_k(reduce(DataFrame.unionByName, parts), ["query_id"], [F.desc("score"), F.col("id")], k).select("query_id", "rank", "id", "score")
