"""The best rows for each of a block of queries, part by part of a table, in numpy arrays inside tasks.

A task keeps the ``k`` best scores of each query that it has met, and gives a row to Spark only where it may be
among them. So neither pairs of query and row nor their sums are exchanged, sorted or held: what is moved is
a few rows for each query and task. The parts that a task works on have at most ``CELLS`` scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: BM25's constants.
K1, B = 1.2, 0.75
#: Decimal places to which scores are rounded before they are ranked, so that summation order decides no tie.
PLACES = 4
#: Scores of a part, and terms of queries that a part's rows have.
CELLS = 1 << 20
#: Best scores, and terms, of a block of queries: every task gets them.
BLOCK_SCORES, BLOCK_TERMS = 1 << 20, 1 << 20


def blocks_of(queries: int, terms: int, k: int) -> int:
    """In how many blocks queries with so many terms in all are taken."""
    return max(-(-queries * k // BLOCK_SCORES), -(-terms // BLOCK_TERMS), -(-queries // CELLS), 1)


def rounded(scores: np.ndarray) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    return np.copysign(np.floor(np.abs(scores) * 10**PLACES + 0.5), scores) / 10**PLACES


def places(ids: pa.Array) -> np.ndarray:
    """The place of each row in order of ids, nulls first."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return out


def cuts(sizes: np.ndarray, queries: int) -> Iterator[tuple[int, int]]:
    """Begin and end of parts with at most ``CELLS`` scores, and ``CELLS`` terms by ``sizes``; a single row may have more."""
    upto, at, most = np.append(0, np.cumsum(sizes)), 0, max(CELLS // max(queries, 1), 1)
    while at < len(sizes):
        end = min(at + most, max(int(np.searchsorted(upto, upto[at] + CELLS, side="right")) - 1, at + 1))
        yield at, end
        at = end


class Best:
    """The ``k`` best scores of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.held = k, np.full((queries, k), -np.inf)

    def add(self, scores: np.ndarray, place: np.ndarray, found: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and rounded score of what may be among the first ``k``; scores, and which of them count, are by query and row. Of equal scores the lowest places count, and NaN is the highest."""
        if not self.k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        high = ~(scores < self.held.min(axis=1)[:, None] - 10.0**-PLACES)
        query, row = np.nonzero(high if found is None else high & found)
        value = rounded(scores[query, row])
        ranked = np.where(np.isnan(value), np.inf, value)
        order = np.lexsort((place[row], -ranked, query))
        query, row, value, ranked = query[order], row[order], value[order], ranked[order]
        nth = np.arange(len(query)) - np.searchsorted(query, np.arange(len(self.held)))[query]
        kept = nth < self.k
        query, row, value, ranked, nth = query[kept], row[kept], value[kept], ranked[kept], nth[kept]
        some, own = np.unique(query, return_inverse=True)
        fresh = np.full((len(some), self.k), -np.inf)
        fresh[own, nth] = ranked
        self.held[some] = np.partition(np.concatenate((self.held[some], fresh), axis=1), self.k, axis=1)[:, self.k :]
        return query, row, value


def lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists and where each list begins; null lists are empty."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.append(0, np.cumsum(sizes, dtype=np.int64))


@dataclass(frozen=True)
class Asked:
    """A block of queries: their key columns, and by code of a term who asks for it, how often, its idf and the mean length; scale: of each query's score."""

    keys: pa.Table
    heads: np.ndarray
    query: np.ndarray
    times: np.ndarray
    idf: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, keys: pa.Table, query: np.ndarray, code: np.ndarray, idf: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Asked:
        """From the pairs of query and code, repeats included."""
        pair, times = np.unique(code.astype(np.int64) * max(keys.num_rows, 1) + query, return_counts=True)
        code, query = np.divmod(pair, max(keys.num_rows, 1))
        return cls(keys, np.searchsorted(code, np.arange(len(idf) + 1)), query, times.astype(float), idf, mean, scale)

    def scores(self, row: np.ndarray, code: np.ndarray, tf: np.ndarray, dl: np.ndarray, rows: int) -> np.ndarray:
        """BM25 of each query and row, from the terms that rows have; 0 where they share none."""
        part = self.idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.mean[code]))
        asks = np.diff(self.heads)[code]
        at = np.arange(int(asks.sum())) - np.repeat(np.cumsum(asks) - asks - self.heads[code], asks)
        cell = self.query[at] * rows + np.repeat(row, asks)
        return np.bincount(cell, np.repeat(part, asks) * self.times[at], self.keys.num_rows * rows).reshape(-1, rows)


def bm25_best(postings: DataFrame, asked: Asked, k: int) -> DataFrame:
    """(the keys, id, score) of what may be among the best ``k`` of each query. postings: id, codes, tfs, dls, a row for each document."""
    held = postings.sparkSession.sparkContext.broadcast(asked)
    kinds = postings.sparkSession.createDataFrame(asked.keys.slice(0, 0)).schema
    kinds = kinds.add(postings.schema["id"]).add("score", "double")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        queries = asked.keys.num_rows
        best, asks = Best(queries, k), np.diff(asked.heads)
        for batch in batches:
            codes, first = lists(batch.column("codes"))
            code, tf, dl = (x.to_numpy() for x in (codes, batch.column("tfs").flatten(), batch.column("dls").flatten()))
            met = np.append(0, np.cumsum(asks[code]))[first]
            for begin, end in cuts(np.diff(met), queries):
                own = slice(first[begin], first[end])
                row = np.repeat(np.arange(end - begin), np.diff(first[begin : end + 1]))
                score = asked.scores(row, code[own], tf[own], dl[own], end - begin)
                ids = batch.column("id").slice(begin, end - begin)
                query, row, value = best.add(score * asked.scale[:, None], places(ids), score > 0)
                names = [*asked.keys.column_names, "id", "score"]
                columns = [c.combine_chunks() for c in asked.keys.take(pa.array(query)).columns] + [ids.take(pa.array(row)), pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return postings.select("id", "codes", "tfs", "dls").mapInArrow(scan, kinds)


def padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A column of vectors as rows of so many numbers, cut or filled with zeros, and their sizes; -1 for null ones and those with a null."""
    flat, first = lists(column)
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(flat)) - first[row]
    out, own = np.zeros((len(column), width)), at < width
    out[row[own], at[own]] = flat.fill_null(0).to_numpy()[own]
    sizes[column.is_null().to_numpy(zero_copy_only=False)] = -1
    sizes[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, sizes


def vectors_best(corpus: DataFrame, probes: pa.Table, k: int) -> DataFrame:
    """(query_id, id, score) of what may be among the best ``k`` by inner product; null, and last, where a vector is missing or of another size. probes: query_id, vector."""
    vectors = probes.column("vector").combine_chunks()
    width = int(np.diff(lists(vectors)[1]).max(initial=0))
    held = corpus.sparkSession.sparkContext.broadcast((probes.column("query_id").combine_chunks(), *padded(vectors, width)))
    kinds = corpus.sparkSession.createDataFrame(probes.select(["query_id"]).slice(0, 0)).schema.add(corpus.schema["id"]).add("score", "double")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, asked, asked_sizes = held.value
        best = Best(len(keys), k)
        for batch in batches:
            for begin, end in cuts(np.zeros(batch.num_rows, np.int64), len(keys)):
                ids = batch.column(0).slice(begin, end - begin)
                x, sizes = padded(batch.column(1).slice(begin, end - begin), asked.shape[1])
                scores = asked @ x.T
                missing = (asked_sizes[:, None] != sizes) | (sizes < 0)
                if missing.any():
                    scores[missing] = -np.inf
                query, row, value = best.add(scores, places(ids))
                columns = [keys.take(pa.array(query)), ids.take(pa.array(row)), pa.array(value, mask=missing[query, row])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])

    return corpus.select("id", "vector").mapInArrow(scan, kinds)
