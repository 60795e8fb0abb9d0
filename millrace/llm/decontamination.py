"""Benchmark decontamination: BM25 over an index of test items, with block-max WAND.

Method. The test items are the documents of a BM25 inverted index over word
pairs (single words of a test item occur in most passages of its language),
whose postings lie in blocks that know their greatest contribution. Every passage
of every training text is a query. Passages are as long as two items of the
greatest length and begin one such length apart, so each stretch of an
item's length lies whole in one of them. Block-max WAND returns all items
whose score is at least their threshold: the least score that a passage
can have which the verification accepts. Contributions are kept as shares of
that threshold, so one bound, 1, holds for all items.

Verification. Five-word shingles: at least ``SIMILARITY`` of an item's
shingles must stand in the passage, and at least ``PART`` of the words of
its question and of its answer must lie within them. The answer is the
item's last sentence, the question what comes before; an item of a single
sentence is halved.

The index is broadcast in shards of at most ``SHARD_ITEMS`` items, of which a
reading of the corpus searches ``SHARDS_AT_ONCE``. Numbers of items, document
frequencies and the mean length are those of all items, so a score does not
depend on the shards.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import Block, blocks, ngrams
from .scratch import free_names, written

SHINGLE, SIMILARITY, PART = 5, 0.8, 0.5
#: Words in a term of the index.
TERM = 2
K1, B = 1.2, 0.75
#: Items in a broadcast shard of the index.
SHARD_ITEMS = 20_000
#: Shards that are held and searched together.
SHARDS_AT_ONCE = 4
#: Postings in a block.
BLOCK_POSTINGS = 64
_EPS = 1e-9

#: ASCII letters in lower case and digits stay, other ASCII is a separator, bytes of other characters stay.
_WORD_BYTES = np.arange(256, dtype=np.uint8)
_WORD_BYTES[65:91] += 32
_WORD_BYTES[[i for i in range(128) if not chr(i).isalnum()]] = 32


def _plain(block: Block) -> Block:
    return Block(block.first, _WORD_BYTES[block.data], block.starts)


def _hashes(text: str) -> np.ndarray:
    (block,) = blocks(pa.array([text], pa.large_string()), 1 << 62)
    return _plain(block).word_hashes


class Index:
    """The inverted index of one shard of items.

    ``overall`` has the number of items, the mean number of their terms and
    the document frequency of each of the shard's terms, if there are further shards.
    """

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, overall: tuple[int, float, dict[int, int]] | None = None) -> None:
        self.ids = np.array([i for i, _ in items], np.int64)
        words = [_hashes(text.lower()) for _, text in items]
        self.length = max((len(w) for w in words), default=1)
        terms = [ngrams(w, TERM) for w in words]
        if overall is None:
            overall = len(items), sum(map(len, terms)) / max(len(items), 1), Counter(h for t in terms for h in set(t.tolist()))
        count, mean, df = overall[0], max(overall[1], 1), overall[2]
        postings = defaultdict(list)
        for i, w in enumerate(terms):
            tf = Counter(w.tolist())
            weight = {h: math.log(1 + (count - df[h] + 0.5) / (df[h] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for h, n in tf.items()}
            for h, v in weight.items():
                postings[h].append((i, v / self._threshold(len(words[i]), weight, similarity)))
        self.terms = np.array(sorted(postings), np.uint64)
        self.place = {h: t for t, h in enumerate(self.terms.tolist())}
        self.items = [[i for i, _ in postings[h]] for h in self.terms.tolist()]
        self.shares = [[v for _, v in postings[h]] for h in self.terms.tolist()]
        self.blocks = [[max(v[k : k + BLOCK_POSTINGS]) for k in range(0, len(v), BLOCK_POSTINGS)] for v in self.shares]
        self.bound = np.array([max(v) for v in self.blocks])
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.size, self.shingles, self.question, self.answer = [], [], [], []
        for (_, text), w in zip(items, words, strict=True):
            self.size.append(min(SHINGLE, len(w)))
            self.shingles.append(ngrams(w, self.size[-1]))
            cut = self._answer_at(text, len(w))
            self.question.append(slice(0, cut))
            self.answer.append(slice(cut, len(w)))

    @staticmethod
    def _threshold(words: int, weight: dict[int, float], similarity: float) -> float:
        """The least score of a passage that holds enough shingles: r of them hold r + 3 pairs or more."""
        shingles = max(words - SHINGLE + 1, 1)
        lost = shingles - max(math.ceil(similarity * shingles - _EPS), 1)
        least = sorted(weight.values())
        return max(sum(least[: max(len(least) - lost, 1)]), _EPS)

    @staticmethod
    def _answer_at(text: str, words: int) -> int:
        cut = [m.end() for m in re.finditer(r"[.!?\n](?=\s*\w)", text.strip())]
        at = len(_hashes(text.strip()[: cut[-1]].lower())) if cut else 0
        return at if 0 < at < words else words // 2

    def terms_of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each term, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.terms):
            maybe = np.flatnonzero(self.filter[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
            out[maybe] = np.where(self.terms[at] == hashes[maybe], at, -1)
        return out

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose shares over the distinct terms add up to at least 1, with the sum."""
        cursors = [[self.items[t][0], 0, t] for t in terms]  # item, place in postings, term
        found, need = [], 1 - _EPS
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.bound[t]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            head, best, until = cursors[: pivot + 1], 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.ids)
            for _, place, t in head:
                at = bisect_left(self.items[t], item, place) // BLOCK_POSTINGS
                if at < len(self.blocks[t]):
                    best += self.blocks[t][at]
                    until = min(until, self.items[t][min((at + 1) * BLOCK_POSTINGS, len(self.items[t])) - 1] + 1)
            if best < need:
                target = max(until, item + 1)
            elif head[0][0] == item:
                score = sum(self.shares[t][place] for _, place, t in head)
                if score >= need:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for c in head:
                if c[0] < target:
                    c[1] = bisect_left(self.items[c[2]], target, c[1])
                    c[0] = self.items[c[2]][c[1]] if c[1] < len(self.items[c[2]]) else -1
            cursors = [c for c in cursors if c[0] >= 0]

    def verified(self, item: int, words: np.ndarray, similarity: float) -> tuple[float, float, float] | None:
        """Shares of the item's shingles, question and answer in the passage, if they are enough."""
        own, size = self.shingles[item], self.size[item]
        hit = np.isin(own, ngrams(words, size))
        overlap = float(hit.mean())
        inside = np.zeros(len(own) + size - 1, bool)
        for j in range(size):
            inside[j : j + len(own)] |= hit
        question, answer = (float(inside[p].mean()) if inside[p].size else 1.0 for p in (self.question[item], self.answer[item]))
        return (overlap, question, answer) if overlap >= similarity - _EPS and min(question, answer) >= PART else None


_FOUND = "doc_id long, item_id long, passage long, score double, overlap double, question double, answer double"


def _search(shards: list, similarity: float):
    def search(batches):
        for batch in batches:
            ids = batch.column(0)
            for block, index in ((_plain(block), held.value) for block in blocks(batch.column(1)) for held in shards):
                width, stride = 2 * index.length, index.length
                hashes, first = block.word_hashes, block.words[2]
                terms = np.append(index.terms_of(ngrams(hashes, TERM)), [-1] * (TERM - 1))
                worth = np.append(0, np.cumsum(np.where(terms >= 0, index.bound[terms], 0.0))) if len(index.terms) else np.zeros(len(terms) + 1)
                size = np.diff(first)
                passages = np.where(size > 0, np.maximum(-(-(size - width) // stride), 0) + 1, 0)
                own = np.repeat(np.arange(block.rows), passages)
                number = np.arange(len(own)) - np.repeat(np.cumsum(passages) - passages, passages)
                begin = first[:-1][own] + number * stride
                end = np.minimum(begin + width, first[1:][own])
                # The bounds of all its words are less than 1: no item can reach 1.
                rows = [[] for _ in range(7)]
                for p in np.flatnonzero(worth[np.maximum(end - TERM + 1, begin)] - worth[begin] >= 1 - 1e-6):
                    t = terms[begin[p] : end[p] - TERM + 1]
                    t = np.unique(t[t >= 0])
                    if index.bound[t].sum() < 1 - _EPS:
                        continue
                    for item, score in index.wand(t.tolist()):
                        seen = index.verified(item, hashes[begin[p] : end[p]], similarity)
                        if seen:
                            for out, v in zip(rows, (ids[int(block.first + own[p])].as_py(), int(index.ids[item]), int(number[p]), score, *seen), strict=True):
                                out.append(v)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64() if k < 3 else pa.float64()) for k, r in enumerate(rows)], names=["doc_id", "item_id", "passage", "score", "overlap", "question", "answer"])

    return search


def _terms(batches):
    """shard, size and term: a row for each distinct term of an item, and one without term that has its number of terms."""
    for batch in batches:
        shard, size, term = [], [], []
        for text, at in zip(batch.column("text").to_pylist(), batch.column("shard").to_pylist(), strict=True):
            words = _hashes(text.lower())
            if len(words) >= TERM:
                own = ngrams(words, TERM)
                distinct = np.unique(own).view(np.int64).tolist()
                shard += [at] * (len(distinct) + 1)
                size += [len(own), *([None] * len(distinct))]
                term += [None, *distinct]
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(size, pa.int32()), pa.array(term, pa.int64())], names=["shard", "size", "term"])


def _index(items: DataFrame, terms: DataFrame | None, shard: int, similarity: float) -> Index:
    """The index of a shard; only its own items and terms come to the driver."""
    rows = items.where(F.col("shard") == shard).select("item_id", "text").collect()
    overall = None
    if terms is not None:
        n, mean = terms.agg(F.count("size"), F.avg("size")).first()
        own = terms.where((F.col("shard") == shard) & F.col("term").isNotNull()).select("term").distinct()
        df = terms.join(own, "term", "left_semi").groupBy("term").count().collect()
        overall = n, mean or 0.0, {r["term"] % (1 << 64): r["count"] for r in df}
    return Index(sorted((r["item_id"], r["text"]) for r in rows if len(_hashes(r["text"].lower())) >= TERM), similarity, overall)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """A row for each document and test item that it holds: doc_id, item_id, the first passage
    with the greatest overlap, its score (as a share of the threshold), and the overlaps.

    Defined cases: null and empty texts and items match nothing; an item of
    two to four words is one shingle of all its words, one of a single word
    matches nothing; repeated items are
    items of their own, repeated rows of a document one document; of passages
    with equal overlaps the first counts; every passage of a very long text is searched; an empty
    table gives none; columns other than those named are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where(r"text rlike '[\\p{L}\\p{N}]'")
    shards = max(-(-items.count() // shard_items), 1)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    terms = written(items.mapInArrow(_terms, "shard int, size int, term long"), "terms") if shards > 1 else None
    out = None
    for at in range(0, shards, SHARDS_AT_ONCE):
        # The driver and the tasks hold the indexes of one reading at a time.
        indexes = [spark.sparkContext.broadcast(_index(items, terms, shard, similarity)) for shard in range(at, min(at + SHARDS_AT_ONCE, shards))]
        found = texts.mapInArrow(_search(indexes, similarity), _FOUND)
        if shards > SHARDS_AT_ONCE:
            found = written(found, "found")
            for index in indexes:
                index.destroy()
        out = found if out is None else out.union(found)
    best = F.max(F.struct("overlap", "score", (-F.col("passage")).alias("p"), "question", "answer")).alias("b")
    out = out.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", (-F.col("b.p")).alias("passage"), *(F.round(f"b.{c}", 6).alias(c) for c in ("score", "overlap", "question", "answer")))


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose text holds a test item.

    Each row is judged by its own text, known by a 64-bit hash: a row without doc_id as any other, and rows that share an id apart.
    """
    text, held = F.col(text_col).cast("string"), free_names(docs, "_text_hash")[0]
    texts = docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text"))
    bad = written(contaminated(texts, items, **how).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    return docs.withColumn(held, F.xxhash64(text)).join(bad.withColumnRenamed("_bad", f"{held}_bad"), F.col(held) == F.col(f"{held}_bad"), "left_anti").drop(held)
