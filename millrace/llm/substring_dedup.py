"""Substring dedup by seed and extend: word runs that an earlier document holds.

Method. Winnowing picks in every window of ``length`` words one anchor, the
gram of ``gram`` words with the smallest hash. Documents are joined on equal
anchors (the seeds). A seed is extended both ways to the whole stretch of
windows around it: where the stretch is the same in an earlier document,
all its windows are. Where stretches of an anchor differ, the first document of
each meets the others in one task, and their seeds are extended word by word to
the left and to the right, by the words themselves: documents stay together as
long as their next words agree. A match that is ``length`` words long, however
these lie around the anchor, marks the later document's words. What is found
around neighbouring seeds is merged into maximal repeats and removed.

The join is a range exchange over (anchor, stretch, document, place), so the
rows of an anchor that very many documents share are dealt to several tasks
by document, and each task compares with the smallest document it holds. An
anchor that still has more than ``LARGEST`` stretches is split: each of their
windows meets its like by two hashes, with partial minima. No pairs are formed.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .blocks import Block, anchors, blocks, covered, ngrams, ragged_arange
from .scratch import written
from .shards import whole_groups
from .suffix_dedup import DETAIL, WHOLE, columns, keyed_texts, multikey_quicksort, pack, runs_of, structs_of, unpack, with_runs

#: Words in a window.
LENGTH = 13
#: Words in an anchor.
GRAM = 6
#: Stretches of an anchor that meet in one task.
LARGEST = 4096

_SEED = "t1 long, t2 long, doc_id long, place int, at long"
_VERDICT = "doc_id long, place int, run long, kind int, t1 long"
#: A stretch of an anchor (key), or, without words, one window of an anchor with very many stretches (key and h2 are its hashes).
_STRETCH = "key long, h2 long, doc_id long, place int, run long, words string"
_RUN = "doc_id long, place int, run long"


def _seeds(length: int, gram: int):
    def seeds(batches):
        for batch in batches:
            ids, places = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for block in blocks(batch.column(2)):
                begin, end, first = block.words
                if len(begin) < length:
                    continue
                grams = ngrams(block.word_hashes, gram)
                a = anchors(grams, first, gram, length)
                own = np.searchsorted(first, a.low, side="right") - 1
                t2 = _stretch(block.word_hashes, a.low, a.low + a.count - 1 + length)
                at = pack(a.low - first[own], a.count, a.at - a.low)
                own += block.first
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (grams[a.at].view(np.int64), t2, ids[own].astype(np.int64), places[own], at)], names=["t1", "t2", "doc_id", "place", "at"])

    return seeds


def _stretch(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words begin..end - 1 of each stretch; all are of a few words."""
    out, size = np.zeros(len(begin), np.uint64), end - begin
    for j in range(int(size.max(initial=0))):
        on = j < size
        out[on] = (out[on] ^ hashes[begin[on] + j]) * np.uint64(0x9E3779B97F4A7C15)
        out[on] ^= out[on] >> np.uint64(29)
    return out.view(np.int64)


def _judge_seeds(batches):
    held = columns(batches)
    if held is None:
        return
    t1, t2, *rest = held
    order, (new1, new2) = multikey_quicksort([t1, t2])
    doc = rest[0][order]
    group, stretch = np.cumsum(new1) - 1, np.cumsum(new2) - 1
    begins = np.flatnonzero(new1)
    least, most = np.minimum.reduceat(doc, begins)[group], np.maximum.reduceat(doc, begins)[group]
    later = doc > np.minimum.reduceat(doc, np.flatnonzero(new2))[stretch]
    met = (least < most) | (group == 0) | (group == group[-1])  # the rest of these may lie in the next task
    kind = np.where(later, WHOLE, DETAIL).astype(np.int32)
    keep = later | met
    out = [c[order][keep] for c in (*rest, t1)]
    out.insert(3, kind[keep])
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["doc_id", "place", "run", "kind", "t1"])


def _stretches(length: int):
    half = (length + 1) // 2

    def stretches(batches):
        for batch in batches:
            ids, places = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for block in blocks(batch.column(2)):
                (runs, t1, hot), own = structs_of(batch, "runs", block)
                if not len(runs):
                    continue
                begins, ends, first = block.words
                low, count, _ = unpack(runs)
                begin, row = low + first[own], own + block.first
                few = np.flatnonzero(~hot)
                words = [b" ".join(block.data[begins[a] : ends[b]].tobytes().split()) for a, b in zip(begin[few].tolist(), (begin + count - 2 + length)[few].tolist(), strict=True)]
                yield _stretch_batch(t1[few], np.zeros(len(few), np.int64), ids[row[few]], places[row[few]], runs[few], pa.array(words, pa.string()))
                each = ragged_arange(low[hot], count[hot])
                row = np.repeat(own[hot], count[hot])
                at, row = each + first[row], row + block.first
                left, right = ngrams(block.word_hashes, half), ngrams(block.word_hashes, length - half)
                yield _stretch_batch(left[at].view(np.int64), right[at + half].view(np.int64), ids[row], places[row], pack(each, np.ones(len(each), np.int64)), pa.nulls(len(each), pa.string()))

    return stretches


def _stretch_batch(key, h2, ids, places, runs, words) -> pa.RecordBatch:
    arrays = (key, h2, ids.astype(np.int64), places.astype(np.int32), runs)
    return pa.RecordBatch.from_arrays([*map(pa.array, arrays), words], names=["key", "h2", "doc_id", "place", "run", "words"])


def _classes(*columns: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows that agree in all columns."""
    out = columns[0]
    for c in columns[1:]:
        out = np.unique(out, return_inverse=True)[1].astype(np.int64) * (int(c.max(initial=0)) + 1) + c
    return np.unique(out, return_inverse=True)[1].astype(np.int64)


def _extended(length: int, gram: int):
    """The windows of each stretch that a document of smaller id holds, by extending the stretches of an anchor word by word."""
    reach = length - gram

    def extend(batches):
        for rows in whole_groups(batches):
            key, _, ids, places, run = (c.to_numpy() for c in rows.columns[:5])
            low, count, shift = unpack(run)
            # Each distinct word has a number, so words are compared as they are.
            lists = pc.split_pattern(rows.column(5).combine_chunks(), " ")
            first, size = lists.offsets.to_numpy().astype(np.int64)[:-1], lists.value_lengths().to_numpy().astype(np.int64)
            word = np.append(lists.values.dictionary_encode().indices.to_numpy().astype(np.int64) + 1, 0)
            anchor, own = first + shift, np.arange(len(key))
            base = _classes(key, *(word[anchor + k] for k in range(gram)))

            def sides(step: int, base=base, anchor=anchor, first=first, size=size) -> list[np.ndarray]:
                """The class of each row with 0, 1, ... words further; a row that has no such word is alone."""
                out, at = [base], anchor if step < 0 else anchor + gram - 1
                for k in range(1, reach + 1):
                    place = at + step * k
                    inside = (place >= first) & (place < first + size)
                    out.append(_classes(out[-1], np.where(inside, word[np.where(inside, place, 0)], 0), np.where(inside, 0, own + 1)))
                return out

            left, right = sides(-1), sides(1)
            # Window number j of a row begins shift - j words before its anchor.
            begins = np.cumsum(count) - count
            found = np.zeros(int(count.sum()), bool)
            for x in range(reach + 1):
                j = shift - x
                on = np.flatnonzero((j >= 0) & (j < count))
                if len(on):
                    same = _classes(left[x][on], right[reach - x][on])
                    least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
                    np.minimum.at(least, same, ids[on])
                    found[begins[on] + j[on]] = ids[on] > least[same]
            row, runs = runs_of(found, low, count)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], places[row], runs)], names=["doc_id", "place", "run"])

    return extend


def _cut(length: int):
    def texts(batches):
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(2)):
                (runs,), own = structs_of(batch, "runs", block)
                _, _, first = block.words
                low, count, _ = unpack(runs)
                begin = low + first[own]
                gone = covered(begin, begin + count - 1 + length, int(first[-1])) if len(runs) else np.zeros(int(first[-1]), bool)
                before = np.append(0, np.cumsum(gone))
                removed = (before[first[1:]] - before[first[:-1]]).astype(np.int64)
                kept = [
                    b" ".join(compress(words, (~gone[first[i] : first[i + 1]]).tolist()) if r else words)
                    for i, r in enumerate(removed) for words in (block.text(i).split(),)
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.first, block.rows), pa.array(np.diff(first).astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode() for k in kept], pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return texts


def repeated_words_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, largest: int = LARGEST) -> DataFrame:
    """Remove every word in a window of ``length`` words that a document of smaller id holds too.

    Returns for each row doc_id, n_words, n_removed, kept_sha256 and kept (the
    words that stay, joined by one space). Windows are judged on the input.

    Defined cases: a null text has no words; a text under ``length`` words
    stays whole; rows that repeat a doc_id, with equal or other texts, are of
    the same document, so neither removes the other's words; a row without
    doc_id stays whole and removes nothing (no id is smaller than none); very long texts are
    read whole, with working memory in proportion; an empty table gives none; columns
    other than the two named are ignored.
    """
    docs = keyed_texts(docs, id_col, text_col)
    seeds = docs.where("doc_id is not null").mapInArrow(_seeds(length, gram), _SEED)
    verdicts = written(seeds.repartitionByRange("t1", "t2", "doc_id", "at").mapInArrow(_judge_seeds, _VERDICT), "seeds")
    detail = verdicts.where(F.col("kind") == DETAIL)
    hot = written(detail.groupBy(F.col("t1").alias("t")).agg(F.count("*").alias("n")).where(F.col("n") > largest).select("t"), "hot")
    marked = detail.join(hot, F.col("t1") == F.col("t"), "left").select("doc_id", "place", "run", "t1", F.col("t").isNotNull().alias("hot"))
    stretches = written(with_runs(docs, marked, "t1", "hot").mapInArrow(_stretches(length), _STRETCH), "stretches")
    few = stretches.where("words is not null").repartition("key").sortWithinPartitions("key").mapInArrow(_extended(length, gram), _RUN)
    many = stretches.where("words is null").select("key", "h2", "doc_id", "place", "run")
    least = many.groupBy(F.col("key").alias("k"), F.col("h2").alias("h")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    met = many.join(least, F.expr("key = k and h2 = h")).where("doc_id > least").select("doc_id", "place", "run")
    runs = verdicts.where(F.col("kind") == WHOLE).select("doc_id", "place", "run").union(few).union(met)
    return with_runs(docs, runs).mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
