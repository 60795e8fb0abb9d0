"""Suffix-array dedup: bytes covered by a string that starts twice in the corpus.

Method. Suffixes are ordered by their leading tokens. Splitters from a sample
range-partition them over buckets (``repartitionByRange``), each bucket is
sorted locally by a multikey quicksort, neighbours are compared, and the
outermost suffixes of the buckets are compared across boundaries.

Ordering a suffix for every byte would move two hundred times the input, so the
array is built twice over fewer suffixes, without losing any repeat:

1. *Anchored suffixes.* Every string of ``length`` bytes has one anchor, the
   gram of ``gram`` bytes in it with the smallest hash. Suffixes at anchors
   are ordered by two tokens, a hash of the gram and one of the whole span of
   the strings that share the anchor. Equal spans: all their strings repeat. A
   gram met once: none repeats.
2. *Full suffixes*, only where grams agree and spans differ (borders of
   copies): the spans of a gram meet in one task, where a suffix for each of
   their strings is sorted by its bytes, eight at a time and only as deep as
   neighbours agree. A gram with more than ``LARGEST`` spans does not: its
   strings are counted by two hashes, with partial sums.

A key that many documents share is split over buckets by document and place,
the lower-order sort keys, so no bucket depends on how often a passage occurs.
Nothing is collected, capped or sampled but the splitters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import Block, anchors, blocks, covered, ragged_arange, utf8
from .scratch import written
from .shards import whole_groups

#: Strings of this many bytes count as repeats.
LENGTH = 200
#: Bytes of an anchor's gram.
GRAM = 100
#: Spans of a gram that meet in one task.
LARGEST = 4096

WHOLE, DETAIL, WITNESS = 0, 1, 2
_PART_BITS = 10
#: Stands for a missing doc_id in between.
NO_ID = -(1 << 63)
_SUFFIX = "t1 long, t2 long, doc_id long, place int, at long"
_VERDICT = "doc_id long, place int, run long, kind int, t1 long"
#: A span of a gram (key), or, without bytes, one string of a gram with very many spans (key and h2 are its hashes).
_SPAN = "key long, h2 long, doc_id long, place int, run long, witness boolean, span binary"
_RUN = "doc_id long, place int, run long"


def pack(low: np.ndarray, count: np.ndarray, shift: np.ndarray | int = 0) -> np.ndarray:
    """A run of windows as one integer: its first window, how far behind it the anchor begins, and how many windows."""
    return (low.astype(np.int64) << 2 * _PART_BITS) | (np.asarray(shift, np.int64) << _PART_BITS) | count.astype(np.int64)


def unpack(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, shift of the anchor."""
    part = (1 << _PART_BITS) - 1
    return runs >> 2 * _PART_BITS, runs & part, runs >> _PART_BITS & part


def single(at: str) -> str:
    """SQL for the run of one window."""
    return f"shiftleft({at}, {2 * _PART_BITS}) | 1"


def multikey_quicksort(tokens: list[np.ndarray | Callable[[np.ndarray], np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the rows, and for each depth where a new prefix of so many tokens begins.

    All rows are parted by their leading token; only rows that tie there are
    parted by the next one, within their own part. A token may be a function
    that reads it for the rows that still tie.
    """
    order = np.argsort(tokens[0], kind="stable")
    key = tokens[0][order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    heads, tied = [new], np.arange(len(key))
    for token in tokens[1:]:
        # Rows whose part has others; parts are runs of places in the order so far.
        part = np.cumsum(new[tied]) - 1
        tied = tied[np.bincount(part, minlength=1)[part] > 1] if len(tied) else tied
        new = new.copy()
        if len(tied):
            part = np.cumsum(new[tied]) - 1
            key = token(order[tied]) if callable(token) else token[order[tied]]
            mixed = np.zeros(part[-1] + 1, bool)
            mixed[part[key != key[np.flatnonzero(new[tied])][part]]] = True
            on = np.flatnonzero(mixed[part])  # the other parts agree in this token, and stay as they are
            if len(on):
                key, part, at = key[on], part[on], tied[on]
                inner = np.lexsort((key, part))
                order[at], key = order[at][inner], key[inner]
                new[at[1:]] |= (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        heads.append(new)
    return order, heads


def columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """The columns of a whole bucket of small rows; its size follows the number of shuffle partitions."""
    table = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
    return table and [c.to_numpy() for c in table.columns]


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, place and text; place, a hash of the text, tells rows of one doc_id apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text).alias("place"), text.alias("text"))


def _anchored(length: int, gram: int):
    def suffixes(batches):
        for batch in batches:
            ids, places = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for block in blocks(batch.column(2)):
                if len(block.data) < length:
                    continue
                grams = block.byte_ngrams(gram)
                a = anchors(grams, block.starts, gram, length)
                own = np.searchsorted(block.starts, a.low, side="right") - 1
                t2 = block.hashes(a.low, a.low + a.count - 1 + length)
                at = pack(a.low - block.starts[own], a.count, a.at - a.low)
                own += block.first
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (grams[a.at].view(np.int64), t2.view(np.int64), ids[own].astype(np.int64), places[own], at)], names=["t1", "t2", "doc_id", "place", "at"])

    return suffixes


def _judge_anchored(batches):
    held = columns(batches)
    if held is None:
        return
    t1, t2, *rest = held
    order, (new1, new2) = multikey_quicksort([t1, t2])
    group, span = np.cumsum(new1) - 1, np.cumsum(new2) - 1
    several = (np.bincount(group[new2]) > 1)[group]
    several |= (group == 0) | (group == group[-1])  # the rest of these may lie in the next bucket
    repeated = (np.bincount(span) > 1)[span]
    kind = np.full(len(order), -1, np.int32)
    kind[several & ~repeated] = DETAIL
    kind[repeated] = WHOLE
    keep, witness = np.flatnonzero(kind >= 0), np.flatnonzero(several & repeated & new2)
    out = [np.concatenate((c[order[keep]], c[order[witness]])) for c in (*rest, t1)]
    out.insert(3, np.concatenate((kind[keep], np.full(len(witness), WITNESS, np.int32))))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["doc_id", "place", "run", "kind", "t1"])


def structs_of(batch: pa.RecordBatch, name: str, block: Block) -> tuple[list[np.ndarray], np.ndarray]:
    """Fields of a column of structs in lists for the block's rows, and the row within the block of each."""
    column = batch.column(batch.schema.get_field_index(name)).slice(block.first, block.rows)
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    held = column.flatten()
    return [f.to_numpy(zero_copy_only=False) for f in held.flatten()], np.repeat(np.arange(block.rows), counts)


def _spans(length: int, gram: int):
    half = length // 2

    def spans(batches):
        for batch in batches:
            ids, places = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for block in blocks(batch.column(2)):
                (runs, t1, witness, hot), own = structs_of(batch, "runs", block)
                if not len(runs):
                    continue
                low, count, _ = unpack(runs)
                begin, row = low + block.starts[own], own + block.first
                few = np.flatnonzero(~hot)
                held = [block.data[a:b].tobytes() for a, b in zip(begin[few].tolist(), (begin + count - 1 + length)[few].tolist(), strict=True)]
                yield _span_batch(t1[few], np.zeros(len(few), np.int64), ids[row[few]], places[row[few]], runs[few], witness[few], pa.array(held, pa.binary()))
                each = ragged_arange(low[hot], count[hot])
                row, mark = np.repeat(own[hot], count[hot]), np.repeat(witness[hot], count[hot])
                at, row = each + block.starts[row], row + block.first
                h1, h2 = block.hashes(at, at + half), block.hashes(at + half, at + length)
                yield _span_batch(h1.view(np.int64), h2.view(np.int64), ids[row], places[row], pack(each, np.ones(len(each), np.int64)), mark, pa.nulls(len(each), pa.binary()))

    return spans


def _span_batch(key, h2, ids, places, runs, witness, span) -> pa.RecordBatch:
    arrays = (key, h2, ids.astype(np.int64), places.astype(np.int32), runs, witness.astype(bool))
    return pa.RecordBatch.from_arrays([*map(pa.array, arrays), span], names=["key", "h2", "doc_id", "place", "run", "witness", "span"])


def runs_of(found: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and packed run of each maximal stretch of found windows; found has count[i] windows of row i, from low[i] on, one row after another."""
    row, at = np.repeat(np.arange(len(count)), count), ragged_arange(low, count)
    on = np.flatnonzero(found)
    new = np.append(True, (np.diff(on) > 1) | (np.diff(row[on]) > 0))[: len(on)]
    first = np.flatnonzero(new)
    return row[on[first]], pack(at[on[first]], np.diff(np.append(first, len(on))))


def _sorted_spans(length: int):
    """Repeated windows among the spans of each gram, by sorting a suffix for each window by its bytes."""

    def judge(batches):
        for rows in whole_groups(batches):
            key, _, ids, places, run, witness = (c.to_numpy() for c in rows.columns[:6])
            low, count, shift = unpack(run)
            data, starts = utf8(rows.column(6))
            data, starts = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64), starts[:-1]
            token = np.zeros(len(data) - 7, np.uint64)
            for k in range(8):
                token = token << np.uint64(8) | data[k : k + len(token)]
            row = np.repeat(np.arange(len(key)), count)
            begin = ragged_arange(starts, count)
            anchor = (starts + shift)[row] - begin
            # Equal windows have their anchor at the same place within them, so that and the gram are the leading tokens.
            group = np.cumsum(np.append(True, key[1:] != key[:-1]))[row] * (1 << _PART_BITS) + anchor
            offsets = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
            byte = [*range(length)] if length < 8 else []
            tokens = [group, *((lambda at, o=o: token[begin[at] + o]) for o in offsets), *((lambda at, o=o: data[begin[at] + o]) for o in byte)]
            order, heads = multikey_quicksort(tokens)
            same = np.cumsum(heads[-1]) - 1
            found = np.zeros(len(row), bool)
            found[order] = (np.bincount(same) > 1)[same]
            found &= ~witness[row]
            own, runs = runs_of(found, low, count)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[own], places[own], runs)], names=["doc_id", "place", "run"])

    return judge


def _cut(length: int):
    def texts(batches):
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(2)):
                (runs,), own = structs_of(batch, "runs", block)
                low, count, _ = unpack(runs)
                begin = low + block.starts[own]
                gone = covered(begin, begin + count - 1 + length, len(block.data)) if len(runs) else np.zeros(len(block.data), bool)
                before = np.append(0, np.cumsum(gone))
                removed = before[block.starts[1:]] - before[block.starts[:-1]]
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                inner = block.starts[:-1][np.diff(block.starts) > 0]
                head[inner] = gone[inner]
                heads = np.append(0, np.cumsum(head))
                kept = [
                    (text if not r else np.frombuffer(text, np.uint8)[~gone[block.starts[i] : block.starts[i + 1]]].tobytes())
                    for i, r in enumerate(removed) for text in (block.text(i),)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(block.first, block.rows), pa.array(np.diff(block.starts)), pa.array(removed.astype(np.int64)),
                        pa.array((heads[block.starts[1:]] - heads[block.starts[:-1]]).astype(np.int64)),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return texts


def repeated_bytes_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, largest: int = LARGEST) -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts elsewhere.

    Returns for each row doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and kept (the remaining bytes). Strings lie within one
    text and are judged on the input.

    Defined cases: a null text counts as empty; texts under ``length`` bytes
    stay as they are; rows that repeat a doc_id count as documents of their
    own, with equal or other texts, and so do rows without doc_id (the smallest long stands for none);
    of equal strings none is first, so all go; very long texts are read whole, with some 89 bytes of
    memory for each of theirs; an empty table gives none; columns other than the two named
    are ignored.
    """
    docs = keyed_texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    suffixes = docs.mapInArrow(_anchored(length, gram), _SUFFIX)
    verdicts = written(suffixes.repartitionByRange("t1", "t2", "doc_id", "at").mapInArrow(_judge_anchored, _VERDICT), "suffixes")
    spans = written(with_runs(docs, _with_heat(verdicts, largest), "t1", "witness", "hot").mapInArrow(_spans(length, gram), _SPAN), "spans")
    few = spans.where("span is not null").repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_spans(length), _RUN)
    many = spans.where("span is null").select("key", "h2", "doc_id", "place", "run", "witness")
    counts = many.groupBy(F.col("key").alias("k"), F.col("h2").alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    met = many.where("not witness").join(counts, F.expr("key = k and h2 = h")).select("doc_id", "place", "run")
    runs = verdicts.where(F.col("kind") == WHOLE).select("doc_id", "place", "run").union(few).union(met)
    out = with_runs(docs, runs).mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def _with_heat(verdicts: DataFrame, largest: int) -> DataFrame:
    """The spans to compare in full, with hot for those of a gram that has more than ``largest``."""
    detail = verdicts.where(F.col("kind") != WHOLE)
    hot = written(detail.groupBy(F.col("t1").alias("t")).agg(F.count("*").alias("n")).where(F.col("n") > largest).select("t"), "hot")
    marked = detail.join(hot, F.col("t1") == F.col("t"), "left")
    return marked.select("doc_id", "place", "run", "t1", (F.col("kind") == WITNESS).alias("witness"), F.col("t").isNotNull().alias("hot"))


def with_runs(docs: DataFrame, runs: DataFrame, *further: str) -> DataFrame:
    """doc_id, place, text and runs (an array of structs): the text meets its runs by one exchange, the same each time.

    As the exchanges of the texts are alike, Spark runs one and reads it twice.
    """
    lists = runs.groupBy("doc_id", "place").agg(F.collect_list(F.struct("run", *further)).alias("runs"))
    return docs.join(lists.hint("shuffle_hash"), ["doc_id", "place"], "left").select("doc_id", "place", "text", "runs")
