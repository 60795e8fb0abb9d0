"""Phrase collocations from position bitmaps, as SPAM mines sequences.

Method. A task lays the words of a shard (an eighth of a megabyte of texts) on a line of positions, with a
gap between pieces, so that no phrase reaches over one. Every word has a bitmap over this line, kept
compressed: only containers of ``WIDTH`` positions that hold a bit, in order. A phrase's
bitmap marks its last words. Shifting it by one place, with the carry going to the next
container, and AND with the bitmaps of all words extend it; the popcounts of the results are
the extended phrases' counts in the shard. The walk is depth-first: a batch of phrases is extended to
the full length before the next batch. Spark sums the popcounts over the shards.

A phrase is only extended while all its parts are frequent in the whole corpus. For this there is
a pass for each length, and the frequent phrases of a length go to the tasks of the next
pass as a bit field by hash, whose size is fixed (``FIELD_BITS``), however many there are: a
wrong hit costs work and never a result. The last pass counts all lengths by the words themselves.

Words stand by a 64-bit code of their language and bytes. The vocabulary is counted by the words and
checked for codes that two words share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import Block, mix, ragged_arange, utf8
from .scratch import written
from .token_counts import parts

#: Positions of a container.
WIDTH = 16
#: Bytes of text of a shard.
SHARD = 1 << 17
#: Rows that are extended together.
BATCH = 1 << 14
#: Size of the field that frequent phrases are marked in, as a power of two.
FIELD_BITS = 27
#: Partial counts that a task holds before it hands them on.
HELD = 1 << 18

_STEP = np.uint64(0xD6E8FEB86659FD93)
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_IS_BREAK = np.isin(np.arange(256), list(_BREAKS))
#: Lower case for A-Z, and a blank for what ends a word.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[9, *_BREAKS]] = 32


def _cuts(look: np.ndarray) -> np.ndarray:
    """Places where a long text may be cut: after a piece."""
    return np.flatnonzero(_IS_BREAK[look[:-1]])


@dataclass
class Words:
    """The words of a shard: each one's code, its position on the line, and where its bytes are."""

    block: Block
    code: np.ndarray
    position: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray


def words_of(block: Block, languages: np.ndarray) -> Words:
    """``languages``: a code of each text's language."""
    plain = Block(block.first, _PLAIN[block.data], block.starts)
    begin, end, first = plain.words
    text = np.repeat(np.arange(block.rows), np.diff(first))
    piece = np.cumsum(_IS_BREAK[block.data])[begin] if len(begin) else begin
    apart = np.zeros(len(begin), bool)
    apart[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
    code = mix(plain.word_hashes ^ languages[text]) if len(begin) else np.zeros(0, np.uint64)
    return Words(plain, code, np.arange(len(begin)) + np.cumsum(apart), begin, end, text)


def marked(field: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the field has a mark for each key."""
    slot = key >> np.uint64(64 - FIELD_BITS)
    return (field[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


class Bitmaps:
    """The compressed bitmaps of a shard's words: rows of word, container and bits, by word and by container."""

    def __init__(self, code: np.ndarray, position: np.ndarray) -> None:
        order = np.argsort(code, kind="stable")
        code, position = code[order], position[order]
        other = np.ones(len(code), bool)
        other[1:] = code[1:] != code[:-1]
        self.words, word, container = code[other], np.cumsum(other) - 1, position // WIDTH
        new = other
        new[1:] |= container[1:] != container[:-1]
        heads = np.flatnonzero(new)
        #: By word, then container.
        self.word, self.container = word[heads], container[heads]
        bits = np.uint32(1) << (position % WIDTH).astype(np.uint32)
        self.bits = np.bitwise_or.reduceat(bits, heads) if len(heads) else bits
        last = int(container.max(initial=-1))
        by_container = np.argsort(self.container.astype(np.uint16 if last < 1 << 16 else np.int64), kind="stable")
        self._word, self._bits = self.word[by_container], self.bits[by_container]
        self._first = np.append(0, np.cumsum(np.bincount(self.container, minlength=last + 2)))

    def shifted(self, container: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows one place further, with what each came from: what is carried is a row of the next container."""
        bits = bits << np.uint32(1)
        low, carry = bits & np.uint32((1 << WIDTH) - 1), bits >> np.uint32(WIDTH)
        kept, moved = np.flatnonzero(low), np.flatnonzero(carry)
        return np.append(kept, moved), np.append(container[kept], container[moved] + 1), np.append(low[kept], carry[moved])

    def extended(self, container: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """AND of the shifted rows with every word's bitmap: the row, the word, the container and the bits of each that is not empty."""
        row, container, bits = self.shifted(container, bits)
        count = self._first[container + 1] - self._first[container]
        other = ragged_arange(self._first[container], count)
        at = np.repeat(np.arange(len(row)), count)
        both = bits[at] & self._bits[other]
        hit = np.flatnonzero(both)
        at, other = at[hit], other[hit]
        return row[at], self._word[other], container[at], both[hit]


def _walk(maps: Bitmaps, fields: list[np.ndarray], length: int, exact: bool, path: np.ndarray, keys: list[np.ndarray], container: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that extend the given ones: their words, key and count. ``path``: the words of each given row's phrase; ``keys``: of its last word, its last two, and so on.

    Not a function inside ``mined``: one that calls itself is a cycle, and so would keep each shard's bitmaps until Python collects cycles.
    """
    depth = len(keys) + 1
    for low in range(0, len(container), BATCH):
        cut = slice(low, low + BATCH)
        row, word, where, both = maps.extended(container[cut], bits[cut])
        code = maps.words[word]
        ends = [code, *(mix(k[cut][row] * _STEP + code) for k in keys)]
        kept = np.ones(len(row), bool)
        for field, key in zip(fields[1:], ends[1:], strict=False):
            kept &= marked(field, key)
        row, word, where, both, ends = row[kept], word[kept], where[kept], both[kept], [e[kept] for e in ends]
        if not len(row):
            continue
        trail = np.column_stack((path[cut][row], word))
        if exact or depth == length:
            yield trail, ends[-1], np.bitwise_count(both).astype(np.int64)
        if depth < length:
            yield from _walk(maps, fields, length, exact, trail, ends, where, both)


def mined(words: Words, fields: list[np.ndarray], length: int, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases of a shard whose parts are marked: words (a row for each phrase, padded with 0), key and count.

    ``fields`` have the frequent words, pairs and so on. With ``exact``, phrases of 2 to ``length`` words;
    else those of ``length`` words, without their words.
    """
    on = marked(fields[0], words.code)
    maps = Bitmaps(words.code[on], words.position[on])

    for trail, key, count in _walk(maps, fields, length, exact, maps.word[:, None], [maps.words[maps.word]], maps.container, maps.bits):
        order = np.argsort(key) if not exact else np.lexsort(trail.T)
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1] if not exact else (trail[order][1:] != trail[order][:-1]).any(axis=1)
        heads = np.flatnonzero(new)
        codes = np.zeros((len(heads), length), np.uint64)
        if exact:
            codes[:, : trail.shape[1]] = maps.words[trail[order][heads]]
        yield codes, key[order][heads], np.add.reduceat(count[order], heads)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, list]]:
    """The words of each shard, the number of each text's language, and the languages."""
    for batch in batches:
        named = batch.column(1).dictionary_encode()
        languages = named.dictionary.to_pylist()
        number = named.indices.to_numpy(zero_copy_only=False)
        codes = np.array([xxhash.xxh64_intdigest(x.encode()) for x in languages], np.uint64)
        for block, own in parts(*utf8(batch.column(0)), SHARD, _cuts):
            yield words_of(block, codes[number[own]]), number[own], languages


def _totals(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[heads], np.add.reduceat(count[order], heads)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, code, n) of the words of many shards."""
    waiting: list[pa.Table] = []

    def summed() -> pa.Table:
        held = pa.concat_tables(waiting).group_by(["lang", "word", "code"], use_threads=False).aggregate([("n", "sum")])
        waiting.clear()
        return held.rename_columns(["lang", "word", "code", "n"])

    for words, number, languages in _shards(batches):
        code, at, count = np.unique(words.code, return_index=True, return_counts=True)
        size = words.end[at] - words.begin[at]
        data = words.block.data[ragged_arange(words.begin[at], size)]
        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
        text = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
        lang = pa.array(languages, pa.string()).take(pa.array(number[words.text[at]], pa.int32()))
        waiting.append(pa.table({"lang": lang, "word": text, "code": code.view(np.int64), "n": count}))
        if sum(t.num_rows for t in waiting) > HELD:
            waiting = [summed()]
            if waiting[0].num_rows > HELD // 2:
                yield from waiting.pop().to_batches()
    if waiting:
        yield from summed().to_batches()


def _field(frequent: DataFrame, key: str) -> np.ndarray:
    """The keys marked in a field of bits; what reaches the driver are its words, of which there is a fixed number."""
    slot = F.shiftrightunsigned(key, 64 - FIELD_BITS)
    rows = frequent.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned({key}, {64 - FIELD_BITS}) & 63 as int)))").alias("bits")).toArrow()
    field = np.zeros(1 << (FIELD_BITS - 6), np.uint64)
    field[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return field


def _score(a: str, left: str, right: str) -> Column:
    return F.expr(f"cast((2000000 * cast({a} as decimal(30, 0))) div (cast({left} as decimal(30, 0)) + cast({right} as decimal(30, 0))) as long)")


def phrase_counts(texts: DataFrame, vocabulary: DataFrame, least: int, longest: int) -> DataFrame:
    """(phrase, a): the codes of each phrase of 2 to ``longest`` words that occurs ``least`` times or more. texts: text, lang."""
    context = texts.sparkSession.sparkContext
    fields = [_field(vocabulary.where(F.col("n") >= least), "code")]
    for length in range(2, longest):
        held = context.broadcast(fields)

        def count(batches, held=held, length=length):
            waiting = []
            for words, _, _ in _shards(batches):
                waiting += [(key, n) for _, key, n in mined(words, held.value, length, exact=False)]
                if sum(len(k) for k, _ in waiting) > HELD:
                    waiting = [_totals(*map(np.concatenate, zip(*waiting, strict=True)))]
                    if len(waiting[0][0]) > HELD // 2:
                        yield _keyed(*waiting.pop())
            if waiting:
                yield _keyed(*_totals(*map(np.concatenate, zip(*waiting, strict=True))))

        partial = texts.mapInArrow(count, "key long, n long")
        # Tasks have summed their own; dealt by key at once, the rest is summed in small maps behind the exchange.
        frequent = written(partial.repartition("key").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"), f"frequent{length}")
        fields = [*fields, _field(frequent, "key")]
    held, names = context.broadcast(fields), [f"c{i}" for i in range(longest)]

    def count_exactly(batches):
        for words, _, _ in _shards(batches):
            for codes, _, n in mined(words, held.value, longest, exact=True):
                yield pa.RecordBatch.from_arrays([*(pa.array(codes[:, i].view(np.int64)) for i in range(longest)), pa.array((codes > 0).sum(axis=1).astype(np.int32)), pa.array(n)], names=[*names, "k", "n"])

    partial = texts.mapInArrow(count_exactly, ", ".join(f"{c} long" for c in names) + ", k int, n long")
    exact = partial.groupBy(*names, "k").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return exact.select(F.slice(F.array(*names), 1, F.col("k")).alias("phrase"), "a")


def _keyed(key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["key", "n"])


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, most: int = 2000, contained: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` phrases of the highest score.

    Phrases of 2 to ``longest`` words that occur ``least`` times or more are candidates. Of the ways to cut one in two,
    with l and r occurrences of the parts, the one with the lowest 2,000,000 a / (l + r),
    rounded down, counts, and of equal ones the earliest. A candidate goes if a longer one that holds it
    occurs ``contained`` percent as often or more. n: all words of the language.

    Defined cases: a null language is ``und``; null and empty texts have no words; very long texts are
    read whole, in parts that end with a piece; repeated rows count each; ties in score go by occurrences, then by the
    phrase's bytes; an empty table gives none; columns other than the two named are
    ignored.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    counted = texts.mapInArrow(_vocabulary, "lang string, word string, code long, n long")
    vocabulary = written(counted.groupBy("lang", "word", "code").agg(F.sum("n").alias("n")), "vocabulary")
    if vocabulary.groupBy("code").count().where("count > 1").limit(1).count():
        raise ValueError("two words share a 64-bit code")
    words = vocabulary.where(F.col("n") >= least)
    phrases = written(phrase_counts(texts, vocabulary, least, longest), "phrases")

    parts_of = words.select(F.array("code").alias("part"), F.col("n").alias("f")).unionByName(phrases.select(F.col("phrase").alias("part"), F.col("a").alias("f")))
    cuts = phrases.select("phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("phrase", 1, F.col("k"))).withColumn("right", F.slice("phrase", F.col("k") + 1, F.size("phrase")))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts_of.select(F.col("part").alias(side), F.col("f").alias(name)), side)
    lowest = cuts.groupBy("phrase", "a").agg(F.min(F.struct(_score("a", "l", "r").alias("score"), "k", "l", "r")).alias("c"))

    spans = F.expr("flatten(transform(sequence(2, size(phrase) - 1), k -> transform(sequence(1, size(phrase) - k + 1), i -> slice(phrase, i, k))))")
    inside = phrases.where(F.size("phrase") > 2).select(F.explode(spans).alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("longer"))
    free = lowest.join(inside, "phrase", "left").where(F.col("longer").isNull() | F.expr(f"100 * cast(longer as decimal(30, 0)) < {contained} * cast(a as decimal(30, 0))"))

    first = words.select(F.col("code").alias("c0"), "lang")
    scored = free.select("phrase", "a", "c.l", "c.r", "c.score", F.col("phrase")[0].alias("c0")).join(first, "c0").drop("c0")
    near = scored.withColumn("near", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("near") <= most).drop("near")
    near = written(near, "near")
    spelt = near.select("phrase", F.posexplode("phrase").alias("i", "code")).join(words.select("code", "word"), "code")
    spelt = spelt.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text"))
    ranked = near.join(spelt, "phrase").withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
