import gc
import random
import re
import weakref
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import collocations as module
from millrace.llm.blocks import blocks
from millrace.llm.collocations import Bitmaps, collocations, words_of


def by_plain_loops(rows, least, most, longest=4, contained=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i : i + k]) for p, b in candidates.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1) if 100 * b >= contained * f[(p[0], *p[i : i + k])]}
    out = defaultdict(list)
    for p, a in candidates.items():
        if p not in gone:
            cuts = [(2_000_000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)}


def random_rows(count, seed=4):
    rng = random.Random(seed)
    words = ["the", "The", "of", "ab", "a", "naïve", "Éa", "中", "x" * 30, "if", "b", "c"]
    seps = [" "] * 9 + ["\t", "  ", ".", ", ", "\n", "!", "\x0b", "\xa0"]
    texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(120))) for _ in range(count)]
    return [(t, rng.choice(["en", "de", "und", None])) for t in texts]


def rows_of(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_rows_are_those_of_plain_loops(spark):
    rows = random_rows(200) + [(None, "en"), ("", "en"), ("the of ab a " * 20_000, "fr"), ("b b b b b b b b", "fr"), ("...", None), ("solo", "xx")]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "text string, lang string, n string").repartition(3)
    for least, most in ((30, 2000), (2, 7)):
        assert rows_of(collocations(df, least=least, most=most)) == by_plain_loops(rows, least, most)
    assert collocations(df.where(F.lit(False))).count() == 0


def test_shards_parts_batches_and_wrong_hits_change_nothing(spark, monkeypatch):
    rows = random_rows(60, 9)
    want = by_plain_loops(rows, 3, 50)
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)

    def in_small_steps(texts, vocabulary, least, longest):
        for name, value in {"SHARD": 256, "BATCH": 16, "HELD": 64, "FIELD_BITS": 8}.items():
            monkeypatch.setattr(module, name, value)
        # The tasks get these values with the functions' module, so they run in this process.
        fields = [module._field(vocabulary.where(F.col("n") >= least), "code")]
        batch = pa.RecordBatch.from_pandas(texts.toPandas(), preserve_index=False)
        counts = Counter()
        for words, _, _ in module._shards(iter([batch])):
            for codes, _, n in module.mined(words, fields, longest, exact=True):
                for c, m in zip(codes.view(np.int64).tolist(), n.tolist()):
                    counts[tuple(x for x in c if x)] += m
        return spark.createDataFrame([(list(p), a) for p, a in counts.items() if a >= least], "phrase array<long>, a long")

    monkeypatch.setattr(module, "phrase_counts", in_small_steps)
    assert rows_of(collocations(df, least=3, most=50)) == want


def test_bitmaps_carry_into_the_next_container():
    (block,) = blocks(pa.array(["a b " * 40, "a b"], pa.large_string()))
    words = words_of(block, np.zeros(2, np.uint64))
    maps = Bitmaps(words.code, words.position)
    assert words.position.tolist() == [*range(80), 81, 82]
    a = int(np.flatnonzero(maps.words == words.code[0])[0])
    on = maps.word == a
    row, word, container, bits = maps.extended(maps.container[on], maps.bits[on])
    assert set(word.tolist()) == {1 - a} and int(np.bitwise_count(bits).sum()) == 41
    b = maps.word == 1 - a
    _, word, _, bits = maps.extended(maps.container[b], maps.bits[b])
    assert set(word.tolist()) == {a} and int(np.bitwise_count(bits).sum()) == 39


def test_a_shard_is_freed_when_it_is_done_without_collecting_cycles(monkeypatch):
    made = []

    class Kept(Bitmaps):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(weakref.ref(self))

    monkeypatch.setattr(module, "Bitmaps", Kept)
    (block,) = blocks(pa.array(["a b c d " * 40, "a b c"], pa.large_string()))
    every = [np.full(1 << (module.FIELD_BITS - 6), ~np.uint64(0))] * 3
    gc.collect()
    gc.disable()
    try:
        for exact in (False, True):
            phrases = [n for _, _, count in module.mined(words_of(block, np.zeros(2, np.uint64)), every, 4, exact) for n in count.tolist()]
            assert sum(phrases) == (157 if not exact else 157 + 158 + 1 + 159 + 2)
        assert [ref() for ref in made] == [None, None]
    finally:
        gc.enable()
