import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm.blocks import blocks, utf8
from millrace.llm.byte_bpe import LONG, ByteBpe
from millrace.llm.token_counts import parts, token_counts

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")

ODD = ["", " ", "a", "don't they'll 's 's's 'st '''s a 's \n's  's", "<|endoftext|>", "a<|endoftext|>  b<|endoftext|>", " x  \n\n y\t z   ", "<|endoftext", "|>", "'", "'r", "'re", "x'v", "e", "▁x", "a\0b", "　 x \r\n"]


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(open(PATH, encoding="utf-8").read())


def by_library(texts, special):
    library = tokenizers.Tokenizer.from_file(PATH)
    library.encode_special_tokens = not special
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    units = [*"aAbst're'vell  \n\t1 2!\"é中文Ж٣²　 ̀", "<|endoftext|>", "'s", "'ll", "\U0001f600"]
    anywhere = ["".join(chr(rng.randrange(0x3000) if rng.random() < 0.7 else rng.randrange(0xE000, 0x110000)) for _ in range(30)) for _ in range(n // 8)]
    return ["".join(rng.choice(units) for _ in range(rng.randrange(60))) for _ in range(n)] + anywhere


@pytest.mark.parametrize("special", [True, False])
def test_tokens_are_the_library_s(bpe, special):
    rng = random.Random(2)
    long = ["a" * 5000, "ab" * 3000 + " x", "".join(rng.choice("abcdefgh") for _ in range(9000)), "中文字" * 900, "x" * LONG + " " + "x" * (LONG + 1)]
    texts = ODD + random_texts(4000) + long
    want, at = by_library(texts, special), 0
    for block in blocks(pa.array(texts, pa.large_string()), 1 << 14):
        got, counts = bpe.encoded(block, special), bpe.counts(block, special)
        for i in range(block.rows):
            assert got.ids[got.first[i] : got.first[i + 1]].tolist() == want[at] and counts[i] == len(want[at])
            at += 1
    assert at == len(texts)


def test_long_sequences_merge_alike_with_rounds_and_with_a_heap(bpe):
    rng = random.Random(3)
    for text in [*("".join(rng.choice("abcdeth") for _ in range(n)) for n in (2, 3, 40, 700)), "aaaaaaaaa", "the" * 200]:
        symbols = bpe.alphabet[np.frombuffer(text.encode(), np.uint8)]
        by_rounds, size = bpe.merged(symbols.copy(), np.array([len(symbols)]))
        assert by_rounds.tolist() == bpe.merged_by_heap(symbols.tolist()) and size.tolist() == [len(by_rounds)]


def test_parts_of_long_texts_add_up(bpe):
    texts = ["", "x" * 700, "", "word and, more  words 's\n " * 90, "", "y " * 300, "tail"]
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    whole, cut = np.zeros(len(texts), int), np.zeros(len(texts), int)
    for limit, out in ((1 << 20, whole), (64, cut)):
        for block, own in parts(data, offsets, limit):
            np.add.at(out, own, bpe.counts(block))
    assert cut.tolist() == whole.tolist() == [len(t) for t in by_library(texts, True)]
    assert sum(block.rows for block, _ in parts(data, offsets, 64)) > len(texts)


def test_token_counts(spark):
    texts = [*ODD, None, "word " * 400_000, "z" * 30_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, PATH).collect()}
    sizes = [len(t) for t in by_library([t or "" for _, t, _ in rows], True)]
    assert got == {(i, len((t or "").encode()), n, n > 1024) for (i, t, _), n in zip(rows, sizes)}
    assert token_counts(df, PATH).count() == len(rows)
    assert token_counts(df.where(F.lit(False)), PATH).count() == 0
