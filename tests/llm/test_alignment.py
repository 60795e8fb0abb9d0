import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm.byte_bpe import byte_symbols
from millrace.llm.token_alignment import most_pairs, pieces, token_alignment
from millrace.llm.token_counts import vocabulary

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def by_plain_loops(texts):
    """The rows of the contract, from whole texts by the libraries."""
    library = tokenizers.Tokenizer.from_file(A)
    library.encode_special_tokens = True
    other, symbols = sentencepiece.SentencePieceProcessor(model_file=B), byte_symbols()
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        a = [(i, bytes(symbols[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if other.is_byte(i) else p.replace("▁", " ").encode()) for i in other.encode(text) for p in [other.id_to_piece(i)]]
        whole = (" " + text).encode()
        docs.append((a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None)
    counts, held = Counter(), []
    for doc in docs:
        if doc is None:
            held.append(None)
            continue
        ends = [defaultdict(list), defaultdict(list)]
        for side, tokens in enumerate(doc):
            at = 0
            for i, x in tokens:
                at += len(x)
                ends[side][at].append(i)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(x, y) for c in cuts for x in ends[0][c] for y in ends[1][c]]
        counts.update(links)
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for e in sorted(side) if last < e <= c for i in side[e]) for side in ends))
            last = c
        held.append((links, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    rows = []
    for doc, h in zip(docs, held):
        if h is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links, told = h
        rows.append((len(doc[0]), len(doc[1]), told.count(";") + 1, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(told.encode()).hexdigest()))
    return rows


TEXTS = [
    None, "", " ", "  ", "a ", "Hello world, hello  world", "▁x", "a ▁ b", "<|endoftext|> plain", "<s>x</s> <0x41>", "naïve 中文字 é", "tab\tand\nline\r\n", "a\0b", "　wide", "Donaudampfschiff " * 30,
    "x" * 3000, "don't they'll  'tis", "\U0001f600 smile \U0001f600", "the cat sat on the mat. " * 400, " leading", "trailing \n",
]


def test_rows_are_those_of_plain_loops(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "again"), (None, "no id here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3)
    want = by_plain_loops([t for _, t, _ in rows])
    got = Counter(tuple(r)[:8] for r in token_alignment(df, A, B).collect())
    assert got == Counter((i, *w[:2], w[2], w[3], w[4], w[5], w[6]) for (i, _, _), w in zip(rows, want))
    assert token_alignment(df.where(F.lit(False)), A, B).count() == 0


def test_random_texts_and_long_ones_in_parts(spark, monkeypatch):
    from test_tokens import random_texts

    from millrace.llm import token_alignment as module

    texts = random_texts(120, 5) + ["alpha beta  gamma. " * 200, "q" * 500 + " " + "r" * 500]
    want = by_plain_loops(texts)
    a, b = vocabulary(open(A, encoding="utf-8").read()), pieces(open(B, "rb").read())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.large_string())], names=["doc_id", "text"])
    whole = module._aligned_batch(batch, a, b)
    monkeypatch.setattr(module, "PART", 64)
    assert module._aligned_batch(batch, a, b).equals(whole)
    monkeypatch.setattr(module, "PART", 1 << 19)
    for chunk in (20, 500):
        monkeypatch.setattr(module, "CHUNK", chunk)
        assert module._aligned_batch(batch, a, b).equals(whole)
    assert [b.num_rows for b in module._slices(batch)] == [len(texts)]
    assert whole.column("groups_sha256").to_pylist() == [w[6] for w in want]
    assert [len(x) // 4 for x in whole.column("link_a").to_pylist()] == [w[3] for w in want]


def test_overlaps_are_the_tokens_less_the_meetings(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in token_alignment(df, A, B).collect():
        assert r.n_overlaps == max(r.n_a + r.n_b - r.n_groups, 0) and r.n_links == r.n_groups


def test_pairs_have_a_bound():
    a, b = vocabulary(open(A, encoding="utf-8").read()), pieces(open(B, "rb").read())
    own, other = set(a.bytes.values()), set(b.bytes)
    ends = sum(x[-n:] in own for x in b.bytes for n in range(1, len(x) + 1)) + 2 * sum(x[-n:] in other for x in own for n in range(1, len(x) + 1))
    assert ends <= most_pairs(a, b) < 1_500_000
