"""The pipeline's near copies: planted similarities, and brute force over small sets."""

import random

import numpy as np

import corpus_pipeline
from millrace.llm import near_copies
from millrace.llm.near_copies import one_of_each_copy, spanning

DOCS = "doc_id long, text string, _gone long"


def words(r, n):
    return ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(n)]


def jaccard(x, y):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (x.lower().split(), y.lower().split()))
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(r, text, edits):
    """With single words replaced far apart, five shingles each."""
    out = list(text)
    for at in range(10, 10 + 8 * edits, 8):
        out[at] = words(r, 1)[0]
    return out


def planted():
    r, rows, gone, near = random.Random(5), [], set(), []
    for i in range(60):
        base = words(r, 240)
        copy = edited(r, base, 1 + i % 5)
        rows += [(i, " ".join(base)), (1000 + i, "  ".join(copy).upper()), (2000 + i, " ".join(edited(r, base, 12)))]
        near.append(jaccard(rows[-3][1], rows[-2][1]))
        gone.add(1000 + i)
        assert jaccard(rows[-3][1], rows[-1][1]) < 0.8
    assert 0.8 <= min(near) < 0.82 and 0.95 < max(near)
    return rows, gone


def test_stage_removes_copies_of_similarity_four_fifths_and_no_others(spark, tmp_path):
    rows, gone = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, str(tmp_path)).collect()}
    assert {i for i, _ in rows} - kept == gone


def test_slices_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SLICE", 200)
    r, base = random.Random(6), words(random.Random(7), 240)
    rows = [(i, " ".join(edited(r, base, 1)), None) for i in range(30)] + [(100, " ".join(words(r, 99)), None)]
    assert {x.doc_id for x in one_of_each_copy(spark.createDataFrame(rows, DOCS)).collect()} == {0, 100}


def test_defined_cases(spark):
    rows = [(1, None), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (None, "one two"), (6, "a b c d e f"), (6, "g h i j k l"), (7, "g h i j k l")]
    kept = [(x.doc_id, x.text) for x in one_of_each_copy(spark.createDataFrame([(*x, None) for x in rows], DOCS)).collect()]
    assert sorted(kept, key=str) == sorted([rows[i] for i in (0, 2, 4, 5, 6, 7)], key=str)
    assert one_of_each_copy(spark.createDataFrame([], DOCS)).count() == 0


def test_spanning_against_all_pairs():
    r = random.Random(8)
    for _ in range(30):
        sets = [np.array(sorted(r.sample(range(14), r.randint(8, 13))), np.uint64) for _ in range(25)]
        a, b = spanning(sets)
        held = [set(x.tolist()) for x in sets]
        pairs = [(x, y) for x in range(25) for y in range(x) if len(held[x] & held[y]) * 5 >= 4 * len(held[x] | held[y])]

        def labels(edges):
            label = list(range(25))
            for x, y in edges:
                label = [label[x] if v == label[y] else v for v in label]
            return [label.index(v) for v in label]

        assert labels(zip(a, b)) == labels(pairs) and all((max(p), min(p)) in pairs for p in zip(a, b))
