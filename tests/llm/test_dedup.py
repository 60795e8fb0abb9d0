"""Substring and near-duplicate operators against brute force, and their defined cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from millrace.llm.components import components
from millrace.llm.simhash import BKTree, forest, near_duplicates, links, one_of_each_group
from millrace.llm.substring_dedup import repeated_words_removed
from millrace.llm.suffix_dedup import multikey_quicksort, repeated_bytes_removed

SCHEMA = "doc_id long, text string, runs string, t1 string, kept string"


def table(spark, rows, parts=3):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", None, "y") for i, t in rows], SCHEMA).repartition(parts)


def mixed_rows(seed, alphabet, joint):
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 300))) for _ in range(12)]
    rows = [(100, None), (101, ""), (102, "ab" * 90), (103, "ab" * 50), (104, base[0]), (105, base[0]), (106, "q " * 4000)]
    for i in range(40):
        parts = [base[r.randrange(12)][r.randint(0, 60) : r.randint(60, 300)] + "".join(r.choice(joint) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 4))]
        rows.append((i, "".join(parts)))
    return rows


def bytes_by_force(rows, size):
    seen = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for s in range(len(b) - size + 1):
            seen[b[s : s + size]] += 1
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for s in range(len(b) - size + 1):
            if seen[b[s : s + size]] > 1:
                gone[s : s + size] = [True] * size
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def words_by_force(rows, size):
    seen, texts = {}, [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    for i, w in texts:
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            seen[k] = min(seen.get(k, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if seen[tuple(w[s : s + size])] < i:
                gone[s : s + size] = [True] * size
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(c for c, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def test_repeated_bytes(spark):
    rows = mixed_rows(5, "abcdé ", "xyz")
    for size, gram in ((20, 8), (50, 25)):
        got = repeated_bytes_removed(table(spark, rows), length=size, gram=gram).drop("kept").collect()
        assert sorted(map(tuple, got)) == bytes_by_force(rows, size)


def test_repeated_bytes_within_one_text_and_over_one_hot_passage(spark):
    passage = "the passage that every document shares, long enough to be found in all. " * 4
    rows = [(i, f"{i} starts {hashlib.sha256(str(i).encode()).hexdigest()} {passage} ends {i * 7}") for i in range(200)] + [(500, "once " + passage + passage)]
    got = repeated_bytes_removed(table(spark, rows, 8)).drop("kept").collect()
    assert sorted(map(tuple, got)) == bytes_by_force(rows, 200)


def test_repeated_words(spark):
    rows = mixed_rows(6, ["a", "b ", "é ", " ", "\n", "\x1c"], ["x ", "y ", "z "])
    for size, gram in ((13, 6), (5, 3)):
        got = repeated_words_removed(table(spark, rows), length=size, gram=gram).drop("kept").collect()
        assert sorted(map(tuple, got)) == words_by_force(rows, size)


def test_repeated_words_over_one_hot_passage(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"s{i} {passage} e{i}") for i in range(300)]
    got = repeated_words_removed(table(spark, rows, 8)).drop("kept").collect()
    assert sorted(map(tuple, got)) == words_by_force(rows, 13)


def test_rows_that_repeat_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = repeated_words_removed(table(spark, [(1, text), (1, text), (None, text), (2, text)])).drop("kept").collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 30)]
    other = " ".join(f"v{i}" for i in range(90))
    got = repeated_bytes_removed(table(spark, [(1, text * 3), (1, text * 3), (None, text * 3), (None, other), (None, None), (2, other), (3, other[:150])])).collect()
    assert sorted((r.doc_id or 0, r.n_bytes > 0 and r.n_removed == r.n_bytes) for r in got) == [(0, False), (0, True), (0, True), (1, True), (1, True), (2, True), (3, False)]
    assert sum(r.doc_id is None for r in got) == 3


def two_texts():
    r = random.Random(11)
    long = [" ".join(f"w{r.randint(0, 999)}" for _ in range(400)) for _ in range(3)]
    return [(1, long[0]), (1, "tiny"), (1, long[1]), (2, long[0] + " end"), (2, "x y z"), (2, long[1][:900]), (3, long[2]), (3, long[2]), (2, None)]


def test_an_id_with_several_texts(spark):
    rows = two_texts()
    for largest in (4096, 3):
        got = repeated_bytes_removed(table(spark, rows), largest=largest).drop("kept").collect()
        assert sorted(map(tuple, got)) == bytes_by_force(rows, 200)
        got = repeated_words_removed(table(spark, rows), largest=largest).drop("kept").collect()
        assert sorted(map(tuple, got)) == words_by_force(rows, 13)


def test_words_and_strings_that_simple_hashes_take_for_equal(spark):
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    lead = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{lead} {a}"), (2, f"{lead} {b}"), (3, f"{b} {lead} {b}")]
    got = repeated_words_removed(table(spark, rows)).drop("kept").collect()
    assert sorted(map(tuple, got)) == words_by_force(rows, 13)
    got = repeated_bytes_removed(table(spark, rows), length=1000, gram=500).drop("kept").collect()
    assert sorted(map(tuple, got)) == bytes_by_force(rows, 1000)


def test_anchors_with_very_many_contexts(spark):
    r, common = random.Random(12), " ".join(f"c{i}" for i in range(11))
    rows = [(i, f"{r.randint(0, 3)} p{r.randint(0, 3)} {common} s{r.randint(0, 3)} {r.randint(0, 3)} u{i}") for i in range(150)]
    rows += [(500 + i, "start of the line number {} ".format(i % 7) + "that has a common middle part of over one hundred bytes and more, in all of the documents here, " * 1 + f"ending {i % 5} {'x' * 80} {i}") for i in range(60)]
    for largest in (4096, 10):
        got = repeated_words_removed(table(spark, rows), largest=largest).drop("kept").collect()
        assert sorted(map(tuple, got)) == words_by_force(rows, 13)
        got = repeated_bytes_removed(table(spark, rows), largest=largest).drop("kept").collect()
        assert sorted(map(tuple, got)) == bytes_by_force(rows, 200)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for found in (repeated_bytes_removed(empty), repeated_words_removed(empty), near_duplicates(empty)):
        assert found.count() == 0


def test_multikey_quicksort_orders_by_all_tokens():
    rng = np.random.default_rng(0)
    tokens = [rng.integers(0, 4, 500), rng.integers(0, 4, 500), rng.integers(0, 4, 500)]
    order, heads = multikey_quicksort(tokens)
    rows = list(zip(*tokens))
    assert [rows[i] for i in order] == sorted(rows)
    assert heads[2].sum() == len(set(rows)) and heads[0].sum() == len(set(tokens[0].tolist()))


def fingerprint_by_force(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_force(values, radius=3):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def test_near_duplicates(spark):
    r = random.Random(2)
    base = [" ".join(f"w{r.randint(0, 500)}" for _ in range(120)) for _ in range(8)]
    rows = [(900, None), (901, ""), (902, "A b"), (903, "a  b"), (904, "a b c"), (905, "É É"), (906, " \t\n")]
    for i in range(60):
        words = base[i % 8].split()
        for _ in range(r.randint(0, 2)):
            words[r.randrange(120)] = f"x{r.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r for r in near_duplicates(table(spark, rows)).collect()}
    rows.sort()
    values = [fingerprint_by_force(t) for _, t in rows]
    assert [int(got[i].fingerprint, 16) for i, _ in rows] == values
    assert [got[i].component_id for i, _ in rows] == [rows[g][0] for g in groups_by_force(values)]
    kept = {r.doc_id for r in one_of_each_group(table(spark, rows).withColumnRenamed("t1", "_gone")).collect()}
    assert kept == {r.component_id for r in got.values()}


def test_links_of_dense_fingerprints_that_cross_tasks(spark):
    rng = np.random.default_rng(1)
    values = set()
    for b in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(60):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(k)
            values.add(x)
    values = sorted(values)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    groups = groups_by_force(values)
    for largest in (4096, 12):  # with the smaller bound, keys are keyed anew
        stars = {r.a: r.b for r in components(links(spark.createDataFrame([(x,) for x in signed], "fingerprint long").repartition(5), largest=largest)).collect()}
        got, want = defaultdict(set), defaultdict(set)
        for i, (x, g) in enumerate(zip(signed, groups)):
            got[stars.get(x, x)].add(i)
            want[g].add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(5, a), (5, b), (3, a), (None, b), (None, "neither one nor the other"), (3, a)]
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in near_duplicates(table(spark, rows)).collect())
    h = {t: f"{fingerprint_by_force(t):016x}" for _, t in rows}
    # Both texts of id 5 are documents of that id; a row without id has its text's component.
    assert got == sorted([(5, h[a], 3), (5, h[b], 5), (3, h[a], 3), (3, h[a], 3), (0, h[b], 5), (0, h[rows[4][1]], 0)])


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 12, 400, dtype=np.uint64))
    found = {(int(p), int(q)) for p, near in BKTree(values).within(values, 2) for q in near}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 2}
    assert found == want


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id + 1 as a", "id as b")
    assert {(r.a, r.b) for r in components(edges).collect()} == {(i, 0) for i in range(1, 201)}


def groups_of(values, edges):
    parent = {int(v): int(v) for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[root(int(a))] = root(int(b))
    groups = defaultdict(set)
    for v in parent:
        groups[root(v)].add(v)
    return sorted(map(sorted, groups.values()))


def test_forest_spans_the_links_within_a_tree_and_between_two():
    rng = random.Random(3)
    found = set()
    for _ in range(20):
        base = rng.getrandbits(63)
        for _ in range(15):
            v = base
            for _ in range(rng.randint(0, 5)):
                v ^= 1 << rng.randint(0, 63)
            found.add(v)
    values = np.array(sorted(found), np.uint64)

    def near(left, right):
        return [(a, b) for a in left for b in right if (int(a) ^ int(b)).bit_count() <= 3]

    assert groups_of(values, zip(*forest(values, None, 3))) == groups_of(values, near(values, values))
    left, right = values[::2], values[1::2]
    assert groups_of(values, zip(*forest(left, right, 3))) == groups_of(values, near(left, right))
    dense = np.arange(1 << 12, dtype=np.uint64)
    assert len(forest(dense, None, 3)[0]) == len(dense) - 1


def test_fingerprints_do_not_depend_on_how_many_shingles_are_held(monkeypatch):
    import random

    from millrace.llm import simhash

    r = random.Random(1)
    texts = [" ".join(r.choice("ab cd ef gh i".split()) for _ in range(n)).encode() for n in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 700)]
    want = [simhash.fingerprint(t) for t in texts]
    for n in (1, 4):
        monkeypatch.setattr(simhash, "TOGETHER", n)
        assert [simhash.fingerprint(t) for t in texts] == want
