"""Trained operators: held-out accuracy and defined cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from millrace.llm.blocks import blocks

from millrace.llm.compression_quality import dictionary, scored
from millrace.llm.language_id import UNKNOWN, evidence, fit, identified, language_accepted, means, predicted
from millrace.llm.linear import bounded_sample, stretches
from millrace.llm.license_scan import TEMPLATES, Classifier, _block, _words, licensed_paragraphs

SYLLABLES = {"en": "the ing tion and er on re".split(), "de": "sch ung ver ich keit ein der".split(), "fr": "eau que ment ais oux le é".split(), "es": "ción os ar ña dad el ll".split()}
DOCS = "doc_id long, text string, lang string, _lang_pred string, score double"


def prose(lang, seed, words=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(words))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 0.5) for i, t, lang in rows], DOCS)


def test_languages_on_held_out_texts(spark):
    rows = [(k * 100 + i, prose(lang, i), lang) for k, lang in enumerate(SYLLABLES) for i in range(60)]
    train, test = [r for r in rows if r[0] % 4], [r for r in rows if not r[0] % 4]
    edges = [(-1, None, "en"), (-2, "", None), (-3, "12 34 !?", "fr"), (-4, "é", None), (-5, prose("de", 1, 40_000), None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in predicted(docs(spark, test + edges), docs(spark, train)).collect()}
    assert sum(got[i][0] == lang for i, _, lang in test) >= 0.95 * len(test)
    assert all(got[i] == (UNKNOWN, 0.0) for i in (-1, -2, -3)) and got[-4][0] in SYLLABLES and got[-5][0] == "de"
    assert all(0 <= s <= 1 for _, s in got.values())


def test_languages_without_and_with_one_label(spark):
    df = docs(spark, [(1, "some text", None), (2, None, None)])
    assert {r.lang_pred for r in predicted(df, df).collect()} == {UNKNOWN}
    one = predicted(df, docs(spark, [(3, "text", "en")])).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in one) == [(1, "en", 1.0), (2, UNKNOWN, 0.0)]


def test_accepted_rows_keep_their_columns(spark):
    df = docs(spark, [(k * 100 + i, prose(lang, i), lang) for k, lang in enumerate(SYLLABLES) for i in range(8)] + [(-1, None, None), (-2, "123", "en")])
    out = language_accepted(df)
    assert out.columns == df.columns and {r.doc_id for r in df.collect()} - {r.doc_id for r in out.collect()} == {-1, -2}
    assert identified(df, df).columns[-3:] == ["_lang_pred_", "_score", "_evidence"]


OTHERS = (
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "x9f#q zzkq 77qqx!! vbnm,,.. qwpoeiru zmxncb 1029 kjhg lkjs wqxz vvkp jjqw xxzk pqzj wvxk",
)


def test_other_languages_and_junk_are_rejected_and_clean_texts_stay(spark):
    clean = [(k * 1000 + i, prose(lang, i, 10 + 40 * (i % 5)), lang) for k, lang in enumerate(SYLLABLES) for i in range(100)]
    noisy = [(9000 + i, f"{prose('de', i, 12)} token = {hashlib.sha256(bytes([i])).hexdigest()} +1 (555) 555-{i:04}", None) for i in range(20)]
    others = [(-1 - i, t, None) for i, t in enumerate(OTHERS)]
    twice = [(-9, OTHERS[0], None)] * 2 + [clean[0]]
    kept = [r.doc_id for r in language_accepted(docs(spark, clean + noisy + others + twice)).collect()]
    assert Counter(kept) == Counter(i for i, _, _ in clean + noisy + [clean[0]])


def test_margins_against_a_plain_sum(spark):
    texts = [prose(lang, i, 40) for lang in SYLLABLES for i in range(6)] + ["", "ab", "Abc", "é"]
    languages = [lang for lang in SYLLABLES for _ in range(6)] + ["en"] * 4
    model = fit(texts, languages)
    weights = np.column_stack([m.weights for m in model.machines()])
    (block,) = blocks(pa.array(texts, pa.large_string()), 1 << 30)
    want, known = [], []
    for text, lang in zip(texts, languages):
        b = text.encode().lower()
        grams = [(b[k : k + 3], ((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 2654435761 % 2**32) >> 19) for k in range(len(b) - 2)]
        want.append(np.mean([weights[c] for _, c in grams], axis=0) if grams else np.zeros(weights.shape[1]))
        known.append(sum(model.profiles[model.languages.index(lang), c] for g, c in grams if all(x > 127 or chr(x).isalpha() or chr(x).isspace() for x in g)))
    assert np.allclose(means(weights, block), want)
    assert np.allclose(evidence(model.profiles, np.searchsorted(model.languages, languages), block), known)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for found in (predicted(empty, empty), scored(empty, labels), licensed_paragraphs(empty.select("doc_id", "text"))):
        assert found.count() == 0


def test_quality_on_held_out_texts(spark):
    rows = [(i, prose("en", i, 80) if i % 2 else " | ".join(prose("en", i, 3).upper() + "%%%" for _ in range(20)), "en") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200) if i % 5] + [(None, 1), (5000, None)], "doc_id long, quality int")
    edges = [(-1, None, None), (-2, "", None), (-3, prose("en", 7, 30_000), None)]
    got = {r.doc_id: r for r in scored(docs(spark, rows + edges), labels).collect()}
    held = [i for i in range(200) if i % 5 == 0]
    assert all((got[i].score >= 0.5) == bool(i % 2) for i in held)
    assert got[-1].score == got[-2].score and got[-3].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_quality_scores_against_plain_compression(spark):
    rows = [(i, prose("en", i, 40 + i) if i % 2 else "%% | " * (30 + i) + prose("fr", i, 5), "en") for i in range(60)]
    labels = [(i, i % 2) for i in range(0, 60)]
    got = {r.doc_id: r.score for r in scored(docs(spark, rows + [(99, prose("en", 1, 3000), "en")]), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    texts = {i: t.encode() for i, t, _ in rows} | {99: prose("en", 1, 3000).encode()}
    good, bad = ([texts[i] for i, q in labels if q == k] for k in (1, 0))
    books = [zstandard.ZstdCompressionDict(dictionary(half[::2]), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for half in (good, bad)]

    def features(text):
        sizes = [sum(len(zstandard.ZstdCompressor(level=3, dict_data=b, write_checksum=False, write_content_size=False, write_dict_id=False).compress(text[k : k + 4096])) for k in range(0, len(text), 4096)) for b in books]
        share = len(text) / (len(text) + 100)
        return [20 * share * (sizes[1] - sizes[0]) / sum(sizes), 20 * share * max(0.25 - min(sizes) / len(text), 0)]

    x, y = np.array([features(t) for half in (good, bad) for t in half[1::2]]), np.array([1.0] * 15 + [0.0] * 15)
    w = np.zeros(3)
    for _ in range(60):  # Newton's method, with the same penalty
        z = np.column_stack((x, np.ones(len(x))))
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.eye(3), z.T @ (y - p) - w)
    for i, t in texts.items():
        assert abs(got[i] - 1 / (1 + np.exp(-(np.array(features(t)) @ w[:2] + w[2])))) < 1e-6


def test_quality_of_repeated_rows(spark):
    rows = [(i, prose("en", i, 50) if i % 2 else "$ " * 60, "en") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 1)], "doc_id long, quality int")
    once = {r.doc_id: r.score for r in scored(docs(spark, rows), labels).collect()}
    twice = scored(docs(spark, rows + rows[:6]), labels).collect()
    assert len(twice) == 26 and all(r.score == once[r.doc_id] for r in twice)


def test_quality_without_labels(spark):
    got = scored(docs(spark, [(1, "a", None)]), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 1)]


def test_licences(spark):
    notices = [(family, t) for family, texts in TEMPLATES.items() for t in texts]
    rows = [(i, f"{prose('en', i)}\n{t}\r\n{prose('fr', i)}", "en") for i, (_, t) in enumerate(notices)]
    plain = [(1000 + i, prose(lang, i) + "\n" + prose(lang, i + 1), lang) for i in range(40) for lang in SYLLABLES]
    edges = [(-1, None, None), (-2, "", None), (-3, "\n\n", None), (-4, "x " * 20_000, None), (-5, "ALL RIGHTS RESERVED!", None), (-5, "ALL RIGHTS RESERVED!", None)]
    found = licensed_paragraphs(docs(spark, rows + plain + edges)).where("confirmed").collect()
    got = {(r.doc_id, r.family, r.paragraph) for r in found}
    want = {(i, family, 1) for i, (family, _) in enumerate(notices)}
    assert len(want & got) >= 0.9 * len(want)
    assert not any(r.doc_id >= 1000 for r in found)
    assert [r.family for r in found if r.doc_id == -5] == ["proprietary"] * 2


def test_licence_probabilities_hold_on_templates_that_the_fit_has_not_seen():
    model = Classifier([prose(lang, i, 12) for i in range(80) for lang in SYLLABLES])
    p, truth = model.held
    sure, right = p.max(axis=1), p.argmax(axis=1) == truth
    assert len(set(truth.tolist())) >= 10 and right.mean() >= 0.9
    for low, high in ((0.3, 0.9), (0.9, 1.01)):
        on = (sure >= low) & (sure < high)
        assert abs(sure[on].mean() - right[on].mean()) <= 0.15
    licence, plain = truth > 0, truth == 0
    assert (p[plain].argmax(axis=1) == 0).all() and (p[licence].argmax(axis=1) > 0).mean() >= 0.9


def test_licence_probabilities_against_plain_sums():
    model = Classifier([prose(lang, i, 12) for i in range(20) for lang in SYLLABLES])
    lines = ["Released under the MIT License.", "plain words of no licence", "x", "Licensed under CC BY 4.0. " * 3, ""]
    family, sure = model.predict(_block(lines))
    m = 2**64

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % m
        x = (x ^ x >> 27) * 0x94D049BB133111EB % m
        return x ^ x >> 31

    def judged(codes, size):
        z = [(sum(model.weights[c, k] for c in codes) / max(3 * size, 1) ** 0.5 + model.bias[k]) / model.temperature for k in range(len(model.families))]
        e = np.exp(np.array(z) - max(z))
        return int(e.argmax()), float(e.max() / e.sum())

    for line, f, p in zip(lines, family, sure):
        words, codes = [int(h) for h in _words(line)], []
        for n in (1, 2, 3):
            for i in range(len(words) - n + 1):
                h = words[i]
                for j in range(1, n):
                    h = (h * 0xD6E8FEB86659FD93 + words[i + j]) % m
                codes.append(mixed(h) >> 50)
        best, share = judged(codes, len(words))
        if best and share >= 0.5 and words:
            best, share = judged(set(codes), len(set(codes)) / 3)
        want = best if share >= 0.5 and words else 0
        assert f == want and abs(p - share) < 1e-9


def test_wrapped_notices_are_one_paragraph(spark):
    notice = TEMPLATES["mit"][2].split()
    wrapped = "\n".join(" ".join(notice[i : i + 9]) for i in range(0, len(notice), 9))
    df = spark.createDataFrame([(1, f"{prose('en', 1)}\n\n{wrapped}\n\n{prose('en', 2)}", "gpl"), (1, TEMPLATES["mit"][0], None)], "doc_id long, text string, family string")
    found = sorted((r.doc_id, r.paragraph, r.family) for r in licensed_paragraphs(df).where("confirmed").collect())
    assert found == [(1, 0, "mit"), (1, 2, "mit")]


def test_samples_are_bounded_under_repeated_rows(spark):
    df = spark.createDataFrame([("same text", "a")] * 2000 + [(f"text {i} " + "x" * (i % 7) * 9000, "a") for i in range(8000)] + [("b text", "b")], "text string, label string").repartition(7)
    picked = bounded_sample(df, "label", 400, "text", 2000)
    counts = Counter(r.label for r in picked)
    assert counts["b"] == 1 and 100 <= counts["a"] <= 400
    assert max(len(r.text) for r in picked) <= 2100
    assert picked == bounded_sample(df.repartition(3), "label", 400, "text", 2000)


def test_stretches_reach_both_ends(spark):
    text = "a" * 5000 + "b" * 90_000 + "c" * 5000
    got = spark.createDataFrame([(text,), ("short",), (None,), ("",)], "text string").select(stretches(F.col("text"), 4096).alias("t")).collect()
    assert [r.t for r in got[1:]] == ["short", None, ""]
    assert set(got[0].t) == set("abc\n") and len(got[0].t) <= 4200


def test_agreement_with_templates_of_few_words():
    model = Classifier(["some plain words here and there", "nothing of note in this one line"] * 20)
    proprietary = model.families.index("proprietary")
    assert model.agreement(proprietary, _words("Copyright 2020 Foo Inc. All rights reserved.")) == 1.0
    assert model.agreement(proprietary, _words("All the rights of others are reserved here.")) < 0.8


def test_families_are_learnt_from_profiles():
    from millrace.llm.language_id import families

    rng = np.random.default_rng(1)
    roots = rng.random((3, 50)) ** 4
    shares = np.array([roots[i % 3] + 0.1 * rng.random(50) for i in range(9)])
    shares /= shares.sum(axis=1, keepdims=True)
    names = [f"l{i}" for i in range(9)]
    assert sorted(families(names, shares).values()) == [[f"l{i}" for i in range(k, 9, 3)] for k in range(3)]
    assert families(["x"], np.ones((1, 5)) / 5) == {"x": ["x"]} and families([], np.zeros((0, 5))) == {}
    assert all(len(v) <= 5 for v in families([f"m{i:02}" for i in range(20)], np.ones((20, 5)) / 5).values())
