"""Whole notices however they are wrapped, licences that are not listed, and the whole result against plain loops."""

import textwrap

import numpy as np
import pytest

from millrace.llm import license_scan as scan
from millrace.llm.license_scan import OTHERS, SIMILARITY, TEMPLATES, Classifier, _words, licensed_paragraphs, stretches
from test_classifiers import SYLLABLES, docs, prose

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
SHORT = ("SPDX", "Released", "This project", "This work", "This library is licensed")
HEADERS = {"apache-2.0": APACHE} | {f: "\n\n".join(t for t in TEMPLATES[f] if not t.startswith(SHORT)) for f in ("mit", "bsd", "gpl", "lgpl", "mpl-2.0")}
UNLISTED = {
    "agpl": OTHERS[0],
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
}


def wrapped(text, width, mark):
    lines = [line for p in text.split("\n\n") for line in (*textwrap.wrap(p, width), "")][:-1]
    return "\n".join((mark + line).rstrip() for line in lines)


@pytest.fixture(scope="module")
def model():
    return Classifier([prose(lang, i, 12) for i in range(80) for lang in SYLLABLES])


def test_full_headers_at_any_width_are_one_confirmed_paragraph(spark):
    cases = [(f, w, mark) for f in HEADERS for w in (60, 72, 100) for mark in ("", "# ", " * ", "// ")]
    rows = [(i, f"{prose('en', i)}\n{prose('fr', i)}\n\n{wrapped(HEADERS[f], w, mark)}\n\n{prose('de', i)}\n{prose('en', i + 1)}", "en") for i, (f, w, mark) in enumerate(cases)]
    plain = [(1000 + i, "\n".join(prose(lang, i + k) for k in range(6)), lang) for i in range(40) for lang in SYLLABLES]
    found = licensed_paragraphs(docs(spark, rows + plain)).collect()
    assert not any(r.doc_id >= 1000 and r.confirmed for r in found)
    for i, (family, width, mark) in enumerate(cases):
        own = [r for r in found if r.doc_id == i]
        assert [(r.family, r.confirmed) for r in own] == [(family, True)], (family, width, mark, own)
        size = wrapped(HEADERS[family], width, mark).count("\n") + 1
        assert own[0].lines >= 0.6 * size and 3 <= own[0].paragraph and own[0].paragraph + own[0].lines <= 3 + size


def test_unlisted_licences_are_unknown_or_unconfirmed(spark):
    rows = [(i, f"{prose('en', i)}\n\n{wrapped(t, w, '')}\n\n{prose('en', i + 1)}", "en") for i, (t, w) in enumerate((t, w) for t in UNLISTED.values() for w in (60, 72, 100))]
    plain = [(1000 + i, "\n".join(prose(lang, i + k) for k in range(6)), lang) for i in range(40) for lang in SYLLABLES]
    assert [r for r in licensed_paragraphs(docs(spark, rows + plain)).collect() if r.confirmed] == []


def test_a_word_that_a_template_holds_confirms_nothing(model):
    mit = model.families.index("mit")
    assert model.agreement(mit, _words("Mit.")) < SIMILARITY and model.agreement(mit, _words("License: MIT")) == 1.0


def test_calibration_with_unlisted_licences(model):
    """The mean probability of what is held back, sentences of unlisted licences among it, is near the share that is right."""
    p, truth = np.vstack((model.held[0], model.unlisted)), np.append(model.held[1], np.zeros(len(model.unlisted), int))
    sure, right = p.max(axis=1), p.argmax(axis=1) == truth
    assert len(model.unlisted) > 20 and abs(sure.mean() - right.mean()) <= 0.08


def test_stretches_are_the_greatest_sums():
    rng = np.random.default_rng(2)
    for _ in range(60):
        e = np.round(rng.normal(-0.4, 1, (rng.integers(1, 14), 3)), 1)
        free, want = [(0, len(e))], []
        while free:
            low, high = free.pop()
            sums = [(float(np.round(e[a:b, f].sum(), 6)), f, a, b) for f in range(3) for a in range(low, high) for b in range(a + 1, high + 1)]
            top = max((s[0] for s in sums), default=0)
            if top > 1e-9:
                want.append((top, low, high))
                a, b = next((a, b) for a, b in stretches(e) if low <= a < b <= high and np.isclose(max(e[a:b].sum(axis=0)), top))
                free += [(low, a), (b, high)]
        assert len(stretches(e)) == len(want)


def by_plain_loops(model, text):
    """Rows of a text: lines in pieces, their evidence gram by gram, the greatest sums, and the judgement."""
    units = []
    for n, line in enumerate(text.split("\n")):
        words = _words(line)
        units += [(n, words[i : i + scan.UNIT]) for i in range(0, len(words), scan.UNIT)]
    every = [int(w) for _, ws in units for w in ws]
    m, evidence, at = 2**64, [], 0

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % m
        x = (x ^ x >> 27) * 0x94D049BB133111EB % m
        return x ^ x >> 31

    for _, ws in units:
        total = np.zeros(len(model.families) - 1)
        for i in range(at, at + len(ws)):
            h = every[i]
            for size in (1, 2, 3):
                if size > 1:
                    if i + size > len(every):
                        break
                    h = (h * 0xD6E8FEB86659FD93 + every[i + size - 1]) % m
                c = mixed(h) >> 50
                total += model.weights[c, 1:] - model.weights[c, 0]
        evidence.append((total / (3 * len(ws)) ** 0.5 + model.bias[1:] - model.bias[0]) / model.temperature)
        at += len(ws)
    on, regions = [i for i, e in enumerate(evidence) if e.max() > 0], []
    for i in on:
        if regions and i - regions[-1][1] <= scan.BRIDGE + 1:
            regions[-1][1] = i
        else:
            regions.append([i, i])
    rows = []
    for a, b in regions:
        for p, q in stretches(np.array(evidence[a : b + 1])):
            words = np.concatenate([ws for _, ws in units[a + p : a + q]])
            rows.append((units[a + p][0], units[a + q - 1][0] - units[a + p][0] + 1, words))
    return rows


def test_the_whole_result_against_plain_loops(spark):
    texts = [f"{prose('en', 1)}\n{wrapped(APACHE, 60, '# ')}\n{prose('en', 2)}", prose("fr", 3, 90) + " Released under the MIT License. " + prose("fr", 4, 90), "All rights reserved.", prose("en", 5), "\n\n", "Licensed under CC BY 4.0.\n" + "\n".join(prose("en", i, 8) for i in range(9)) + "\nLicensed under CC BY 4.0."]
    df, got = docs(spark, [(i, t, "en") for i, t in enumerate(texts)]), {}
    for r in licensed_paragraphs(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    model = Classifier(scan._sample(df))
    for i, text in enumerate(texts):
        want = []
        for line, lines, words in by_plain_loops(model, text):
            size, z, every = len(words), np.zeros(len(model.families)), []
            for n in (1, 2, 3):
                every += [int(x) >> 50 for x in scan.ngrams(words, n)]
            for c in every:
                z += model.weights[c]

            def judged(z, size):
                e = np.exp((z / max(3 * size, 1) ** 0.5 + model.bias) / model.temperature)
                return int(e.argmax()), float(e.max() / e.sum())

            family, p = judged(z, size)
            if family and p >= scan.CERTAIN:
                codes = set(every)
                family, p = judged(sum(model.weights[c] for c in codes), len(codes) / 3)
            if family and p >= scan.CERTAIN:
                best = [max(_share(words, t) for t in model.templates[f]) for f in (model.families[family], scan.UNKNOWN)]
                want.append((line, lines, model.families[family], round(p, 6), round(best[0], 6), best[0] >= SIMILARITY and best[0] >= best[1]))
        rows = sorted((r.paragraph, r.lines, r.family, r.probability, r.agreement, r.confirmed) for r in got.get(i, []))
        assert [r[:3] + r[4:] for r in rows] == [w[:3] + w[4:] for w in sorted(want)] and all(abs(r[3] - w[3]) < 1e-5 for r, w in zip(rows, sorted(want)))
    assert len(got[5]) == 2 and [r.family for r in got[1]] == ["mit"]


def _share(words, template):
    size = max(min(scan.SHINGLE, len(words), len(template)), 1)
    short, long = sorted(({tuple(x[i : i + size].tolist()) for i in range(len(x) - size + 1)} for x in (words, template)), key=len)
    return len(short & long) / len(short) * min(1, len(words) / min(len(template), scan.SHINGLE))
