"""License scans: a trained paragraph classifier, confirmed by template comparison.

Method. A multinomial logistic regression over hashed word one-, two- and
three-grams tells the licence family of a paragraph. Comment marks are no words, so a
wrapped header is its words, and blank lines do not count. Each line of a text (each ``UNIT`` words of a longer one) has
evidence for each family, the model's log-odds against the class ``unknown``, from grams that begin in it and may end in the next; the stretch of lines with the
greatest sum is a paragraph, then the next one among the lines left, while there is a positive sum. So a notice is found whole,
however it is wrapped, and without the prose around it. The classifier then judges
the paragraph as a whole: its family and probability, ``unknown`` below ``CERTAIN``.

It is fitted on the driver from templates, which are the sentences below and notices made of
licence names and forms, whole and in pieces, against sentences of licences that are not listed and a bounded sample of the
corpus's own lines, which stand for the class ``unknown``. Every ``FOLDS``th
sentence with its pieces, every ``FOLDS``th form with all names, and as many of
the corpus's lines are held back from a first fit: on these a temperature
calibrates the probabilities; the model in use is then fitted on everything. A
prediction is confirmed
where a template of the family and the paragraph agree: of the shorter one's
five-word shingles (of all its words, where one has fewer), at least
``SIMILARITY`` stand in the other, and no sentence of an unlisted licence agrees more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import Block, blocks, ngrams
from .decontamination import _WORD_BYTES
from .linear import bounded_sample

UNKNOWN = "unknown"
CERTAIN = 0.5
SHINGLE, SIMILARITY = 5, 0.8
BUCKETS = 1 << 14
#: One sentence, form or line in so many is held back from the first fit.
FOLDS = 4
#: Words of a long line that are looked at together, and lines without evidence that a paragraph may bridge.
UNIT, BRIDGE = 24, 4
#: Words of the pieces of templates that stand for wrapped lines.
LINE = 10
#: Documents whose paragraphs are sampled as unknown, and paragraphs that are fitted on.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 300, 1500

#: Notices and key sentences of common licences (fixed values).
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "bsd": (
        "Released under the 3-clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential.",
    ),
}

#: Sentences of licences that are not listed: the class unknown has seen what licences say (fixed values).
OTHERS = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Boost Software License - Version 1.0 - August 17th, 2003",
    "Distributed under the Boost Software License, Version 1.0.",
    "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software.",
    "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL.",
    "This program is free software. It comes without any warranty, to the extent permitted by applicable law.",
    "Redistributions of any form whatsoever must retain the following acknowledgment: This product includes software developed by the OpenSSL Project.",
    "The contents of this file are subject to the Common Development and Distribution License; you may not use this file except in compliance with it.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3.",
    "The author disclaims copyright to this source code; may you do good and not evil.",
)

#: Names of the licences, as notices give them (fixed values).
NAMES = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache Software License 2.0", "Apache-2.0"),
    "mit": ("MIT License", "MIT/X11 License", "MIT", "Expat (MIT) License"),
    "gpl": ("GNU General Public License, version 3", "GNU GPL v2 or later", "GNU General Public License", "GPL-3.0"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v3", "Lesser GPL", "LGPL-2.1"),
    "bsd": ("3-clause BSD License", "2-clause BSD License", "New BSD License", "BSD-3-Clause"),
    "mpl-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "cc-by": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 3.0"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 3.0"),
    "public-domain": ("Creative Commons Zero", "CC0 1.0 Universal public domain dedication", "Unlicense", "CC0"),
}
#: Forms of notices (fixed values).
FORMS = (
    "Licensed under the {}.", "This work is licensed under the {}.", "Released under the {}.", "This software is distributed under the terms of the {}.",
    "Code in this repository is available under the {}; see the file LICENSE for details.", "The library is covered by the {}.", "All contributions are made under {}.",
    "You may use, copy and share this document under {}.", "Published under {} by the authors.", "License: {}", "Use of these files is governed by the {}.",
    "This project and its documentation are free to use under the {}.", "Text and images are provided under {} unless noted otherwise.", "Dual licensing aside, the package follows the {}.",
)


def all_templates() -> dict[str, list[tuple[str, ...]]]:
    """Of each family its sentences, then for each form the notices that its names make."""
    return {f: [*((t,) for t in texts), *(tuple(form.format(name) for name in NAMES[f]) for form in FORMS if f in NAMES)] for f, texts in TEMPLATES.items()}


_NAMES = ("doc_id", "paragraph", "lines", "family", "probability", "agreement", "confirmed", "line")
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string())


def _plain(block: Block) -> Block:
    return Block(block.first, _WORD_BYTES[block.data], block.starts)


@dataclass
class Units:
    """The lines of a block of texts that have words, long ones in pieces: each one's first word, text, and line in the text."""

    plain: Block
    first: np.ndarray
    text: np.ndarray
    line: np.ndarray

    def words(self, a: int, b: int) -> slice:
        """The words of the units from a to before b."""
        return slice(int(self.first[a]), int(self.first[b]))


def units_of(block: Block) -> Units:
    plain = _plain(block)
    begin, _, first = plain.words
    feeds = np.flatnonzero(block.data == 10)
    line = np.searchsorted(feeds, begin)
    text = np.repeat(np.arange(block.rows), np.diff(first))
    new = np.ones(len(begin), bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    place = np.arange(len(begin)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(begin) else begin
    heads = np.flatnonzero(place % UNIT == 0)
    before = np.searchsorted(feeds, block.starts[:-1])
    return Units(plain, np.append(heads, len(begin)), text[heads], line[heads] - before[text[heads]])


def grams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and paragraph of each word gram that lies in one paragraph, and words of each."""
    words, (_, _, first) = block.word_hashes, block.words
    own = np.repeat(np.arange(block.rows), np.diff(first))
    codes, owners = [], []
    for n in (1, 2, 3):
        g = ngrams(words, n)
        inside = own[: len(g)] == own[n - 1 :] if len(g) else np.zeros(0, bool)
        codes.append((g[inside] >> np.uint64(50)).astype(np.int64))
        owners.append(own[: len(g)][inside])
    return np.concatenate(codes), np.concatenate(owners), np.diff(first)


class Classifier:
    """Weights for each family, a bias for each, and the temperature; class 0 is unknown."""

    def __init__(self, unknown: list[str], templates: dict[str, list[tuple[str, ...]]] | None = None) -> None:
        templates = all_templates() if templates is None else templates
        self.families = [UNKNOWN, *templates]
        self.templates = {f: [_words(t) for group in groups for t in group] for f, groups in templates.items()} | {UNKNOWN: [_words(t) for t in OTHERS]}
        rows = [(piece, 0, is_held(n)) for n, t in enumerate(OTHERS) for piece in pieces_of(t)]
        unlisted = sum(r[2] for r in rows)
        rows += [(line, 0, is_held(n)) for n, line in enumerate(unknown)]
        rows += [(piece, i, is_held(n)) for i, f in enumerate(templates, 1) for n, group in enumerate(templates[f]) for t in group for piece in (pieces_of(t) if len(group) == 1 else [t, t.upper()])]
        y, back = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], bool)
        code, own, size = grams(_block([r[0] for r in rows]))
        value = (1 / np.sqrt(np.maximum(3 * size, 1)))[own]
        fitted = ~back[own]
        weights, bias = _softmax_fit(code[fitted], own[fitted], value[fitted], y, ~back, len(self.families))
        z = _scores(code, own, value, len(y), weights)[back] + bias
        truth, share = (np.arange(len(z)), y[back]), _shares(y[back], len(self.families))
        self.temperature = min(TEMPERATURES, key=lambda t: float((-np.log(_softmax(z / t)[truth] + 1e-12) * share).sum()))
        p = _softmax(z / self.temperature)
        #: Probabilities of the rows that were held back, by the fit that has not seen them, and what they are; and those of sentences of unlisted licences.
        self.held, self.unlisted = (p[unlisted:], y[back][unlisted:]), p[:unlisted]
        self.weights, self.bias = _softmax_fit(code, own, value, y, np.ones(len(y), bool), len(self.families))

    def predict(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Family (its number) and probability of each paragraph.

        A gram counts as often as it occurs, which overstates paragraphs that
        repeat one; those that look licensed are judged again by distinct grams.
        """
        code, own, size = grams(block)
        family, sure = self._judge(block.rows, code, own, size)
        again = np.isin(own, np.flatnonzero(family))
        if again.any():
            pairs = np.unique(own[again] * BUCKETS + code[again])
            code, own = pairs % BUCKETS, pairs // BUCKETS
            twice, p = self._judge(block.rows, code, own, np.bincount(own, minlength=block.rows) / 3)
            hit = family > 0
            family[hit], sure[hit] = twice[hit], p[hit]
        return family, sure

    def evidence(self, units: Units) -> np.ndarray:
        """Log-odds of each unit for each family against unknown; its grams may end in the next unit of the text."""
        words, text = units.plain.word_hashes, np.repeat(np.arange(units.plain.rows), np.diff(units.plain.words[2]))
        count = np.diff(units.first)
        own, codes, owners = np.repeat(np.arange(len(count)), count), [], []
        for n in (1, 2, 3):
            g = ngrams(words, n)
            inside = text[: len(g)] == text[n - 1 :] if len(g) else np.zeros(0, bool)
            codes.append((g[inside] >> np.uint64(50)).astype(np.int64))
            owners.append(own[: len(g)][inside])
        against = self.weights[:, 1:] - self.weights[:, :1]
        z = _scores(np.concatenate(codes), np.concatenate(owners), np.ones(sum(map(len, codes))), len(count), against)
        return (z / np.sqrt(np.maximum(3 * count, 1))[:, None] + self.bias[1:] - self.bias[0]) / self.temperature

    def _judge(self, rows: int, code: np.ndarray, own: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = _scores(code, own, np.ones(len(code)), rows, self.weights) / np.sqrt(np.maximum(3 * size, 1))[:, None]
        p = _softmax((z + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        sure = p[np.arange(len(p)), best]
        return np.where((sure >= CERTAIN) & (size > 0), best, 0), sure

    def agreement(self, family: int, words: np.ndarray) -> float:
        """The greatest share of the shorter one's shingles that stand in the other, over the family's templates; less for fewer words than five that are not a whole template."""
        best = 0.0
        for t in self.templates[self.families[family]]:
            size = max(min(SHINGLE, len(words), len(t)), 1)
            short, long = sorted((np.unique(ngrams(words, size)), np.unique(ngrams(t, size))), key=len)
            # Words alone that a template happens to hold, such as "mit", are little of it.
            best = max(best, float(np.isin(short, long).mean()) * min(1, len(words) / min(len(t), SHINGLE)))
        return best


    def confirms(self, agreement: float, words: np.ndarray) -> bool:
        """Whether a template agrees enough, and no sentence of a licence that is not listed agrees more."""
        return agreement >= SIMILARITY and agreement >= self.agreement(0, words)


#: Temperatures that calibration chooses among.
TEMPERATURES = tuple(round(0.1 * 1.25**k, 3) for k in range(16))


def is_held(n: int) -> bool:
    """Whether a family's n-th sentence or form is held back from the first fit."""
    return n % FOLDS == FOLDS - 1


def pieces_of(template: str) -> list[str]:
    """A template whole, in capitals, and, if it is long, without its last or first third and in pieces like wrapped lines."""
    words = template.split()
    parts = {template, template.upper()}
    if len(words) > 6:
        parts |= {" ".join(words[: max(len(words) * 2 // 3, 5)]), " ".join(words[len(words) // 3 :])}
    if len(words) > LINE:
        parts |= {" ".join(words[i : i + LINE]) for i in (*range(0, len(words) - LINE, LINE // 2), len(words) - LINE)}
    return sorted(parts)


def _shares(y: np.ndarray, classes: int) -> np.ndarray:
    """Weights under which all classes that occur count alike."""
    share = (1 / np.maximum(np.bincount(y, minlength=classes), 1))[y]
    return share / share.sum() if len(y) else share


def _block(texts: list[str]) -> Block:
    (block,) = blocks(pa.array(texts, pa.large_string()), 1 << 62)
    return _plain(block)


def _words(text: str) -> np.ndarray:
    return _block([text]).word_hashes


def _shingles(words: np.ndarray) -> np.ndarray:
    return np.unique(ngrams(words, min(SHINGLE, max(len(words), 1))))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True, initial=-1e9))
    return e / e.sum(axis=1, keepdims=True)


def _scores(code: np.ndarray, own: np.ndarray, value: np.ndarray, rows: int, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row's grams, for each class."""
    return np.column_stack([np.bincount(own, weights[code, k] * value, minlength=rows) for k in range(weights.shape[1])])


def _softmax_fit(code: np.ndarray, own: np.ndarray, value: np.ndarray, y: np.ndarray, rows: np.ndarray, classes: int, penalty: float = 1e-4, rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression over sparse rows by accelerated gradient; all classes count alike. ``rows`` marks those that are fitted on."""
    share = np.zeros((len(y), 1))
    share[rows, 0] = _shares(y[rows], classes)
    goal = np.eye(classes)[y]
    by_row, by_code = np.argsort(own, kind="stable"), np.argsort(code, kind="stable")
    rows_of, row_heads = np.unique(own[by_row], return_index=True)
    codes_of, code_heads = np.unique(code[by_code], return_index=True)
    w = v = np.zeros((BUCKETS + 1, classes), np.float32)
    z, grad = np.zeros((len(y), classes), np.float32), np.zeros_like(w)
    left = code[by_row], value[by_row, None].astype(np.float32)
    right = own[by_code], value[by_code, None].astype(np.float32)
    for k in range(rounds):
        if len(code):
            z[rows_of] = np.add.reduceat(v[left[0]] * left[1], row_heads)
        error = ((_softmax(z + v[-1]) - goal) * share).astype(np.float32)
        if len(code):
            grad[codes_of] = np.add.reduceat(error[right[0]] * right[1], code_heads)
        grad[-1] = error.sum(axis=0)
        new = v - np.float32(4) * (grad + np.float32(penalty) * v)
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:-1].astype(float), w[-1].astype(float)


def _sample(docs: DataFrame) -> list[str]:
    """Lines of a bounded number of documents that share no shingle with a template."""
    known = np.unique(np.concatenate([_shingles(_words(t)) for groups in all_templates().values() for group in groups for t in group]))
    rows = bounded_sample(docs.select("text").where("text is not null").withColumn("class", F.lit(0)), "class", SAMPLE_DOCS, "text")
    lines = [line for r in rows for line in r["text"].split("\n") if line.strip()]
    step = max(-(-len(lines) // SAMPLE_PARAGRAPHS), 1)
    return [line for line in lines[::step] if not np.isin(_shingles(_words(line)), known).any()]


def stretches(evidence: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of stretches of units with a positive sum for a family: the greatest, then the greatest of what is left, and so on; ties go to the first family and stretch."""
    left, out = [(0, len(evidence))], []
    while left:
        low, high = left.pop()
        if low >= high:
            continue
        upto = np.vstack((np.zeros(evidence.shape[1]), np.cumsum(evidence[low:high], axis=0)))
        least = np.minimum.accumulate(upto[:-1], axis=0)
        gain = upto[1:] - least
        family = int(gain.max(axis=0).argmax())
        end = int(gain[:, family].argmax())
        if gain[end, family] <= 0:
            continue
        begin = int(np.flatnonzero(upto[: end + 1, family] == least[end, family])[-1])
        out.append((low + begin, low + end + 1))
        left += [(low, low + begin), (low + end + 1, high)]
    return sorted(out)


def licensed(units: Units, model: Classifier) -> list[tuple[int, int]]:
    """First unit and unit after the last of each paragraph that may be a notice."""
    if not len(units.text):
        return []
    evidence = model.evidence(units)
    on = np.flatnonzero(evidence.max(axis=1) > 0)
    # Lines without evidence for any family bound the regions that are looked at.
    if not len(on):
        return []
    cut = np.flatnonzero(np.append(True, (np.diff(on) > BRIDGE + 1) | (np.diff(units.text[on]) != 0)))
    return [(int(on[a]) + p, int(on[a]) + q) for a, b in zip(cut, np.append(cut[1:], len(on)), strict=True) for p, q in stretches(evidence[on[a] : on[b - 1] + 1])]


def _line_start(raw: Block, units: Units, unit: int) -> int:
    """Where a paragraph's text begins: with its line, or within a long one with its first word."""
    at, head = units.plain.words[0][units.first[unit]], raw.starts[units.text[unit]]
    if unit and units.text[unit - 1] == units.text[unit] and units.line[unit - 1] == units.line[unit]:
        return int(at)
    feeds = np.flatnonzero(raw.data[head:at] == 10)
    return int(head + feeds[-1] + 1) if len(feeds) else int(head)


def _line_end(raw: Block, units: Units, unit: int) -> int:
    """Where a paragraph before the unit ends: with its line, or within a long one with its last word."""
    at, tail = units.plain.words[1][units.first[unit] - 1], raw.starts[units.text[unit - 1] + 1]
    if unit < len(units.text) and units.text[unit - 1] == units.text[unit] and units.line[unit - 1] == units.line[unit]:
        return int(at)
    feed = raw.data[at:tail].tobytes().find(b"\n")
    return int(at + feed) if feed >= 0 else int(tail)


def _joined(raw: Block, spans: list[tuple[int, int]]) -> Block:
    """The spans of a block as texts of another."""
    return Block(0, np.concatenate([raw.data[a:b] for a, b in spans]), np.append(0, np.cumsum([b - a for a, b in spans])))


def licensed_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The paragraphs that the classifier gives a licence family: doc_id, paragraph (its first line, from 0),
    lines (that it reaches over, blank ones included), family, probability, agreement with the nearest template, confirmed,
    and the paragraph's text.

    Defined cases: null and empty texts, and lines without words, have no paragraphs; repeated rows give their rows each; of a
    very long line the stretch of words with the evidence is the paragraph, and very long texts are read whole; of equally likely families the first
    listed wins; an empty table gives none; columns other than the two named
    are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(Classifier(_sample(docs)))

    def scan(batches):
        model = held.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for raw in blocks(batch.column(1)):
                units, rows = units_of(raw), []
                spans = licensed(units, model)
                if not spans:
                    continue
                whole = _joined(raw, [(_line_start(raw, units, p), _line_end(raw, units, q)) for p, q in spans])
                family, sure = model.predict(_plain(whole))
                for k, (p, q) in enumerate(spans):
                    if family[k]:
                        words = units.plain.word_hashes[units.words(p, q)]
                        agree = model.agreement(family[k], words)
                        rows.append((ids[raw.first + units.text[p]], int(units.line[p]), int(units.line[q - 1] - units.line[p]) + 1, model.families[family[k]], round(float(sure[k]), 6), round(agree, 6), model.confirms(agree, words), whole.text(k).decode()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=list(_NAMES))

    return docs.mapInArrow(scan, "doc_id long, paragraph long, lines long, family string, probability double, agreement double, confirmed boolean, line string")
