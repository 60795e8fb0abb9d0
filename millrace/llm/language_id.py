"""Language identification by hierarchical discrimination.

Method. Features are the shares of a text's byte trigrams. Families of languages are learnt from
these: the languages with the likest profiles are joined, step by step, into families of at most the root of the number of
languages, so either level has few machines however many languages there are. Linear support
vector machines first tell the language family, then one-versus-one
machines among the languages of that family separate close relatives. Each
machine's margin is calibrated to a probability; the score is the least
probability among the comparisons that the predicted language won.

The machines are fitted on the driver from a bounded sample (``PER_CLASS``
documents of each language, of a long text stretches spread over it). Prediction reads every
whole text: as a score is the mean of its trigrams' weights, texts of any
length cost a look-up for each byte.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .blocks import Block, blocks
from .linear import bounded_sample, linear_svm, logistic, sigmoid
from .scratch import free_names

#: Documents of each language that the machines are fitted on.
PER_CLASS = 400
#: Hashed trigrams.
BUCKETS = 1 << 13
#: The pipeline's stage rejects a document where evenly spread trigrams explain it better than its language does, by so many nats.
LEAST_EVIDENCE = 10.0
#: Share of a language's profile that is spread evenly over all trigrams.
SMOOTHING = 0.02
UNKNOWN = "und"
_SCALE = 30.0

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
#: ASCII letters, separators and the bytes of other characters: numbers and signs tell no language.
_PLAIN = np.array([b > 127 or chr(b).isalpha() or chr(b).isspace() for b in range(256)])


def trigrams(block: Block, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram, or of those without numbers and signs, and each text's first (one entry more than texts)."""
    b = _LOWER[block.data]
    if len(b) < 3:
        return np.zeros(0, np.uint32), np.zeros(block.rows + 1, np.int64)
    code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761) >> np.uint32(19)
    inside = np.ones(len(code), bool)
    for back in (1, 2):
        cut = block.starts[1:-1] - back
        inside[cut[(cut >= 0) & (cut < len(code))]] = False
    if plain:
        held = _PLAIN[block.data]
        inside &= held[:-2] & held[1:-1] & held[2:]
    first = np.append(0, np.cumsum(inside))[np.clip(block.starts, 0, len(code))]
    return code[inside], first


def means(weights: np.ndarray, block: Block) -> np.ndarray:
    """Mean weight over each text's trigrams, for each machine; 0 where a text has none."""
    code, first = trigrams(block)
    total = np.zeros((block.rows, weights.shape[1]))
    count = np.diff(first)
    full = np.flatnonzero(count)
    for j in range(weights.shape[1]):
        total[full, j] = np.add.reduceat(weights[code, j], first[:-1][full]) / count[full] if len(full) else 0
    return total


def evidence(profiles: np.ndarray, of: np.ndarray, block: Block) -> np.ndarray:
    """Sum over each text's plain trigrams of how much likelier its language (a row of profiles) makes them than even spread does."""
    code, first = trigrams(block, plain=True)
    worth = profiles[np.repeat(of, np.diff(first)), code]
    total = np.append(0.0, np.cumsum(worth))
    return total[first[1:]] - total[first[:-1]]


@dataclass
class Machine:
    """Tells class a (positive margin) from class b."""

    a: str
    b: str
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


@dataclass
class Hierarchy:
    """families: the machines among families; within: those among the languages of each; profiles: a row of log-ratios for each language."""

    families: list[Machine]
    within: dict[str, list[Machine]]
    members: dict[str, list[str]]
    languages: list[str]
    profiles: np.ndarray

    def machines(self) -> list[Machine]:
        return [*self.families, *(m for ms in self.within.values() for m in ms)]

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score from the mean weights of all machines, one row for each text."""
        machines = self.machines()
        sure = np.column_stack([sigmoid((margins[:, j] * _SCALE + m.bias) * m.slope + m.shift) for j, m in enumerate(machines)]) if machines else np.zeros((len(margins), 0))
        family, score = self._vote(list(self.members), self.families, sure[:, : len(self.families)])
        out, at = np.empty(len(margins), object), len(self.families)
        for i, (name, languages) in enumerate(self.members.items()):
            own, among = family == i, self.within[name]
            pick, inner = self._vote(languages, among, sure[:, at : at + len(among)])
            out[own] = np.array(languages, object)[pick[own]]
            score[own] = np.minimum(score[own], inner[own])
            at += len(among)
        return out, score

    @staticmethod
    def _vote(names: list[str], machines: list[Machine], sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class with most wins (ties: with most probability), and its least probability."""
        wins, least = np.zeros((len(sure), len(names))), np.ones((len(sure), len(names)))
        for j, m in enumerate(machines):
            for name, p in ((m.a, sure[:, j]), (m.b, 1 - sure[:, j])):
                i = names.index(name)
                wins[:, i] += (p > 0.5) + p / 1e3
                least[:, i] = np.minimum(least[:, i], p)
        best = wins.argmax(axis=1)
        return best, least[np.arange(len(sure)), best]


def families(names: list[str], shares: np.ndarray) -> dict[str, list[str]]:
    """Languages by family, from their profiles (shares of trigrams, a row each): the groups whose members are likest on average are joined, of ties the first by name.

    The likeness of two profiles is the sum of the roots of their products, 1 for equal ones. A family has at most
    as many members as the root of the number of languages, rounded up.
    """
    like, most = np.sqrt(shares) @ np.sqrt(shares).T, math.isqrt(max(len(names) - 1, 0)) + 1
    groups = [[i] for i in range(len(names))]
    while pairs := [(a, b) for a, b in combinations(range(len(groups)), 2) if len(groups[a]) + len(groups[b]) <= most]:
        a, b = max(pairs, key=lambda p: (round(float(like[np.ix_(groups[p[0]], groups[p[1]])].mean()), 9), -p[0], -p[1]))
        groups[a] = sorted(groups[a] + groups.pop(b))
    return {"+".join(names[i] for i in group): [names[i] for i in group] for group in groups}


def fit(texts: list[str], languages: list[str]) -> Hierarchy:
    column = pa.array(texts, pa.large_string())
    x = np.zeros((len(texts), BUCKETS), np.float32)
    for block in blocks(column):
        code, first = trigrams(block)
        for i in range(block.rows):
            part = code[first[i] : first[i + 1]]
            if len(part):
                x[block.first + i] = np.bincount(part, minlength=BUCKETS) * (_SCALE / len(part))
    y = np.array(languages)

    def machine(labels: np.ndarray, a: str, b: str) -> Machine:
        rows = (labels == a) | (labels == b)
        sign = np.where(labels[rows] == a, 1.0, -1.0)
        w, bias = linear_svm(x[rows], sign)
        slope, shift = logistic((x[rows] @ w + bias)[:, None], (sign > 0).astype(float), penalty=0.1)
        return Machine(a, b, w, bias, slope, shift)

    profiles = np.zeros((len(set(languages)), BUCKETS))
    names = sorted(set(languages))
    for block in blocks(column):
        code, first = trigrams(block, plain=True)
        for i in range(block.rows):
            if first[i + 1] > first[i]:
                profiles[names.index(languages[block.first + i])] += np.bincount(code[first[i] : first[i + 1]], minlength=BUCKETS) / (first[i + 1] - first[i])
    shares = profiles / np.maximum(profiles.sum(axis=1, keepdims=True), 1e-9)
    profiles = np.log((1 - SMOOTHING) * shares * BUCKETS + SMOOTHING)
    members = families(names, shares)
    own = {v: f for f, held in members.items() for v in held}
    family = np.array([own[v] for v in languages])
    return Hierarchy([machine(family, a, b) for a, b in combinations(members, 2)], {f: [machine(y, a, b) for a, b in combinations(v, 2)] for f, v in members.items()}, members, names, profiles)


def _learnt(labelled: DataFrame, text_col: str, lang_col: str, per_class: int) -> tuple[Hierarchy | None, np.ndarray]:
    sample = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    rows = bounded_sample(sample, "lang", per_class, "text")
    model = fit([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None
    return model, np.column_stack([m.weights for m in model.machines()]) if model and model.machines() else np.zeros((BUCKETS, 0))


def identified(docs: DataFrame, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those of ``keep``), then the predicted language, its score and its evidence, learnt from the text and language of ``labelled`` alone.

    The evidence says how much better, in nats, the language's trigrams explain
    the text than evenly spread ones do: below zero for what is in no learnt language.

    Defined cases: a null text or one without a letter is ``und`` with score
    0; so is everything where nothing is labelled; with one language learnt
    all else is that language with score 1; a text too short for a trigram
    goes by the machines' biases; repeated rows are predicted each; an empty
    table gives none; other columns are passed on as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(_learnt(labelled, text_col, lang_col, per_class))
    kept = docs.select(*(docs.columns if keep is None else keep))
    width = len(kept.columns)
    text_name, letter_name, *new = free_names(docs, "_text", "_letter", "_lang_pred", "_score", "_evidence")
    out = StructType([*kept.schema, StructField(new[0], StringType()), StructField(new[1], DoubleType()), StructField(new[2], DoubleType())])

    def predict(batches):
        model, weights = held.value
        for batch in batches:
            letters = batch.column(width + 1).fill_null(False).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(width)):
                letter = letters[block.first : block.first + block.rows]
                pred, score = model.predict(means(weights, block)) if model else (np.full(block.rows, UNKNOWN, object), np.zeros(block.rows))
                known = evidence(model.profiles, np.searchsorted(model.languages, pred.astype(str)), block) if model else np.zeros(block.rows)
                pred[~letter] = UNKNOWN
                score = np.where(letter & (model is not None), score, 0.0)
                rows = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*rows.columns[:width], pa.array(pred, pa.string()), pa.array(score), pa.array(known)], names=out.names)

    text = F.col(text_col).cast("string")
    return docs.select(*kept.columns, text.alias(text_name), text.rlike(r"\p{L}").alias(letter_name)).mapInArrow(predict, out)


def predicted(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, lang_pred and score of each of ``docs``; see ``identified``."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return identified(read, labelled.select(F.col(text_col).alias("text"), lang_col), "text", lang_col, per_class, ["doc_id"]).select("doc_id", F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def language_accepted(docs: DataFrame, least_evidence: float = LEAST_EVIDENCE) -> DataFrame:
    """``docs`` without those that are in none of the languages which their own labels teach.

    A document goes if it is ``und``, or if evenly spread trigrams explain it
    better than its predicted language by ``least_evidence`` nats: other
    languages and junk. Short texts have little evidence either way and stay.

    Defined cases: null texts and those without a letter go; with nothing
    labelled all go; repeated rows stay or go together; an empty table gives
    none; all columns stay as they are, whatever their names.
    """
    out = identified(docs, docs)
    lang, score, known = out.columns[-3:]
    return out.where((F.col(lang) != UNKNOWN) & (F.col(known) > -least_evidence)).drop(lang, score, known)
