"""Quality classifier by compression.

Method. Two zstandard dictionaries are built, one from text labelled good
and one from text labelled bad. Every whole text is compressed with each, in
pieces of ``PIECE`` bytes so that the dictionary matters throughout a long
text. The difference of the two sizes over their sum tells which dictionary
fits; a logistic regression on it, and on how little the text compresses to,
which tells repetitive text, calibrates it to a probability.

Dictionaries and calibration come from two halves of a bounded sample
(``PER_CLASS`` documents of each label, of a long text stretches spread over it).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .blocks import utf8
from .linear import bounded_sample, logistic, sigmoid, stretches

#: Documents of each label that the classifier is fitted on.
PER_CLASS = 800
#: Bytes that are compressed at a time, and of a dictionary.
PIECE, DICTIONARY = 4096, 400 << 10
#: Bytes of a stretch that a dictionary takes of a long text.
STRETCH = 256
#: Bytes of an ordinary text that each text is taken to have besides its own: the shorter a text, the more chance weighs in its sizes.
PRIOR = 100
LEVEL = 3
#: A score from which on label 1 is predicted.
THRESHOLD = 0.3


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """As much of the texts as fits, an equal share of each, so that no long text crowds others out.

    What short texts leave of their shares goes to longer ones. A text beyond
    its share gives stretches of ``STRETCH`` bytes spread evenly from its
    first byte to its last.
    """
    return b"\n".join(_spread(t, n) for t, n in zip(texts, _shares([len(t) for t in texts], size), strict=True))[:size]


def _shares(lengths: list[int], size: int) -> list[int]:
    """Bytes of each text: all of it, or the same for all longer ones; at least 64 where texts are many."""
    left, shares = size - len(lengths), [0] * len(lengths)
    for n, i in enumerate(sorted(range(len(lengths)), key=lengths.__getitem__)):
        shares[i] = min(lengths[i], max(left // (len(lengths) - n), 64))
        left -= shares[i]
    return shares


def _spread(text: bytes, share: int) -> bytes:
    if len(text) <= share:
        return text
    count = max(share // STRETCH, 2)
    length = share // count
    return b"".join(text[at : at + length] for at in (i * (len(text) - length) // (count - 1) for i in range(count)))


class Scorer:
    """Sizes of a text under the dictionaries; holds the compressors of one task."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self._by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=self._dict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (good, bad)]

    @staticmethod
    def _dict(data: bytes) -> zstandard.ZstdCompressionDict:
        held = zstandard.ZstdCompressionDict(data or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        return held

    def features(self, text: bytes) -> tuple[float, float]:
        """The normalised difference (positive: good fits better) and how far the size over the length lies below a quarter."""
        if not text:
            return 0.0, 0.0
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self._by)
        weight = len(text) / (len(text) + PRIOR)
        return weight * (bad - good) / (bad + good), weight * max(0.25 - min(good, bad) / len(text), 0.0)


def fit(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes, np.ndarray]:
    """Dictionaries from the even rows, calibration from the odd ones."""
    first = dictionary(good[::2]), dictionary(bad[::2])
    scorer = Scorer(*first)
    rows = [(scorer.features(t), label) for texts, label in ((good, 1), (bad, 0)) for t in texts[1::2]]
    if not rows:
        return *first, np.zeros(3)
    return *first, logistic(np.array([f for f, _ in rows]) * _SCALE, np.array([label for _, label in rows], float), penalty=1.0)


#: Brings both features near a unit scale.
_SCALE = 20


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 from ``THRESHOLD`` on) of each of ``docs``.

    ``labels`` has ids and labels; the texts of these ids alone are learnt from.
    Ids are picked first, so no text is read but theirs, and none is shuffled.

    Defined cases: a null text counts as empty; an empty one has no
    difference and gets the calibration's own score for that; without labels
    every score is 0.5; with one label only the dictionary of the other is
    empty; repeated rows are scored each, and where a labelled id is repeated
    its least text is learnt from; texts of one difference have one score; of a very long text
    every part is scored; an empty table gives none; columns other
    than those named are ignored.
    """
    spark, read = docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    picked = spark.createDataFrame(bounded_sample(known, "label", per_class), known.schema)  # at most two classes of per_class rows
    texts = read.join(F.broadcast(picked.distinct()), F.col("doc_id") == F.col("id")).select("id", "label", stretches(F.coalesce("text", F.lit(""))).alias("text"))
    rows = sorted(texts.groupBy("id", "label").agg(F.min("text").alias("text")).collect())  # of rows that repeat an id one
    good, bad, weights = fit(*([r["text"].encode() for r in rows if r["label"] == k] for k in (1, 0)))
    held = spark.sparkContext.broadcast((good, bad, weights))

    def score(batches):
        good, bad, weights = held.value
        scorer = Scorer(good, bad)
        for batch in batches:
            data, starts = utf8(batch.column(1))
            data = data.tobytes()
            x = np.array([scorer.features(data[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]).reshape(-1, 2) * _SCALE
            p = sigmoid(x @ weights[:-1] + weights[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return read.mapInArrow(score, "doc_id long, score double, predicted int")
