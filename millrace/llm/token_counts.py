"""Token counts by rank-synchronous array merging.

Method. A task holds the pre-tokens of a block of texts as ragged numpy arrays
(``byte_bpe``): all sequences merge their pair of lowest rank at once, round by
round, and the symbols that survive are counted. The vocabulary's file is read on the
driver and sent to the tasks; it is of a fixed size. No row leaves its task, so
nothing is shuffled.

A text of more than ``PART`` bytes is looked at in parts, cut before a blank that
follows a visible ASCII character: no pre-token, special token or merge reaches
over such a place, so counts of parts add up, and memory is bounded by the part (or by a
stretch that has no such place) beside the text itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import Block, utf8
from .byte_bpe import ByteBpe

#: Bytes of text that are looked at together.
PART = 1 << 20


def _before_words(look: np.ndarray) -> np.ndarray:
    return np.flatnonzero((look[1:] == 32) & (look[:-1] > 32) & (look[:-1] < 127))


def parts(data: np.ndarray, offsets: np.ndarray, limit: int = PART, cuts_of: Callable[[np.ndarray], np.ndarray] = _before_words) -> Iterator[tuple[Block, np.ndarray]]:
    """Blocks of about ``limit`` bytes with the text that each of their rows belongs to; longer texts are cut.

    ``cuts_of`` gets bytes, and gives the places between two of them where a cut is right.
    """
    cuts = [offsets]
    for a, b in zip(offsets[:-1][np.diff(offsets) > limit], offsets[1:][np.diff(offsets) > limit], strict=True):
        at = a + limit
        while at < b:
            look = data[at - 1 : min(at + limit, b)]
            found = cuts_of(look)
            if len(found):
                cuts.append(np.array([at + found[0]]))
            at = at + (found[0] if len(found) else 0) + limit
    starts = np.sort(np.concatenate(cuts))
    own = np.searchsorted(offsets, starts[:-1], side="right") - 1
    # Of empty texts, which begin where another one does, each has its own row.
    same = np.flatnonzero(starts[:-1] == starts[1:])
    own[same] = np.flatnonzero(np.diff(offsets) == 0)
    at = 0
    while at < len(own):
        upto = min(max(int(np.searchsorted(starts, starts[at] + limit, side="right")) - 1, at + 1), len(own))
        yield Block(at, data[starts[at] : starts[upto]], starts[at : upto + 1] - starts[at]), own[at:upto]
        at = upto


@lru_cache(maxsize=4)
def vocabulary(source: str) -> ByteBpe:
    """The vocabulary of a JSON text, made once for each process."""
    return ByteBpe(source)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of each document.

    path: the vocabulary's JSON, which only the driver reads. Begin and end
    tokens are not added; a special token's string in a text is that token, as
    the library has it by default.

    Defined cases: null and empty texts have no bytes and no tokens; very long
    texts are counted whole, in parts; overlapping places of one rank are merged from
    the left; repeated rows and null ids give their rows each; an empty table gives none;
    columns other than the two named are ignored.
    """
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(source.value)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            tokens = np.zeros(batch.num_rows, np.int64)
            for block, own in parts(data, offsets):
                np.add.at(tokens, own, bpe.counts(block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
