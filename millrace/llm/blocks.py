"""Vectorised views of the texts in an Arrow batch.

Spark deals rows to tasks; inside a task the functions here look at the
UTF-8 bytes of some megabytes of texts at once with numpy, so that no
Python code runs per byte or per word. A word is a run of bytes other
than the six ASCII separators (space and 0x09 to 0x0D).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; bounds a task's memory.
BLOCK_BYTES = 1 << 18

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The second modulus, a prime, and its base. Modulo 2^64 alone, some strings of 1,024 bytes share a hash whatever the base.
_PRIME = np.uint64((1 << 31) - 1)
_PRIME_BASE = 1_284_865_837
_PRIME_INVERSE = pow(_PRIME_BASE, -1, (1 << 31) - 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number that is x modulo the prime."""
    return (x & _PRIME) + (x >> np.uint64(31))


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2^62."""
    x = _folded(_folded(x))
    return np.minimum(x, x - _PRIME)


def _prime_powers(base: int, size: int) -> np.ndarray:
    """base^0, base^1, ... modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate((out, _modulo(out * np.uint64(pow(base, len(out), int(_PRIME))))))
    return out[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, made once for each process."""

    def __init__(self) -> None:
        self.all = (np.ones(1, np.uint64),) * 4

    def upto(self, n: int) -> tuple[np.ndarray, ...]:
        """Powers of the base and of its inverse, for either modulus."""
        if len(self.all[0]) < n:
            size = max(n, BLOCK_BYTES + 1)
            up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
            up[0] = down[0] = 1
            self.all = np.cumprod(up), np.cumprod(down), _prime_powers(_PRIME_BASE, size), _prime_powers(_PRIME_INVERSE, size)
        return tuple(p[:n] for p in self.all)


_POWERS = _Powers()


@dataclass
class Block:
    """The bytes of consecutive texts: text i is data[starts[i]:starts[i + 1]]."""

    first: int
    data: np.ndarray
    starts: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.starts) - 1

    @cached_property
    def _prefix(self) -> tuple[np.ndarray, np.ndarray]:
        up, _, prime_up, _ = _POWERS.upto(len(self.data))
        symbols = self.data.astype(np.uint64) + np.uint64(1)
        out = np.zeros((2, len(self.data) + 1), np.uint64)
        np.cumsum(symbols * up, out=out[0, 1:])
        np.cumsum(_folded(symbols * prime_up), out=out[1, 1:])
        return out[0], out[1]

    def hashes(self, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """A 64-bit hash of data[begin:end] for each pair; equal bytes give equal hashes.

        It is a polynomial modulo 2^64 and another one modulo a prime, mixed.
        """
        _, down, _, prime_down = _POWERS.upto(len(self.data) + 1)
        wide, prime = self._prefix
        second = _modulo(_folded(_folded(prime[end] - prime[begin])) * prime_down[begin])
        return mix((wide[end] - wide[begin]) * down[begin] ^ second * _STEP)

    def byte_ngrams(self, n: int) -> np.ndarray:
        """A hash of every n consecutive bytes, the same as hashes() gives; they may cross texts."""
        count = max(len(self.data) - n + 1, 0)
        return self.hashes(slice(0, count), slice(n, n + count))

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each word, and each text's first word (one entry more than texts)."""
        inside = ~_SEPARATOR[self.data]
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.starts] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | cut[1:-1]
        end = inside
        end[:-1] &= ~inside[1:] | cut[1:-1]
        begins = np.flatnonzero(begin)
        return begins, np.flatnonzero(end) + 1, np.searchsorted(begins, self.starts)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        begin, end, _ = self.words
        return self.hashes(begin, end)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i + 1]].tobytes()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column in blocks of at most ``limit`` bytes, or of one text where that is longer."""
    data, offsets = utf8(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        upto = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        upto = min(max(upto, at + 1), rows)
        yield Block(at, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at])
        at = upto


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive entries, in order; sequences may cross texts."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for j in range(1, n):
        out *= _STEP
        out += hashes[j : j + count]
    return mix(out)


def owners(first: np.ndarray) -> np.ndarray:
    """The text that each word (or byte) belongs to, from the first of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


_PLACE_BITS = np.uint64(28)
_PLACE = np.uint64((1 << 28) - 1)


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest key (by its upper 36 bits) in each window of ``width`` keys.

    Key and place share one integer, so that plain minima by doubling suffice:
    the smallest of 2m entries is the smaller one of two minima over m entries.
    """
    if len(keys) > int(_PLACE):
        raise ValueError("a text of over 268 million units can't be looked at at once")
    count = len(keys) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    best = (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)
    span = 1
    while span < width:
        shift = min(span, width - span)
        best = np.minimum(best[: len(best) - shift], best[shift:])
        span += shift
    return (best[:count] & _PLACE).astype(np.int64)


@dataclass
class Anchors:
    """Anchored windows: windows low..low + count - 1 of a text all hold the gram at ``at``.

    Windows that are equal have their anchor at the same place within them, so
    equal windows are found among the windows of anchors with equal grams only.
    """

    at: np.ndarray
    low: np.ndarray
    count: np.ndarray


def anchors(grams: np.ndarray, first: np.ndarray, gram: int, window: int) -> Anchors:
    """Winnowing: of each window's grams the one with the smallest hash is its anchor."""
    total = int(first[-1])
    count = max(total - window + 1, 0)
    at = sliding_argmin(grams, window - gram + 1)[:count]
    whole = np.zeros(count + 1, np.int64)
    ends = np.minimum(np.maximum(first[1:] - window + 1, first[:-1]), count)
    begins = np.minimum(first[:-1], count)
    np.add.at(whole, begins, 1)
    np.add.at(whole, ends, -1)
    whole = np.flatnonzero(np.cumsum(whole)[:count] > 0)
    if not len(whole):
        return Anchors(*(np.zeros(0, np.int64),) * 3)
    at = at[whole]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)))
    return Anchors(at[new], whole[new], np.diff(np.append(new, len(at))))


def ragged_arange(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), then those of begin[1], and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(begin - (ends - count), count)


def covered(begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """True at each place of 0..length-1 that some [begin, end) covers."""
    steps = np.bincount(begin, minlength=length + 1)[: length + 1] - np.bincount(end, minlength=length + 1)[: length + 1]
    return np.cumsum(steps)[:length] > 0
