"""Byte-level BPE over numpy arrays: pre-tokens of many texts at once, merged rank by rank.

Pre-tokens are ragged arrays: one array of symbols and the length of each
sequence. In a round every sequence merges all places of its own pair of lowest
rank, all sequences at once; sequences without a pair leave. That gives
what merging one place at a time gives, as a pair that a merge makes has a
higher rank than the merge. Equal pre-tokens of a block are merged once.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from tokenizers import pre_tokenizers

from .blocks import Block, mix, ragged_arange

#: Kinds of characters that the pattern of pre-tokens tells apart.
_OTHER, _LETTER, _NUMBER, _SPACE, _UNSEEN = range(5)
#: Longest pre-token, in bytes, that is merged once for a block: with its length it fits two 64-bit keys.
_PACKED = 15
#: Sequences of more symbols are merged with a heap, as they could need a round for each rank of the vocabulary.
LONG = 1024
_NONE = np.int64(1 << 40)
#: Places of the table of pairs, as a power of two.
_TABLE_BITS = 18


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Kinds:
    """Kinds of code points, asked of the library when one is first seen, so that its Unicode version decides."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, _UNSEEN, np.uint8)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.table[points]
        if (kinds == _UNSEEN).any():
            for point in np.unique(points[kinds == _UNSEEN]).tolist():
                joins = (k for k, beside in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(self.library.pre_tokenize_str(beside + chr(point))) == 1)
                self.table[point] = next(joins, _SPACE)
            kinds = self.table[points]
        return kinds


@lru_cache(maxsize=1)
def _kinds() -> _Kinds:
    return _Kinds()


def pretokens(data: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Where each pre-token begins, in bytes, with the end of the data as last entry.

    ``sections`` are the bytes at which a text (or what follows a special
    token) begins. A run of letters, of numbers or of other characters is a
    pre-token with the one blank before it; what is left of blanks is one, or
    two where the last one is no U+0020 and something follows. A lone
    apostrophe takes the ending of a contraction.
    """
    if not len(data):
        return np.zeros(1, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    kinds, n = _kinds().of(points), len(points)
    fresh = np.zeros(n + 1, bool)  # a section begins here
    fresh[np.searchsorted(at, sections)] = True
    fresh[n] = True
    run = fresh[:n].copy()
    run[1:] |= kinds[1:] != kinds[:-1]
    ends_space = np.zeros(n, bool)  # the last blank of a run that something follows
    ends_space[:-1] = (kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & ~fresh[1:n]
    begin = run | ends_space
    begin[1:] &= ~(ends_space[:-1] & (points[:-1] == 32))
    quote = np.flatnonzero((points == 39) & begin)
    letter = [np.where(quote + k < n, points[np.minimum(quote + k, n - 1)], 0) * ~fresh[np.minimum(quote + k, n)] for k in (1, 2)]
    letter[1] = letter[1] * (letter[0] > 0)
    short = np.isin(letter[0], [ord(c) for c in "stmd"])
    pairs = (letter[0].astype(np.uint64) << np.uint64(32)) | letter[1].astype(np.uint64)
    long = np.isin(pairs, np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")], np.uint64))
    begin[quote[short | long] + 1] = False
    after = np.concatenate((quote[short] + 2, quote[long] + 3))
    begin[after[after < n]] = True
    return np.append(at[begin], len(data))


def equal_strings(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A representative of each group of equal byte strings, and the group of each string; strings over ``_PACKED`` bytes are groups of their own.

    A hash orders the strings, their bytes themselves decide, so a collision splits a group at most.
    """
    low, high = np.zeros(len(begin), np.uint64), size.astype(np.uint64)
    for j in range(_PACKED):
        on = np.flatnonzero(size > j)
        byte = data[begin[on] + j].astype(np.uint64)
        if j < 8:
            low[on] |= byte << np.uint64(8 * j)
        else:
            high[on] |= byte << np.uint64(8 * (j - 7))
    long = size > _PACKED
    low[long], high[long] = begin[long].astype(np.uint64), np.uint64(255)
    order = np.argsort(mix(low) ^ high * np.uint64(0x9E3779B97F4A7C15))
    new = np.ones(len(order), bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    group = np.empty(len(begin), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


@dataclass
class Encoded:
    """Tokens of a block: ids in order, and the first token of each text (one entry more than texts)."""

    ids: np.ndarray
    first: np.ndarray


class ByteBpe:
    """A byte-level vocabulary, from the JSON of the tokenizers library."""

    def __init__(self, source: str) -> None:
        read = json.loads(source)
        model, pre = read["model"], read["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("normalizer", "truncation", "padding") if read.get(k)]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or odd:
            raise ValueError("only plain byte-level BPE is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in read["added_tokens"]):
            raise ValueError("only plain special tokens are supported")
        vocabulary, symbols = model["vocab"], byte_symbols()
        self.special = {t["content"].encode(): t["id"] for t in read["added_tokens"]}
        #: The bytes of each id, and how many they are.
        self.bytes = {i: bytes(symbols[c] for c in piece) for piece, i in vocabulary.items() if piece.encode() not in self.special}
        self.bytes |= {i: piece for piece, i in self.special.items()}
        self.sizes = np.zeros(max(self.bytes) + 1, np.int64)
        self.sizes[list(self.bytes)] = [len(b) for b in self.bytes.values()]
        self.alphabet = np.zeros(256, np.int64)
        self.alphabet[list(symbols.values())] = [vocabulary[c] for c in symbols]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
        self._ranked = {key: rank for rank, key in enumerate(keys.tolist())}
        # A table by hash; keys whose place is taken stand in a sorted list beside it.
        place = self._place(keys)
        taken, first = np.unique(place, return_index=True)
        self._keys, self._ranks = np.full(1 << _TABLE_BITS, -1), np.full(1 << _TABLE_BITS, _NONE)
        self._keys[taken], self._ranks[taken] = keys[first], first
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self._more_keys, self._more_ranks = np.append(keys[rest], -1), np.append(rest, _NONE)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)

    @staticmethod
    def _place(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        place = self._place(key)
        held = self._keys[place]
        rank = np.where(held == key, self._ranks[place], _NONE)
        other = np.flatnonzero((held != key) & (held >= 0))
        at = np.searchsorted(self._more_keys[:-1], key[other])
        rank[other] = np.where(self._more_keys[at] == key[other], self._more_ranks[at], _NONE)
        return rank

    def merged(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of each sequence, and how many; sequences are not empty."""
        row, done = np.arange(len(size)), []
        long = size > LONG
        if long.any():
            heads = np.cumsum(size) - size
            for r in np.flatnonzero(long):
                left = self.merged_by_heap(symbols[heads[r] : heads[r] + size[r]].tolist())
                done.append((np.array([r]), np.array([len(left)]), np.array(left, np.int64)))
            symbols, row, size = symbols[np.repeat(~long, size)], row[~long], size[~long]
        while len(size):
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = self._rank(symbols[:-1], symbols[1:])
            heads = np.cumsum(size) - size
            rank[heads + size - 1] = _NONE
            best = np.minimum.reduceat(rank, heads)
            over = best == _NONE
            if over.any():
                gone = np.repeat(over, size)
                done.append((row[over], size[over], symbols[gone]))
                symbols, rank, row, best, size = symbols[~gone], rank[~gone], row[~over], best[~over], size[~over]
                if not len(size):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, size))
            # Of places that overlap, as in a a a, every other one is merged, from the left.
            new = np.append(True, hits[1:] != hits[:-1] + 1)
            since = np.arange(len(hits)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            hits = hits[since % 2 == 0]
            symbols[hits] = self.made[rank[hits]]
            kept = np.ones(len(symbols), bool)
            kept[hits + 1] = False
            size = np.add.reduceat(kept, np.cumsum(size) - size, dtype=np.int64)
            symbols = symbols[kept]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, sizes, left = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(rows)
        return left[ragged_arange((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]

    def merged_by_heap(self, symbols: list[int]) -> list[int]:
        """The same for one long sequence, in n log n steps."""
        left = np.array(symbols, np.int64)
        ranks = self._rank(left[:-1], left[1:])
        heap = [(int(ranks[i]), int(i), symbols[i], symbols[i + 1]) for i in np.flatnonzero(ranks != _NONE)]
        heapq.heapify(heap)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        alive = [True] * len(symbols)

        def push(i: int, j: int) -> None:
            rank = self._ranked.get(symbols[i] << 32 | symbols[j])
            if rank is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else len(symbols)
            if j >= len(symbols) or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = int(self.made[rank]), False, after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return [s for s, on in zip(symbols, alive, strict=True) if on]

    def _pieces(self, block: Block, special: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin and size of each pre-token, a special token's id (or -1), and the distinct ones with each one's group."""
        data, cuts, named = block.data, [block.starts], {}
        if special:
            whole = data.tobytes()
            for content, number in self.special.items():
                at = whole.find(content)
                while at >= 0:
                    # The bytes must lie in one text.
                    if np.searchsorted(block.starts, at, side="right") == np.searchsorted(block.starts, at + len(content) - 1, side="right"):
                        named[at] = (at + len(content), number)
                        cuts.append(np.array([at, at + len(content)]))
                        at += len(content) - 1
                    at = whole.find(content, at + 1)
        sections = np.unique(np.concatenate(cuts))
        begin = pretokens(data, sections[sections < len(data)])
        if named:
            inside = np.zeros(len(data) + 1, bool)
            for at, (end, _) in named.items():
                inside[at + 1 : end] = True
            begin = begin[~inside[begin]]
        size, begin = np.diff(begin), begin[:-1]
        number = np.full(len(begin), -1)
        if named:
            at = np.array(sorted(named))
            number[np.searchsorted(begin, at)] = [named[int(a)][1] for a in at]
        which, group = equal_strings(data, begin, size)
        return begin, size, number, which, group

    def _merged_groups(self, block: Block, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.merged(self.alphabet[block.data[ragged_arange(begin[which], size[which])]], size[which])

    def counts(self, block: Block, special: bool = True) -> np.ndarray:
        """Tokens of each text; a special token's string is one where ``special`` holds, and plain text else."""
        begin, size, number, which, group = self._pieces(block, special)
        if not len(begin):
            return np.zeros(block.rows, np.int64)
        _, left = self._merged_groups(block, begin, size, which)
        each = np.where(number < 0, left[group], 1)
        return np.diff(np.append(0, np.cumsum(each))[np.searchsorted(begin, block.starts)])

    def encoded(self, block: Block, special: bool = True) -> Encoded:
        """The tokens of each text."""
        begin, size, number, which, group = self._pieces(block, special)
        if not len(begin):
            return Encoded(np.zeros(0, np.int64), np.zeros(block.rows + 1, np.int64))
        ids, left = self._merged_groups(block, begin, size, which)
        ids, left = np.append(ids, number), np.append(left, np.ones(len(number), np.int64))
        row = np.where(number < 0, group, len(which) + np.arange(len(number)))
        heads = np.cumsum(left) - left
        out = ids[ragged_arange(heads[row], left[row])]
        return Encoded(out, np.append(0, np.cumsum(left[row]))[np.searchsorted(begin, block.starts)])
