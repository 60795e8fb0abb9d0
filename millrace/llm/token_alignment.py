"""Cross-tokenizer alignment: the tokens of two vocabularies over the same bytes, side by side.

Method. A task encodes a part of its texts with both tokenizers and gives
DuckDB two interval tables (begin, end, id). Two ASOF joins find the first and the last
token of B that each token of A overlaps, a range join the ones between; where the ends of
two overlapping tokens meet they are linked, and window sums of these meetings number the
groups. Each document's links are written as pairs of ids. Partial pair counts, made by
DuckDB for each Arrow batch, are merged in Spark, and a second DuckDB query joins
them with the links.

Pair counts can be broadcast: of two tokens that end at one byte, the shorter one's bytes are the
end of the longer one's, so there are at most as many pairs as the vocabularies' bytes,
twice (813,308 for the two public ones, 16 bytes each), however large the corpus.

Equal words are encoded once for a part of the texts. A uses ``byte_bpe``; for B this is right as no piece of its
vocabulary goes on over a blank that follows another character, which is checked when it is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .blocks import Block, ragged_arange, utf8
from .byte_bpe import ByteBpe, Encoded, equal_strings
from .scratch import written
from .token_counts import parts, vocabulary

_BLANK = "▁"


class PieceBpe:
    """A vocabulary of the sentencepiece library with byte fallback."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(_BLANK in p.lstrip(_BLANK) for p in pieces):
            raise ValueError("only vocabularies whose pieces begin with their blanks are supported")
        self.blank = self.library.piece_to_id(_BLANK)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self._all, self._heads = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.sizes) - self.sizes

    def words(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of words with the blanks before them; the library adds the first blank itself."""
        found = self.library.encode([w[1:].decode() for w in words], num_threads=1)
        return [ids if len(w) > 1 else [self.blank] for ids, w in zip(found, words, strict=True)]

    def encoded(self, block: Block) -> tuple[Encoded, np.ndarray]:
        """The tokens of each row, and which rows' tokens have other bytes than the row. Rows begin with a blank or are empty."""
        data = block.data
        head = data == 32
        head[1:] &= data[:-1] != 32
        head[block.starts[:-1][np.diff(block.starts) > 0]] = True
        begin = np.flatnonzero(head)
        if not len(begin):
            return Encoded(np.zeros(0, np.int64), np.zeros(block.rows + 1, np.int64)), np.zeros(block.rows, bool)
        size = np.diff(np.append(begin, len(data)))
        which, group = equal_strings(data, begin, size)
        whole = data.tobytes()
        found = self.words([whole[w : w + n] for w, n in zip(begin[which].tolist(), size[which].tolist(), strict=True)])
        left = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.array(list(chain.from_iterable(found)), np.int64)
        heads = np.cumsum(left) - left
        row = np.searchsorted(block.starts, begin, side="right") - 1
        first = np.append(0, np.cumsum(left[group]))[np.searchsorted(begin, block.starts)]
        return Encoded(ids[ragged_arange(heads[group], left[group])], first), np.bincount(row, self._odd(data, begin[which], size[which], ids, heads, left)[group], block.rows) > 0

    def _odd(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray, heads: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Which words differ from the bytes of their tokens."""
        odd = np.add.reduceat(self.sizes[ids], heads) != size
        kept = ids[np.repeat(~odd, left)]
        same = self._all[ragged_arange(self._heads[kept], self.sizes[kept])] == data[ragged_arange(begin[~odd], size[~odd])]
        if not same.all():
            word = np.repeat(np.flatnonzero(~odd), size[~odd])
            odd[word[~same]] = True
        return odd


@lru_cache(maxsize=4)
def pieces(model: bytes) -> PieceBpe:
    """The vocabulary of a model file, made once for each process."""
    return PieceBpe(model)


@lru_cache(maxsize=1)
def _session() -> duckdb.DuckDBPyConnection:
    """A task's own DuckDB: one thread, in memory, without files."""
    held = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": "", "allocator_flush_threshold": "8MB"})
    held.execute("set preserve_insertion_order = true")
    return held


#: Bytes of text that are aligned together, and that make a batch of results.
PART, BATCH = 1 << 18, 1 << 22

#: Tokens of A that DuckDB gets at a time, at least; a stretch without blanks may have more.
CHUNK = 1 << 18

#: From the interval tables a and b (i, row, id, s, e): all overlaps with their place in order, whether one is its token's first, whether the ends meet, and the group by the number of meetings before.
_OVERLAPS = """with begun as (select a.*, b.i as first from a asof join b on a.s >= b.s),
whole as (select begun.*, b.i as last from begun asof join b on begun.e > b.s),
overlap as (select i, row, id, s, e, first, unnest(range(first, last + 1))::int as j from whole),
met as (select o.i + j as place, o.row, o.id as a, b.id as b, j = first as opens_a, o.s <= b.s as opens_b, o.e = b.e as meets from overlap o join b on o.j = b.i)
select *, coalesce(sum(meets::int) over (order by place rows between unbounded preceding and 1 preceding), 0)::bigint as g from met"""


def _intervals(tokens: Encoded, sizes: np.ndarray, starts: np.ndarray, usable: np.ndarray) -> pa.Table:
    """The interval table of a block's tokens, in the block's bytes; rows that can't be used have none."""
    row = np.repeat(np.arange(len(usable)), np.diff(tokens.first))
    upto = np.append(0, np.cumsum(sizes[tokens.ids]))
    begin = upto[:-1] - upto[tokens.first[row]] + starts[row]
    on = usable[row]
    columns = np.arange(int(on.sum())), row[on], tokens.ids[on], begin[on], (begin + sizes[tokens.ids])[on]
    return pa.table({name: c.astype(np.int32) for name, c in zip(("i", "row", "id", "s", "e"), columns, strict=True)})


def _overlaps(a: pa.Table, b: pa.Table) -> list[np.ndarray]:
    """row, a, b, opens_a, opens_b, meets and g of all overlaps, in order.

    Long tables are cut where a token of A and one of B end together, as no group reaches over such a place.
    """
    cuts = [(0, 0)]
    if a.num_rows > CHUNK:
        ends = [t.column("e").to_numpy() for t in (a, b)]
        shared = np.intersect1d(*ends)
        for at in range(CHUNK, a.num_rows, CHUNK):
            end = shared[np.searchsorted(shared, ends[0][at])]
            cuts.append(tuple(int(np.searchsorted(e, end, side="right")) for e in ends))
    cuts = sorted({*cuts, (a.num_rows, b.num_rows)})
    out, groups, duck = [], 0, _session()
    for low, high in zip(cuts, cuts[1:], strict=False):
        for name, table, begin, end in zip("ab", (a, b), low, high, strict=True):
            some = table.slice(begin, end - begin)
            duck.register(name, some.set_column(0, "i", pa.array(np.arange(some.num_rows, dtype=np.int32))))
        place, *found = (c.to_numpy() for c in duck.sql(_OVERLAPS).to_arrow_table().columns)
        if (np.diff(place) < 0).any():
            order = np.argsort(place)
            found = [c[order] for c in found]
        found[-1] = found[-1] + groups
        groups = int(found[-1][-1]) + 1
        out.append(found)
    return [np.concatenate(c) for c in zip(*out, strict=True)]


class _Row:
    """What the parts of one text add up to."""

    def __init__(self) -> None:
        self.told, self.counts, self.link_a, self.link_b = None, np.zeros(4, np.int64), [], []

    def add(self, told: bytes, counts: np.ndarray, link_a: np.ndarray, link_b: np.ndarray) -> None:
        self.told = self.told or hashlib.sha256()
        self.told.update(told if not self.counts[0] else b";" + told)
        self.counts += counts
        self.link_a.append(link_a)
        self.link_b.append(link_b)


_NO_ROW = _Row()
_SEPARATORS = pa.array(["", ";", "|", ","])


def _told(row: np.ndarray, group: np.ndarray, side: np.ndarray, ids: np.ndarray, rows: int) -> Iterator[bytes]:
    """Of each row its groups: A's ids, a bar, B's ids; groups are told apart by semicolons."""
    order = np.argsort(2 * group + side, kind="stable")
    row, group, side = row[order], group[order], side[order]
    mark = np.full(len(order), 3)
    mark[1:][side[1:] != side[:-1]] = 2
    mark[1:][group[1:] != group[:-1]] = 1
    first = np.searchsorted(row, np.arange(rows + 1))
    mark[first[:-1][np.diff(first) > 0]] = 0
    text = pc.binary_join_element_wise(_SEPARATORS.take(pa.array(mark)), pa.array(ids[order]).cast(pa.string()), "")
    data, offsets = utf8(text)
    data, at = data.tobytes(), offsets[first]
    return (data[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


_NAMES = ("doc_id", "n_a", "n_b", "n_overlaps", "n_groups", "groups_sha256", "link_a", "link_b")


def _aligned_batch(batch: pa.RecordBatch, a: ByteBpe, b: PieceBpe) -> pa.RecordBatch:
    data, offsets = utf8(batch.column(1))
    size = np.diff(offsets)
    data = np.insert(data, offsets[:-1][size > 0], 32)
    offsets = np.append(0, np.cumsum(size + (size > 0)))
    held, odd = {}, np.zeros(batch.num_rows, bool)
    for block, own in parts(data, offsets, PART):
        by_a = a.encoded(block, special=False)
        by_b, other = b.encoded(block)
        odd[own[other]] = True
        usable = ~other & (np.diff(block.starts) > 0)
        if not usable.any():
            continue
        row, id_a, id_b, opens_a, opens_b, meets, group = _overlaps(_intervals(by_a, a.sizes, block.starts, usable), _intervals(by_b, b.sizes, block.starts, usable))
        counts = np.column_stack([np.bincount(row[on], minlength=block.rows) for on in (opens_a, opens_b, slice(None), meets)])
        sides = np.repeat(np.arange(2), (opens_a.sum(), opens_b.sum()))
        told = _told(np.append(row[opens_a], row[opens_b]), np.append(group[opens_a], group[opens_b]), sides, np.append(id_a[opens_a], id_b[opens_b]), block.rows)
        heads = np.append(0, np.cumsum(counts[:, 3]))
        link_a, link_b = id_a[meets], id_b[meets]
        for r, text in enumerate(told):
            if usable[r]:
                links = slice(heads[r], heads[r + 1])
                held.setdefault(own[r], _Row()).add(text, counts[r], link_a[links], link_b[links])
    kept = [_NO_ROW if odd[i] else held.get(i, _NO_ROW) for i in range(batch.num_rows)]
    counts = np.array([r.counts for r in kept], np.int64).reshape(-1, 4)
    columns = [batch.column(0), *(pa.array(counts[:, k]) for k in range(4)), pa.array([r.told.hexdigest() if r.told else "" for r in kept], pa.string())]
    columns += [pa.array([b"".join(x.tobytes() for x in getattr(r, side)) for r in kept], pa.binary()) for side in ("link_a", "link_b")]
    return pa.RecordBatch.from_arrays(columns, names=list(_NAMES))


def _slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``BATCH`` bytes of a column."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = max(int(np.searchsorted(offsets, offsets[at] + BATCH, side="right")) - 1, at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def _links(batch: pa.RecordBatch) -> pa.Table:
    """(r, a, b): the links of a batch's rows."""
    a, offsets = utf8(batch.column("link_a"))
    b, _ = utf8(batch.column("link_b"))
    return pa.table({"r": np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 4), "a": a.view(np.int32), "b": b.view(np.int32)})


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n): how many links of the batch hold each pair."""
    duck = _session()
    for batch in batches:
        sides = (utf8(batch.column(c))[0].view(np.int32) for c in ("link_a", "link_b"))
        duck.register("links", pa.table(dict(zip("ab", sides, strict=True))))
        held = duck.sql("select a, b, count(*) as n from links group by a, b").to_arrow_table()
        yield from held.to_batches()


_SCORED = """with scored as (select r, count(*) as n_links, count(*) filter (best) as n_best, sum(n)::bigint as count_sum from links join counts using (a, b) group by r)
select doc_id, n_a, n_b, n_groups, coalesce(n_links, 0) as n_links, coalesce(n_best, 0) as n_best, coalesce(count_sum, 0)::bigint as count_sum, groups_sha256, n_overlaps from docs left join scored using (r) order by r"""


def most_pairs(a: ByteBpe, b: PieceBpe) -> int:
    """A bound on the pairs that links can hold: each token's ends, in the other vocabulary, where a byte piece may double a piece."""
    return 2 * int(a.sizes.sum()) + int(b.sizes.sum())


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n): how many links hold each pair of ids, from a table with link_a and link_b."""
    partial = links.select("link_a", "link_b").mapInArrow(_pair_counts, "a int, b int, n long")
    return partial.groupBy("a", "b").agg(F.sum("n").alias("n"))


def token_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_overlaps (pairs of tokens that share a byte), n_groups, groups_sha256, and the links in order, as two arrays of 32-bit ids, link_a and link_b."""
    shared = docs.sparkSession.sparkContext
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        sources = shared.broadcast((f.read(), g.read()))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = vocabulary(sources.value[0]), pieces(sources.value[1])
        for batch in batches:
            yield from (_aligned_batch(some, a, b) for some in _slices(batch))

    return docs.mapInArrow(align, "doc_id long, n_a long, n_b long, n_overlaps long, n_groups long, groups_sha256 string, link_a binary, link_b binary")


def token_alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps of each document.

    path_a: the JSON of a byte-level vocabulary, which gets each text after a
    blank; path_b: a sentencepiece model, which adds that blank itself. A link's count is the number of links
    of the whole corpus that hold its two ids; n_best are the links whose count is the
    highest of their B id, ties included.

    Defined cases: null and empty texts, and those that B does not give back byte for
    byte (it has U+2581 for a blank), have no tokens and '' for groups_sha256;
    very long texts are aligned in parts, cut where both vocabularies end a token; repeated rows and null ids
    give their rows each, and all count; an empty table gives none; columns other than the
    two named are ignored.
    """
    links = written(token_links(docs, path_a, path_b, id_col, text_col), "links")
    counts = written(pair_counts(links), "pairs").toArrow()
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        most = most_pairs(vocabulary(f.read()), pieces(g.read()))
    if counts.num_rows > most:
        raise ValueError(f"{counts.num_rows} pairs, though at most {most} can end together")
    held = docs.sparkSession.sparkContext.broadcast([c.to_numpy() for c in counts.columns])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        duck = _session()
        duck.register("pairs", pa.table(dict(zip(("a", "b", "n"), held.value, strict=True))))
        duck.execute("create or replace temp table counts as select *, n = max(n) over (partition by b) as best from pairs")
        for batch in (some for whole in batches for some in _slices(whole, "link_a")):
            duck.register("links", _links(batch))
            duck.register("docs", pa.Table.from_batches([batch]).drop_columns(["link_a", "link_b"]).append_column("r", pa.array(np.arange(batch.num_rows))))
            yield from duck.sql(_SCORED).to_arrow_table().to_batches()

    return links.mapInArrow(score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long")
