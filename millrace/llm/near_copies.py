"""Near copies by SimHash: groups of texts that share at least four fifths of their five-word shingles.

Method. A text stands for its set of hashed ``SHINGLE``-word shingles, in lower
case and with spacing ignored. Texts of equal sets are one node. A node has a
SimHash fingerprint of ``WORDS`` times 64 bits, long enough to tell similarity
0.8 (about 15 % of the bits differ) from chance (half of them). Fingerprints
are kept in BK-trees, which give all that lie within ``RADIUS`` bits.

The bits of one fingerprint can't name the shard trees here, as near copies
differ in dozens of them. So a shard tree holds what shares a MinHash bucket,
``BANDS`` bands of ``ROWS`` values; a pair of similarity 0.8 misses all common
buckets with probability (1 - 0.8 ** ROWS) ** BANDS, three in a million. A
bucket of more than ``LARGEST`` nodes has no tree: all of it goes on.

What the trees link is a candidate group, which only says who has to be
compared. Within it the true Jaccard similarity of the sets decides, by an
index of the group's shingles; a search that visits a node once returns edges
that span the links, never all pairs. The sets of a group travel once. A group
of more than ``SLICE`` shingles first meets its hub, a member that stands for
those it links to; only what no hub links to goes against the group's slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .blocks import Block, blocks, mix, ngrams, utf8
from .components import components
from .scratch import written
from .shards import pair_groups, shared_groups, whole_groups
from .simhash import distance, spanned

SHINGLE = 5
#: Least similarity of near copies, as a fraction.
LEAST = (4, 5)
#: 64-bit words of a fingerprint, and bits that may differ: at similarity 0.8 some 39 of 256 do, give or take 6.
WORDS, RADIUS = 4, 72
BANDS, ROWS = 24, 4
#: Nodes of the largest shard tree.
LARGEST = 1024
#: Shingles of a slice of a candidate group.
SLICE = 1 << 20
#: Hubs that a group of several slices meets.
HUBS = 3
SEED = 42

_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(block: Block) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text of fewer words is one shingle, one without words has none."""
    block = Block(block.first, _LOWER[block.data], block.starts)
    words, (_, _, first) = block.word_hashes, block.words
    full = ngrams(words, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(full[a : b - SHINGLE + 1]) if b - a >= SHINGLE else ngrams(words[a:b], b - a) if b > a else full[:0])
    return out


def node_of(hashes: np.ndarray) -> int:
    """A hash of the whole set; zero for an empty one."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """A bit is one where it is set in over half of the set's hashes."""
    total = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(mix(hashes[at : at + 4096, None] ^ _SALTS).view(np.uint8), axis=1).view(np.uint64)
        # 255 rows of 0/1 bytes add up within their byte, eight bytes at a time.
        total += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, 64 * WORDS).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes)).view(np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """The buckets of a set, one for each band; an empty set has none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * _FACTORS).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for value in least.reshape(BANDS, ROWS).T:
        key = (key ^ value) * _MIX
        key ^= key >> np.uint64(29)
    return key


def _sets_of(texts: pa.Array) -> list[np.ndarray]:
    return [x for block in blocks(texts) for x in shingles(block)]


def _lists(values: list[np.ndarray]) -> pa.Array:
    held = np.concatenate([*values, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(held))


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _signed(batches):
    """doc_id and place as they are, then the node, its number of shingles, its fingerprint and its buckets."""
    for batch in batches:
        sets = _sets_of(batch.column(2))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), _longs([node_of(x) for x in sets]), pa.array([len(x) for x in sets], pa.int64()), _lists([fingerprint(x) for x in sets]), _lists([bands(x) for x in sets])],
            names=["doc_id", "place", "node", "size", "print", "bands"],
        )


def _packed(batches):
    """The other columns as they are, with the text compressed, as all texts go through one exchange."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        at = batch.schema.get_field_index("text")
        data, starts = utf8(batch.column(at))
        data = data.tobytes()
        yield batch.set_column(at, "text", pa.array([pack(data[x:y]) for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary()))


def _unpacked(texts: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The shingles of compressed texts, some at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    for text in texts:
        yield from _sets_of(pa.array([unpack(text.as_buffer())], pa.large_binary()))


def _hashed(batches):
    """The other columns as they are, with the text's shingles in its stead."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", _lists(list(_unpacked(batch.column(at)))))


def _linked(batches):
    """Edges that span the links within each bucket of rows that come by bucket."""
    for rows in whole_groups(batches):
        key, node, *words = (c.to_numpy() for c in rows.columns)
        value = np.stack(words, axis=1).view(np.uint64)
        heads, ends, a, b = pair_groups(key)
        near = distance(value[a], value[b]) <= RADIUS
        pairs = [(node[a[near]], node[b[near]])]
        for x, y in zip(heads.tolist(), ends.tolist(), strict=True):
            i, j = spanned(value[x:y], None, RADIUS)
            pairs.append((node[x:y][i], node[x:y][j]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs])) for k in (0, 1)], names=["a", "b"])


def _candidates(distinct: DataFrame) -> DataFrame:
    """Stars (a, b) of candidate groups: each node but the least of its group, with that one."""
    small, large = shared_groups(distinct.select(F.explode("bands").alias("key"), "node"), "node", LARGEST)
    prints = distinct.select(F.col("node").alias("n"), *(F.col("print")[k].alias(f"w{k}") for k in range(WORDS)))
    linked = small.join(prints, F.col("node") == F.col("n")).drop("n").repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "a long, b long")
    hubs = large.groupBy(F.col("key").alias("k")).agg(F.min("node").alias("hub"))
    stars = large.join(hubs, F.col("key") == F.col("k")).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return components(linked.union(stars))


def alike(common: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray) -> bool | np.ndarray:
    """Whether sets of sizes a and b with so many common members have a Jaccard similarity of at least ``LEAST``."""
    over, under = LEAST
    return common * (over + under) >= over * (a + b)


def spanning(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Places of sets whose edges span all pairs of similarity ``LEAST`` or more.

    A set that was reached leaves the index, which is cut anew each time half
    of its sets have gone, so dense groups cost about their own size.
    """
    if len(sets) == 2:
        near = alike(len(np.intersect1d(*sets, assume_unique=True)), *map(len, sets))
        return ([0], [1]) if near else ([], [])
    sizes = np.array([len(x) for x in sets])
    offsets = np.append(0, np.cumsum(sizes))
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posted = np.repeat(np.arange(len(sets)), sizes)[order]
    heads = np.append(0, np.cumsum(np.bincount(code)))
    waiting, left, indexed = np.ones(len(sets), bool), len(sets), len(sets)
    a, b = [], []
    for start in range(len(sets)):
        if not waiting[start]:
            continue
        waiting[start], left, stack = False, left - 1, [start]
        while stack and left:
            if left * 2 < indexed:
                stay = waiting[posted]
                heads, posted, indexed = np.append(0, np.cumsum(stay))[heads], posted[stay], left
            at = stack.pop()
            own = code[offsets[at] : offsets[at + 1]]
            count = heads[own + 1] - heads[own]
            places = np.repeat(heads[own] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            common = np.bincount(posted[places], minlength=len(sets))
            near = np.flatnonzero(waiting & (common > 0) & alike(common, sizes, sizes[at]))
            waiting[near] = False
            left -= len(near)
            a.extend([at] * len(near))
            b.extend(near.tolist())
            stack.extend(near.tolist())
    return a, b


def _compared(batches):
    """Edges within each group of rows (key, node, text) that come by key; a node that a group has twice counts once.

    text is a compressed text, or the array of its shingles.
    """
    for rows in whole_groups(batches):
        key, node = rows.column("key").to_numpy(), rows.column("node").to_numpy()
        texts = rows.column("text").combine_chunks()
        if packed := pa.types.is_binary(texts.type):
            sets = texts
        else:
            offsets, values = texts.offsets.to_numpy(), texts.values.to_numpy().view(np.uint64)
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        a, b = [node[:0]], [node[:0]]
        for group in np.split(np.arange(len(key)), heads[1:]):
            group = group[np.unique(node[group], return_index=True)[1]]
            if len(group) > 1:
                held = list(_unpacked(sets.take(pa.array(group)))) if packed else [values[offsets[r] : offsets[r + 1]] for r in group.tolist()]
                x, y = spanning(held)
                a.append(node[group[x]] if x else node[:0])
                b.append(node[group[y]] if y else node[:0])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _of_large_groups(sets: DataFrame) -> DataFrame:
    """Edges (a, b) within groups of several slices; ``sets`` has root, slices, slice, node and text."""
    left, edges = sets.select("root", "node", "text"), None
    for _ in range(HUBS):
        hubs = left.groupBy("root").agg(F.min("node").alias("hub")).withColumnRenamed("root", "r")
        hubs = written(sets.join(hubs, F.expr("root = r and node = hub")).select("r", "hub", F.col("text").alias("held")), "hubs")
        near = alike(F.size(F.array_intersect("text", "held")), F.size("text"), F.size("held"))
        met = written(left.join(hubs, F.col("root") == F.col("r")).select("root", "node", "hub", near.alias("near")), "met")
        found = met.where("near and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        edges = found if edges is None else edges.union(found)
        far = met.where("not near").select(F.col("root").alias("r"), F.col("node").alias("n"))
        left = left.join(far, F.expr("root = r and node = n"), "left_semi")
    left = written(left, "left")
    parts = left.groupBy(F.col("root").alias("r")).agg(F.ceil(F.sum(F.size("text")) / SLICE).cast("int").alias("parts"))
    left = left.join(parts, F.col("root") == F.col("r")).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    every = left.select("root", "parts", "part", "node", "text")
    slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    asked = every.join(sets.select(F.col("root").alias("r"), "slices").distinct(), F.col("root") == F.col("r")).select("root", "part", slices.alias("slice"), "node", "text")
    held = sets.join(parts, F.col("root") == F.col("r")).select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "slice", "node", "text")
    rows = asked.unionByName(held).select(F.xxhash64("root", "part", "slice").alias("key"), "node", "text")
    return edges.union(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compared, "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place (a hash of the text) and component_id, the smallest doc_id that links of similarity ``LEAST`` or more lead to.

    Defined cases: null texts and those without words are copies of one
    another and of nothing else; a text of fewer than five words is one
    shingle; rows that repeat a doc_id are documents of their own with that
    id; a row without doc_id gets the component of its text, whose id is null
    if all its documents have none; an empty table gives none; columns other
    than the two named are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("place"), "text")
    prints = written(docs.mapInArrow(_signed, "doc_id long, place long, node long, size long, print array<long>, bands array<long>"), "prints")
    distinct = written(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "place")).alias("first"), F.max("size").alias("size"), F.max("print").alias("print"), F.max("bands").alias("bands")), "distinct")
    candidates = _candidates(distinct)
    groups = candidates.select(F.col("a").alias("n"), F.col("b").alias("root")).union(candidates.select("b", "b").distinct())
    groups = written(groups.join(distinct, F.col("n") == F.col("node")).select("node", "root", "size", "first.*"), "groups")
    sizes = written(groups.groupBy(F.col("root").alias("r")).agg(F.ceil(F.sum("size") / SLICE).cast("int").alias("slices")), "sizes")
    dealt = groups.join(sizes, F.col("root") == F.col("r")).select("node", "root", "slices", F.pmod(F.xxhash64("node"), "slices").cast("int").alias("slice"), F.col("doc_id").alias("d"), F.col("place").alias("p"))
    # Each text goes through one exchange, whatever the number of candidates, so the plan is the same at every size.
    packed = docs.mapInArrow(_packed, "doc_id long, place long, text binary")
    texts = packed.join(written(dealt, "dealt").hint("shuffle_hash"), F.expr("doc_id <=> d and place = p")).select("node", "root", "slices", "slice", "text")
    small, large = texts, None
    if not sizes.where("slices > 1").isEmpty():
        texts = written(texts, "candidates")
        small, large = texts.where("slices = 1"), texts.where("slices > 1")
        large = written(large.mapInArrow(_hashed, "node long, root long, slices int, slice int, text array<long>"), "sets")
    edges = small.select(F.col("root").alias("key"), "node", "text").repartition("key").sortWithinPartitions("key").mapInArrow(_compared, "a long, b long")
    stars = components(edges if large is None else edges.union(_of_large_groups(large))).withColumnsRenamed({"a": "n", "b": "root"})
    rooted = distinct.join(stars, F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = written(rooted.join(least, F.col("root") == F.col("r")).select(F.col("node").alias("n"), "component_id"), "components")
    return prints.join(named, F.col("node") == F.col("n")).select("doc_id", "place", "component_id")


def one_of_each_copy(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose group of near copies has one of smaller id; a row without doc_id stays."""
    gone = near_copies(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("place").alias("_place"))
    gone = written(gone.distinct(), "gone")
    return docs.join(gone, (docs["doc_id"] == gone["_gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_place"]), "left_anti")
