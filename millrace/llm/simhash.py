"""SimHash near-duplicates, found with BK-trees.

Method. Each text gets a 64-bit fingerprint: the majority of the XXH64
hashes of its three-word shingles, bit by bit. Fingerprints link where at
most ``RADIUS`` bits differ. Distinct fingerprints are kept in BK-trees,
whose children are keyed by their integer Hamming distance to the parent; a
query follows only the edges within the radius of its own distance.

One tree over a corpus is searched by N^0.6 nodes for a query (measured on random fingerprints: 157 of 2,000, 675
of 20,000, 1,746 of 100,000), and all of it would have to be broadcast. So there is a shard tree for every
key: fingerprints are cut into ``PARTS`` parts, and of linked ones at least
``PARTS`` - ``RADIUS`` parts agree, hence a tree for each choice of that many
parts and their value. A key with more than ``LARGEST`` fingerprints is keyed
anew by the bits that it leaves open, and so on: as the fingerprints are
distinct, few rounds leave no such key, and no task ever holds a larger tree.
Trees return a spanning forest of their links, never all pairs, and the
forests meet in connected components.

The shard trees stay in the tasks that their keys are dealt to. To broadcast
them, all fingerprints would have to go through the driver: at 8 bytes for each of some 500 documents a MB that is 0.12 GB
at 30 GB of documents and 410 GB at 100 TB, before any tree.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .blocks import mix, utf8
from .components import components
from .scratch import written
from .shards import pair_groups, shared_groups, whole_groups

RADIUS = 3
PARTS = 5
SEED = 42
SHINGLE = 3
#: Shingles whose hashes are held at a time.
TOGETHER = 1 << 15
#: Fingerprints of the largest shard tree.
LARGEST = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    count, digest, sums = max(len(words) - shingle + 1, 1), xxhash.xxh64_digest, np.zeros(64, np.int64)
    # Some shingles at a time: their bits are eight times as large as their hashes.
    for at in range(0, count, TOGETHER):
        spans = zip(begins[at : min(at + TOGETHER, count)].tolist(), ends[min(at + shingle, len(words)) - 1 :][:TOGETHER].tolist(), strict=False)
        hashes = b"".join(digest(joined[a:b], seed) for a, b in spans)
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).view(np.uint64).reshape(-1, 8)
        # 255 rows of 0/1 bytes add up within their byte, eight bytes at a time.
        sums += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > count).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        data, starts = utf8(batch.column(1))
        data = data.tobytes()
        found = [fingerprint(data[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fingerprint"])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ; fingerprints of several words have them along the last axis."""
    bits = np.bitwise_count(a ^ b)
    return bits.astype(np.int64) if bits.ndim < 2 else bits.sum(axis=-1, dtype=np.int64)


class BKTree:
    """A BK-tree of distinct fingerprints: the first is the root, the others hang below it by distance.

    ``children`` has, for each distance to the root, the tree of what lies there.
    """

    def __init__(self, values: np.ndarray, places: np.ndarray | None = None) -> None:
        places = np.arange(len(values)) if places is None else places
        self.value, self.place, self.children = values[places[:1]], places[0], {}
        if len(places) > 1:
            rest = places[1:]
            far = distance(values[rest], self.value)
            self.children = {int(d): BKTree(values, rest[far == d]) for d in np.unique(far)}

    def within(self, queries: np.ndarray, radius: int, rows: np.ndarray | None = None):
        """Yields a node's place with the rows of the queries that lie within the radius of it."""
        stack = [(self, np.arange(len(queries)) if rows is None else rows)]
        while stack:
            node, rows = stack.pop()
            far = distance(queries[rows], node.value)
            near = rows[far <= radius]
            if len(near):
                yield node.place, near
            for edge, child in node.children.items():
                if len(on := rows[np.abs(far - edge) <= radius]):
                    stack.append((child, on))


def spanned(tree_of: np.ndarray, queries: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of edges that span the links of the queries (none: of the members) to the members of a tree; queries come after members."""
    asked, shift = (tree_of, 0) if queries is None else (queries, len(tree_of))
    label, members = np.arange(shift + len(asked)), {}
    for place, near in BKTree(tree_of).within(asked, radius):
        joined = np.unique(label[np.append(near + shift, place)])
        if len(joined) > 1:
            # The smaller groups take the largest one's label, so no row is relabelled more than log n times.
            *small, large = sorted((members.pop(k, [k]) for k in joined.tolist()), key=len)
            to = label[large[0]]
            for group in small:
                label[group] = to
                large.extend(group)
            members[int(to)] = large
    linked = np.flatnonzero(label != np.arange(len(label)))
    return linked, label[linked]


def forest(tree_of: np.ndarray, queries: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of ``spanned`` as fingerprints."""
    values = tree_of if queries is None else np.concatenate((tree_of, queries))
    a, b = spanned(tree_of, queries, radius)
    return values[a], values[b]


def _choices(mask: int, parts: int, radius: int) -> list[int]:
    """The bits of each choice of parts of what ``mask`` leaves open, with those of ``mask``."""
    open_bits = [b for b in range(64) if not mask >> b & 1]
    bounds = np.linspace(0, len(open_bits), parts + 1).astype(int)
    values = [sum(1 << b for b in open_bits[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return [mask | sum(chosen) for chosen in combinations(values, parts - radius)]


def _keys(parts: int, radius: int):
    """The keys of fingerprints that share a key so far: a hash of it and of the bits that another choice of parts adds."""

    def keys(batches):
        for batch in batches:
            key, mask, value = (c.to_numpy().view(np.uint64) for c in batch.columns)
            for held in np.unique(mask):
                on = mask == held
                for i, chosen in enumerate(_choices(int(held), parts, radius)):
                    new = (key[on] ^ mix(value[on] & np.uint64(chosen))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((i + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
                    columns = (mix(new), np.full(on.sum(), chosen, np.uint64), value[on])
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["key", "mask", "fingerprint"])

    return keys


def _linked(radius: int):
    """Edges within each key of rows that come by key."""

    def search(batches):
        for rows in whole_groups(batches):
            key, value = rows.column(0).to_numpy(), rows.column(1).to_numpy().view(np.uint64)
            heads, ends, a, b = pair_groups(key)
            near = distance(value[a], value[b]) <= radius
            pairs = [(value[a[near]], value[b[near]])]
            pairs += [forest(value[x:y], None, radius) for x, y in zip(heads.tolist(), ends.tolist(), strict=True)]
            a, b = (np.concatenate([p[i] for p in pairs]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return search


def links(fingerprints: DataFrame, radius: int = RADIUS, parts: int = PARTS, largest: int = LARGEST) -> DataFrame:
    """Edges (a, b) that span the links between the distinct values of ``fingerprint``."""
    rows, found = fingerprints.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("mask"), "fingerprint"), None
    while True:
        keyed = rows.mapInArrow(_keys(parts, radius), "key long, mask long, fingerprint long")
        small, large = shared_groups(keyed, "fingerprint", largest)
        edges = small.select("key", "fingerprint").repartition("key").sortWithinPartitions("key").mapInArrow(_linked(radius), "a long, b long")
        edges = written(edges, "links")
        found = edges if found is None else found.union(edges)
        rows = written(large, "large")
        if rows.isEmpty():
            return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links lead to.

    Defined cases: a null text or one without words has fingerprint zero and
    links like any other; a text of fewer than three words is one shingle;
    rows that repeat a doc_id are documents of their own with that id; a row
    without doc_id gets the component of its fingerprint, whose id is null if
    all its documents have none; a bit set in exactly half the hashes is 0; of a very long text all shingles
    count, some at a time; an empty table gives none; columns other
    than the two named are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = written(docs.mapInArrow(_fingerprints, "doc_id long, fingerprint long"), "prints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    stars = components(links(distinct, radius, parts)).withColumnsRenamed({"a": "node", "b": "root"})
    rooted = distinct.join(stars, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = written(rooted.join(least, F.col("root") == F.col("r")).select(F.col("fingerprint").alias("f"), "component_id"), "components")
    out = prints.join(named, F.col("fingerprint") == F.col("f"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """``docs`` without the documents whose group of near-duplicates has one of smaller id; a row without doc_id stays."""
    groups = near_duplicates(docs, radius=radius, parts=parts)
    gone = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
