"""SimHash near-duplicate detection with a Gray-order hierarchical index.

1. A map computes each text's 64-bit fingerprint from the XXH64 of its shingles.
2. Equal fingerprints are one vertex: a map-side minimum of their document ids, so exact copies
   never meet in one task.
3. Two fingerprints within ``DISTANCE`` bits agree in one of ``DISTANCE + 1`` blocks of bits. Each
   fingerprint is sent to one bucket a block; equal block values meet. A bucket above
   ``BUCKET_LIMIT`` fingerprints is divided again, by which of the same number of blocks of its
   *other* bits agree, which loses no link; what is still too large after that is searched in
   slices of queries, so memory stays fixed.
4. In a bucket, fingerprints are sorted by Gray rank, so that neighbours differ in few bits, and
   grouped bottom-up by ``FANOUT``. A node holds the bits that all fingerprints below share and
   that its parent does not already hold (mask and pattern). A search starts at the roots, adds
   the differences from each node's factored-out bits to those of its ancestors, and drops a whole
   group once the sum exceeds the distance; all (query, node) pairs of a level are computed at
   once. A group whose remaining free bits can't exceed the distance is taken whole.
5. A bucket returns a spanning forest of its links, not its pairs: at most one edge a fingerprint.
   Components are then found by distributed star rounds, and named by their smallest document id.

A bucket is the part of the index below one upper node: the block's bits are what that node factors
out. One index over all fingerprints, cut into ranges of Gray order, would have to send every query
to all ranges whose upper node is within the distance: with 2^17 ranges that is to 834 of them, where
the blocks send it to four.

Cases: null text and text without words have fingerprint zero and link like any other; repeated
rows and equal texts have equal fingerprints; documents without an id link others like any document,
but a component is named by the smallest id in it (null if it has none); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .components import components

#: Fixed by the contract.
SHINGLE = 3
SEED = 42
DISTANCE = 3

FANOUT = 8
BUCKET_LIMIT = 4096
#: (query, fingerprint of its bucket) pairs that one search may look at, at most.
SLICE_PAIRS = 4_000_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(words)) - 1 :][:n].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    ones = np.zeros(64, np.int64)
    pairs = list(zip(starts[:n].tolist(), last))
    for at in range(0, n, 1 << 16):
        part = pairs[at : at + (1 << 16)]
        ones += ones_of(np.fromiter((digest(view[a:b], SEED) for a, b in part), np.uint64, len(part)))
    return majority(ones, n)


def ones_of(h: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that are set in over half of n hashes."""
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return bounded_batches(rows).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order: the inverse of x ^ (x >> 1)."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """The hierarchical index over buckets of fingerprints, sorted by (bucket, Gray rank)."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray):
        self.fps = fps
        self.levels: list[tuple] = []  # leaves first: pattern, mask of shared bits, first child, end
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        pattern, mask = fps, np.full(len(fps), ~np.uint64(0))
        self.levels.append((pattern, mask, None, None))
        owner = bucket
        while len(owner) > len(start):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.concatenate((first, [len(owner)])))
            place = np.arange(len(owner)) - np.repeat(first, size)
            heads = np.flatnonzero(place % FANOUT == 0)
            all_and = np.bitwise_and.reduceat(pattern, heads)
            all_or = np.bitwise_or.reduceat(pattern, heads)
            shared = np.bitwise_and.reduceat(mask, heads) & ~(all_and ^ all_or)
            pattern, mask = all_and & shared, shared
            self.levels.append((pattern, mask, heads, np.append(heads[1:], len(owner))))
            owner = owner[heads]

    def close_groups(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves below nodes with at most ``distance`` free bits, each with its node's first leaf:
        they all link to each other."""
        a, b = [], []
        leaf = np.arange(len(self.fps))
        for pattern, mask, first, _ in self.levels[1:]:
            leaf = leaf[first]
            size = np.diff(np.append(leaf, len(self.fps)))
            close = np.repeat(64 - np.bitwise_count(mask) <= distance, size)
            a.append(np.repeat(leaf, size)[close])
            b.append(np.flatnonzero(close))
        return (np.concatenate(a), np.concatenate(b)) if a else (leaf[:0], leaf[:0])

    def links(self, queries: np.ndarray, root: np.ndarray, distance: int, whole_groups: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(query position, leaf position) of links; root: each query's root. Of a group that is
        taken whole only the first leaf is named; close_groups has the others. Without
        whole_groups, all links are named."""
        q, node = queries, root
        taken: list = []
        first_leaf = [np.arange(len(self.fps))]
        for _, _, first, _ in self.levels[1:]:
            first_leaf.append(first_leaf[-1][first])
        diff = np.zeros(len(q), np.int64)
        held = np.zeros(len(q), np.uint64)  # bits that ancestors have compared
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, mask, first, end = self.levels[level]
            new = mask[node] & ~held
            diff = diff + np.bitwise_count((self.fps[q] ^ pattern[node]) & new)
            keep = diff <= distance
            q, node, diff = q[keep], node[keep], diff[keep]
            if level:
                whole = (diff + (64 - np.bitwise_count(mask[node]).astype(np.int64)) <= distance) & whole_groups
                taken.append((q[whole], first_leaf[level][node[whole]]))
                q, node, diff = q[~whole], node[~whole], diff[~whole]
                held = mask[node]
                n = end[node] - first[node]
                at = np.repeat(np.arange(len(q)), n)
                step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                node = first[node][at] + step
                q, diff, held = q[at], diff[at], held[at]
        taken.append((q, node))
        return np.concatenate([t[0] for t in taken]), np.concatenate([t[1] for t in taken])


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of many pairs at once: roots are hooked to smaller roots until nothing changes."""
    while True:
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return parent
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _find(parent)


def forest(fps: np.ndarray, bucket: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of a spanning forest of the links within buckets; bucket ids are sorted."""
    order = np.lexsort((gray_rank(fps), bucket))
    fps, bucket = fps[order], bucket[order]
    start = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    root = np.cumsum(start) - 1
    size = np.bincount(root)[root]
    index = GrayIndex(fps, bucket)
    parent = _join(np.arange(len(fps)), *index.close_groups(distance))
    queries = np.flatnonzero(size > 1)
    slices = np.flatnonzero(np.diff(np.cumsum(size[queries]) // SLICE_PAIRS)) + 1
    for part in np.split(queries, slices):
        q, leaf = index.links(part, root[part], distance)
        parent = _join(parent, q, leaf)
    linked = np.flatnonzero(parent != np.arange(len(fps)))
    return order[linked], order[parent[linked]]


def _blocks(distance: int, bits: int) -> list[tuple[int, int]]:
    """(shift, width) of distance + 1 blocks that cover ``bits`` bits."""
    cuts = [round(bits * i / (distance + 1)) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _block_value(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _bucket_forest(sorted_rows: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) between the vertices of rows (key, fp, v) that are partitioned and sorted by
    key."""

    def edges(key, fp, v):
        a, b = forest(fp.view(np.uint64), np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))), distance)
        return pa.RecordBatch.from_arrays([pa.array(v[a]), pa.array(v[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n = sum(len(h[0]) for h in held)
            if n < 50_000:
                continue
            key, fp, v = (np.concatenate(c) for c in zip(*held))
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if cut:
                yield edges(key[:cut], fp[:cut], v[:cut])
                key, fp, v = key[cut:], fp[cut:], v[cut:]
            held = [[key, fp, v]]
        if held:
            key, fp, v = (np.concatenate(c) for c in zip(*held))
            if len(key):
                yield edges(key, fp, v)

    return sorted_rows.mapInArrow(run, "a long, b long")


def link_edges(vertices: DataFrame, distance: int = DISTANCE, limit: int = BUCKET_LIMIT) -> DataFrame:
    """A graph with the same components as all links between the fingerprints of ``vertices``
    (fp, v), one row a fingerprint."""
    blocks = _blocks(distance, 64)
    fp = F.col("fp")
    sent = vertices.select(
        "fp", "v", F.posexplode(F.array(*[_block_value(fp, s, w) for s, w in blocks])).alias("block", "value")
    )
    # (value, block) in one long: blocks are 16 bits wide.
    sent = sent.select("fp", "v", (F.col("value") * len(blocks) + F.col("block")).alias("key"))
    hot = sent.groupBy("key").count().where(F.col("count") > limit).select("key")
    hot = materialize(hot, "simhash-hot")
    one = _bucket_forest(_dealt(sent if hot.isEmpty() else sent.join(hot, "key", "left_anti").select("fp", "v", "key")), distance)
    if hot.isEmpty():
        return one
    # Of a hot bucket's other bits, gathered into one value, again distance + 1 blocks.
    block = F.pmod("key", F.lit(len(blocks)))
    rest = F.lit(None).cast("long")
    for i, (s, w) in enumerate(blocks):
        low = fp.bitwiseAND(F.lit((1 << s) - 1))
        high = F.shiftleft(F.shiftrightunsigned(fp, s + w), s) if s + w < 64 else F.lit(0).cast("long")
        rest = F.when(block == i, high.bitwiseOR(low)).otherwise(rest)
    inner = _blocks(distance, 64 - 64 // len(blocks))
    again = (
        sent.join(hot, "key", "left_semi")
        .withColumn("rest", rest)
        .select("fp", "v", "key", F.posexplode(F.array(*[_block_value(F.col("rest"), s, w) for s, w in inner])).alias("sub", "subvalue"))
        .select("fp", "v", F.xxhash64("key", "sub", "subvalue").alias("key"))
    )
    return one.unionByName(_bucket_forest(_dealt(again), distance))


def _dealt(sent: DataFrame) -> DataFrame:
    return sent.select("key", "fp", "v").repartition("key").sortWithinPartitions("key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-prints")
    vertices = materialize(
        prints.groupBy("fp").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("n")), "simhash-vertices"
    )
    found = components(link_edges(vertices.select("fp", F.col("fp").alias("v")), distance)).withColumnRenamed("v", "fp")
    grouped = vertices.join(found, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    names = grouped.groupBy("root").agg(F.min("v").alias("c"), F.sum("n").alias("size")).where("size > 1")
    named = grouped.select("fp", "root").join(names, "root").select("fp", "c")
    return prints.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("c", "doc_id").alias("component_id"),
    )
