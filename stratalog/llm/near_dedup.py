"""SimHash near-duplicate removal at a similarity: the pipeline's stage for operator 5.

The stage's texts are near duplicates if their sets of five-word shingles have a Jaccard similarity
of 0.8 or more. It uses operator 5's fingerprints and its Gray-order index, with a distance that fits
that similarity, and checks what they find on whole texts.

1. A text is the set of 64-bit hashes of its shingles; its fingerprint is their bitwise majority.
   Sets of similarity 0.8 have a cosine of 8/9: fingerprints differ in 9.7 of 64 bits on average,
   with a standard deviation of 2.9. ``DISTANCE`` is 4.9 deviations above.
2. No block of bits agrees at that distance, so the upper nodes of the index are shingles instead.
   All shingles have one order: by hash, and after all others those that are common in a sample,
   rarest first (the order decides only what a search costs). Two sets of similarity 0.8 share
   0.8 of either, so they meet in the first n - ceil(0.8 n) + 1 shingles of both. Only these are
   sent to buckets.
3. In a bucket, fingerprints are sorted by Gray rank. Each text is first paired with its neighbour in
   that order and with the first text of fitting size, if within ``DISTANCE``. Pairs are checked on the shingle sets of the
   whole texts, and components are made. Only then are the buckets searched: the hierarchical index
   finds the pairs within ``DISTANCE``, of which those of different components, fitting sizes and
   fitting parities are checked. First each text's nearest such pair alone, then, with the components
   that this makes, all of them. A large group of near copies so costs pairs linear in its size.
4. Parities: bit i of ``PARITY_BITS`` tells whether an odd number of a set's shingles hash to i. Two sets' parities
   differ in at most as many bits as the sets in shingles, of which similarity 0.8 allows a ninth of both sizes. This
   loses no pair, and leaves few that are not alike, at sizes up to about twice ``PARITY_BITS``; far longer texts are told apart by fingerprint and size only.

Of pairs at exactly 0.8, a few in a million are beyond the distance by chance, more where sets hold only
four or five shingles (one in ten thousand); tests measure the recall against brute force.

Cases: null text and text without words are one set; texts below five words are one shingle. A row
goes by id and text, so a repeated id loses only the rows that were judged copies; rows without an
id stay; an empty table gives an empty result. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, release, text_or_empty
from .components import components
from .simhash import LOWER, GrayIndex, gray_rank, majority, ones_of

SHINGLE = 5
#: Bits that fingerprints of texts of similarity 0.8 differ in at most, but for chance.
DISTANCE = 24
#: (query, fingerprint) pairs that one search may look at, at most. At this distance few groups are
#: pruned, and a pair takes about 80 bytes: more of them, in two workers beside a full heap, are more than an executor has.
SLICE = 1 << 18
#: A multiple of 64.
PARITY_BITS = 1024
#: Documents in the sample for common shingles, and the common shingles taken, at most.
SAMPLE, COMMON = 20_000, 100_000


def shingle_set(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The sorted hashes of the text's shingles; known: hashes of words met before."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(1, np.int64)
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique((h ^ (h >> np.uint64(31))).view(np.int64))


def parities(s: np.ndarray) -> bytes:
    """Of each of ``PARITY_BITS`` residues, whether an odd number of the hashes have it."""
    odd = np.bincount(s & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _parity_words(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint64).reshape(-1, PARITY_BITS // 64)


def _parity_distance(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows a of x differ from rows b of y."""
    out = np.zeros(len(a), np.int64)
    for j in range(x.shape[1]):
        out += np.bitwise_count(x[a, j] ^ y[b, j])
    return out


def prefix(s: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which two sets of similarity 0.8 share one; common is sorted."""
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        is_common = common[at] == s
        s = np.concatenate((s[~is_common], s[is_common][np.argsort(rank[at[is_common]], kind="stable")]))
    return s[: len(s) - (4 * len(s) + 4) // 5 + 1]


def _key() -> Column:
    return F.xxhash64(text_or_empty())


def _sets(texts: DataFrame, common: np.ndarray | None = None, rank: np.ndarray | None = None) -> DataFrame:
    """v, n, fp, parity, s: sizes, fingerprints, parities and shingle sets of rows (v, t), or their
    prefixes if common is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, int] = {}
            sets = [shingle_set(t, known) for t in batch.column(1).to_pylist()]
            n = pa.array([len(s) for s in sets], pa.int64())
            fps = np.array([majority(ones_of(s), len(s)) for s in sets], np.uint64)
            odd = pa.array([parities(s) for s in sets], pa.binary())
            if common is not None:
                sets = [prefix(s, common, rank) for s in sets]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            columns = [batch.column(0), n, pa.array(fps.view(np.int64)), odd, pa.ListArray.from_arrays(pa.array(ends), flat)]
            yield pa.RecordBatch.from_arrays(columns, ["v", "n", "fp", "parity", "s"])

    return bounded_batches(texts.select("v", "t")).mapInArrow(run, "v long, n long, fp long, parity binary, s array<long>")


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles met in three or more texts of a sample, sorted, and their ranks by count."""
    every = max(1, -(-texts.count() // SAMPLE))
    sample = texts.where(F.pmod(F.xxhash64("v"), F.lit(every)) == 0)
    counts = _sets(sample).select(F.explode("s").alias("h")).groupBy("h").count().where("count >= 3")
    rows = counts.orderBy(F.desc("count"), "h").limit(COMMON).toPandas()
    h, n = rows["h"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _by_bucket(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(columns) -> record batches, over rows partitioned and sorted by their first column, a
    number of whole buckets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows < 100_000 or held[0][0][0] == held[-1][0][-1]:
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last bucket may go on
            yield from work([c[:cut] for c in columns])
            held = [[c[cut:] for c in columns]]
            rows = len(held[0][0])
        if held:
            yield from work([np.concatenate(c) for c in zip(*held)])

    first = rows.columns[0]
    return rows.repartition(first).sortWithinPartitions(first).mapInArrow(run, schema)


def _first_pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """h, a, b, n, fp: pairs (n is null), and the rows of buckets whose pairs these are not all (b is
    null)."""
    h, v, n, fp = columns
    order = np.lexsort((v, n, h))
    h, v, n, fp = h[order], v[order], n[order], fp[order]
    bucket = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))) - 1
    size = np.bincount(bucket)
    many = np.flatnonzero(size[bucket] > 1)
    if not len(many):
        return
    # The first of the bucket with 5 n' >= 4 n: sizes of a bucket rise, so buckets and sizes give one sorted key.
    top = int(n.max()) + 1
    first = np.searchsorted(bucket * top + n, bucket[many] * top + (4 * n[many] + 4) // 5)
    # The neighbour in Gray order.
    gray = np.lexsort((gray_rank(fp.view(np.uint64)), h))
    near = bucket[gray[1:]] == bucket[gray[:-1]]
    left, right = gray[:-1][near], gray[1:][near]
    near = 5 * np.minimum(n[left], n[right]) >= 4 * np.maximum(n[left], n[right])
    fits = first < many
    x = np.concatenate((many[fits], left[near]))
    y = np.concatenate((first[fits], right[near]))
    bits = fp.view(np.uint64)
    close = np.bitwise_count(bits[x] ^ bits[y]) <= DISTANCE
    a, b = v[x[close]], v[y[close]]
    rest = np.flatnonzero(size[bucket] > 2)
    none, nones = pa.nulls(len(a), pa.int64()), pa.nulls(len(rest), pa.int64())
    names = ["h", "a", "b", "n", "fp"]
    yield pa.RecordBatch.from_arrays([none, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none], names)
    yield pa.RecordBatch.from_arrays([pa.array(h[rest]), pa.array(v[rest]), nones, pa.array(n[rest]), pa.array(fp[rest])], names)


def _other_pairs(columns: list[np.ndarray], nearest: bool = False) -> Iterator[pa.RecordBatch]:
    """a, b: the pairs of each bucket within DISTANCE that lie in different components and fit in
    size, and in parities if these are given; with nearest, only that of each text whose parities
    differ least."""
    h, v, n, fp, c, *parity = columns
    start, end = _runs(h)
    mixed = np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)
    keep = np.repeat(mixed, end - start)
    if not keep.any():
        return
    h, v, n, fp, c = h[keep], v[keep], n[keep], fp[keep].view(np.uint64), c[keep]
    order = np.lexsort((gray_rank(fp), h))
    h, v, n, fp, c = h[order], v[order], n[order], fp[order], c[order]
    odd = _parity_words(parity[0][keep][order]) if parity else np.zeros((len(h), 0), np.uint64)
    root = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))) - 1
    index = GrayIndex(fp, root)
    size = np.bincount(root)[root]
    slices = np.flatnonzero(np.diff(np.cumsum(size) // SLICE)) + 1
    for part in np.split(np.arange(len(h)), slices):
        q, leaf = index.links(part, root[part], DISTANCE, whole_groups=False)
        ok = ((q < leaf) | nearest) & (c[q] != c[leaf]) & (5 * np.minimum(n[q], n[leaf]) >= 4 * np.maximum(n[q], n[leaf]))
        q, leaf = q[ok], leaf[ok]
        differ = _parity_distance(odd, odd, q, leaf)
        ok = 9 * differ <= n[q] + n[leaf]
        q, leaf, differ = q[ok], leaf[ok], differ[ok]
        if nearest and len(q):
            by = np.lexsort((leaf, differ, q))
            by = by[np.concatenate(([True], np.diff(q[by]) != 0))]
            q, leaf = q[by], leaf[by]
        a, b = v[q], v[leaf]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return start, np.append(start[1:], len(x))


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose whole texts have similarity 0.8 or more."""
    pairs = materialize(pairs.distinct(), "near-pairs")
    needed = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    sets = materialize(_sets(texts.join(needed, "v", "left_semi").dropDuplicates(["v"])), "near-sets")
    one, two = (sets.select(F.col("v").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    shared, both = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    # shared / (both - shared) >= 4 / 5
    found = pairs.join(one, "a").join(two, "b").where(shared * 9 >= both * 4).select("a", "b")
    return materialize(found, "near-similar")


def _fitting(pairs: DataFrame, parity: DataFrame) -> DataFrame:
    """The pairs (a, b) that fit in parities. parity: v, n, parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            x, y = (_parity_words(batch.column(i).to_pylist()) for i in (4, 5))
            at = np.arange(len(na))
            ok = 9 * _parity_distance(x, y, at, at) <= na + nb
            yield batch.select([0, 1]).filter(pa.array(ok))

    one, two = (parity.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab")
    both = pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "na", "nb", "pa", "pb")
    return both.mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame) -> DataFrame:
    """(v, component) of each text hash that is linked and not its component itself."""
    spark = docs.sparkSession
    texts = docs.select(_key().alias("v"), text_or_empty().alias("t"))
    sets = materialize(_sets(texts, *_common(texts)), "near-prefixes")
    parity = sets.select("v", "n", "parity").dropDuplicates(["v"])
    prefixes = sets.select(F.explode("s").alias("h"), "v", "n", "fp")
    met = materialize(_by_bucket(prefixes, _first_pairs, "h long, a long, b long, n long, fp long"), "near-met")
    release(spark)
    links = materialize(_similar(_fitting(met.where("b IS NOT NULL AND a <> b").select("a", "b"), parity), texts), "near-links")
    rest = met.where("b IS NULL").select("h", F.col("a").alias("v"), "n", "fp")
    for nearest in (True, False):
        found = materialize(components(links), "near-found")
        named = parity.select("v", "parity").join(found, "v", "left").select("v", F.coalesce("component", "v").alias("c"), "parity")
        rows = rest.join(named, "v").select("h", "v", "n", "fp", "c", "parity")
        more = _similar(_by_bucket(rows, partial(_other_pairs, nearest=nearest), "a long, b long"), texts)
        links = links.unionByName(more)
        release(spark)
    return components(links)


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component, the document with the smallest id."""
    rows = docs.select("doc_id", _key().alias("near_key"))
    named = rows.join(near_components(docs).withColumnRenamed("v", "near_key"), "near_key", "left")
    named = materialize(named.select("doc_id", "near_key", F.coalesce("component", "near_key").alias("c")), "near-named")
    least = named.groupBy("c").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = named.join(least, "c").where("doc_id <> least").select("doc_id", "near_key").distinct()
    kept = (docs["doc_id"] == gone["doc_id"]) & (_key_of(docs) == gone["near_key"])
    return docs.join(gone.hint("shuffle_hash"), kept, "left_anti").select(*docs.columns)


def _key_of(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
