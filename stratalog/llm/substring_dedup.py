"""Substring deduplication with a compressed FM-index per shard.

A document's words that a repeated window covers are removed: a window is ``WINDOW`` words, and it
is repeated if it also starts in a document with a smaller id.

1. Fragments. Each window is assigned the least hash of its ``GRAM``-word grams (its minimiser);
   consecutive windows with the same minimiser form one fragment. Equal windows have equal
   minimisers, wherever they are, so they meet if fragments are dealt by minimiser.
2. Minimisers that occur in one document only can't hold a repeated window. A narrow aggregation
   (map-side minimum, maximum, count) finds the shared ones, and a bit map of at most ``MAP_BITS``
   bits, filled by the executors a segment each and broadcast, lets only their fragments through.
   A bit set by chance costs work, never a result; the fuller the map, the more goes on.
3. A shared minimiser with over ``HOT`` occurrences (more where there are so many that ``HOT_COUNT``
   would be exceeded) in many different fragments (their hashes set ``HOT_BITS`` of 64 bits, as about ninety do)
   is dealt by window instead: each of its windows is a fragment of its own, keyed by its own hash, so that the
   many contexts around a passage spread over all tasks. Inside a passage fragments are equal, however many there are, and stay whole.
4. Equal fragments are combined before and after the shuffle. Documents are in two shards by the
   hash of their id, and a task builds an FM-index of each shard's fragments: Burrows-Wheeler
   transform as a wavelet matrix over packed bit vectors with block ranks, bit vectors of the runs
   of suffixes that agree in ``WINDOW`` and ``WINDOW - 1`` words, and the least document id of each
   run; text and suffix array are dropped. Fragments of documents of one shard then stream through
   the index of the other, which has not seen them, from right to left: a backward-search step
   extends the match, and at ``WINDOW`` words its interval is cut back to its ``WINDOW - 1``-word
   parent, so each word costs about one step. The matching statistics, capped at ``WINDOW``, give
   the intervals that some document of the other shard repeats, with its least id; repeats inside
   a shard are told while its index is built.
5. Fragments whose matches have an id below that of some document that holds the fragment join
   their occurrences on two 64-bit hashes; the marked windows go to their documents, which drop
   the covered words.

Cases: null text has no words; a document with fewer than ``WINDOW`` words keeps all; rows that
repeat an id are one document, whose windows repeat only those of smaller ids; a row with a null
id neither marks others nor is marked; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, process_cache, release

#: Fixed by the contract.
WINDOW = 13
GRAM = 4
HOT = 2_000
HOT_COUNT = 1 << 24
HOT_BITS = 48
MAP_BITS = 1 << 29
SEGMENT_BITS = 1 << 23
MAX_RUN = 64
#: Words of one FM-index, and bytes of text that are looked at together.
SHARD_WORDS = 300_000
SLAB = 1 << 20

BASE = 0x9E3779B97F4A7C15 | 1
NEVER = np.iinfo(np.int64).max
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    def make():
        out = np.full(1 << n.bit_length(), base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    if n > 4 * SLAB:  # of a very long text, not kept
        return make()[:n]
    return process_cache(("powers", base, n.bit_length()), make)[:n]


class Slab:
    """The words, windows and fragments of a few texts, as arrays."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids = np.array(ids, np.int64)
        self.texts = texts
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = _IS_SPACE[raw]
        before = np.concatenate(([True], space[:-1]))
        start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.doc = np.searchsorted(bounds, start, "right")
        self.first_word = np.searchsorted(start, np.concatenate(([0], bounds[:-1])))
        # Words one space apart.
        keep = ~(space & before)
        self.flat = np.where(space, np.uint8(32), raw)[keep].tobytes()
        size = end - start
        self.at = np.cumsum(size + 1) - (size + 1)
        self.to = self.at + size
        n = len(raw)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n))))
        inverse = _powers(pow(BASE, -1, 1 << 64), n)
        self.word = _mix((sums[end] - sums[start]) * inverse[start]) if len(start) else np.zeros(0, np.uint64)

    def fragments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Minimiser, first word and number of windows of each fragment."""
        n = len(self.word) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = len(self.word) - GRAM + 1
        g = np.zeros(grams, np.uint64)
        for j in range(GRAM):
            g = g * np.uint64(BASE) + self.word[j : j + grams]
        low, span, want = _mix(g), 1, WINDOW - GRAM + 1
        while span < want:
            step = min(span, want - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        ok = self.doc[:n] == self.doc[WINDOW - 1 :]
        at = np.flatnonzero(ok)
        if not len(at):
            return np.zeros(0, np.uint64), at, at
        m = low[at]
        new = np.concatenate(([True], (np.diff(at) != 1) | (m[1:] != m[:-1]) | (np.diff(self.doc[at]) != 0)))
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        first = np.flatnonzero(new | (run % MAX_RUN == 0))
        return m[first], at[first], np.diff(np.append(first, len(at)))

    def fragment_bits(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """One of 64 bits for each fragment, by a hash of its words."""
        words = len(self.word)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(self.word * _powers(BASE, words))))
        h = _mix((sums[first + n + WINDOW - 1] - sums[first]) * _powers(pow(BASE, -1, 1 << 64), words)[first])
        return np.uint64(1) << (h & np.uint64(63))

    def text(self, first: int, words: int) -> bytes:
        return self.flat[self.at[first] : self.to[first + words - 1]]


def _slabs(batch: pa.RecordBatch) -> Iterator[Slab]:
    """The rows of a batch (id, text) in slabs, without null ids and empty texts."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        t = t.as_py()
        if i is None or not t:
            continue
        t = t.encode("utf-8", "surrogatepass")
        if size + len(t) > SLAB and ids:
            yield Slab(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t)
    if ids:
        yield Slab(ids, texts)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def minimisers(docs: DataFrame) -> DataFrame:
    """(m, doc_id, bit) of every fragment. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in _slabs(batch):
                m, first, n = slab.fragments()
                own, bit = slab.ids[slab.doc[first]], slab.fragment_bits(first, n)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(own), pa.array(bit.view(np.int64))], ["m", "doc_id", "bit"])

    return bounded_batches(docs).mapInArrow(run, "m long, doc_id long, bit long")


def bit_map(keys: DataFrame, n: int) -> bytes:
    """A bit map of the column ``m``, which has n rows: 16 bits a key, ``MAP_BITS`` at most. Tasks
    fill segments; memory and what reaches the driver are bounded by the map, not by n."""
    bits = min(MAP_BITS, max(SEGMENT_BITS, 1 << (16 * n).bit_length()))
    segments = bits // SEGMENT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            seg = (at // np.uint64(SEGMENT_BITS)).astype(np.int64)
            for s in np.unique(seg).tolist():
                part = own.setdefault(s, np.zeros(SEGMENT_BITS // 8, np.uint8))
                x = at[seg == s] % np.uint64(SEGMENT_BITS)
                np.bitwise_or.at(part, (x >> np.uint64(3)).astype(np.int64), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
        for s, part in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["s", "bits"])

    dealt = keys.select("m").repartition(segments, F.expr(f"shiftright(m & {bits - 1}L, {SEGMENT_BITS.bit_length() - 1})"))
    out = np.zeros(bits // 8, np.uint8)
    for s, part in dealt.mapInArrow(run, "s long, bits binary").toLocalIterator():
        at = s * (SEGMENT_BITS // 8)
        out[at : at + SEGMENT_BITS // 8] |= np.frombuffer(part, np.uint8)
    return out.tobytes()


def _passes(bits: np.ndarray, m: np.ndarray) -> np.ndarray:
    at = m & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


OCCURRENCE = "m long, h long, doc_id long, row_hash long, pos int, frag binary"


def occurrences(docs: DataFrame, shared, hot, with_text: bool) -> DataFrame:
    """Fragments of shared minimisers: m and h name the fragment, row_hash the whole text, pos is
    the first word in the document. shared, hot: broadcast bit maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        maps = [np.frombuffer(b.value, np.uint8) for b in (shared, hot)]
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for slab in _slabs(batch):
                m, first, n = slab.fragments()
                keep = _passes(maps[0], m)
                m, first, n = m[keep], first[keep], n[keep]
                if len(m):
                    split = _passes(maps[1], m)
                    at = np.concatenate([np.arange(a, a + k) for a, k in zip(first[split], n[split])] or [first[:0]])
                    key = np.zeros(len(at), np.uint64)
                    for j in range(WINDOW):
                        key = key * np.uint64(BASE) + slab.word[at + j]
                    m = np.concatenate((m[~split], _mix(key)))
                    first = np.concatenate((first[~split], at))
                    n = np.concatenate((n[~split], np.ones(len(at), np.int64)))
                if not len(m):
                    continue
                frags = [slab.text(a, k + WINDOW - 1) for a, k in zip(first.tolist(), n.tolist())]
                doc = slab.doc[first]
                h = np.fromiter(map(digest, frags), np.uint64, len(frags))
                whole = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in slab.texts), np.uint64, len(slab.texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(h.view(np.int64)), pa.array(slab.ids[doc]), pa.array(whole.view(np.int64)[doc]),
                     pa.array((first - slab.first_word[doc]).astype(np.int32)),
                     pa.array(frags, pa.binary()) if with_text else pa.nulls(len(m), pa.binary())],
                    ["m", "h", "doc_id", "row_hash", "pos", "frag"],
                )

    return bounded_batches(docs).mapInArrow(run, OCCURRENCE)


class BitRanks:
    """A packed bit vector with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        pad = (-len(bits)) % 64 + 64
        packed = np.packbits(np.concatenate((bits, np.zeros(pad, bool))), bitorder="little")
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one, from 0."""
        w = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[w]
        word, at = self.words[w], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left = left - low * up
            word = np.where(up, word >> np.uint64(half), word)
            at += half * up
        return (w << 6) + at

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class FMIndex:
    """FM-index over sequences of symbols 1..sigma-1, each sequence ended by a separator. What it
    keeps is the wavelet matrix of the transform, where symbols begin, the runs of suffixes that
    agree in depth and in depth - 1 symbols, and the least owner of each run of depth; neither the
    text nor the suffix array. ``own`` has, for each symbol of the input, the least owner of a
    sequence with the depth symbols from there (NEVER where so many don't follow); it is for the
    caller, who sets it to None to leave the index alone."""

    def __init__(self, seqs: np.ndarray, lengths: np.ndarray, owners: np.ndarray, depth: int, sigma: int):
        """seqs: all symbols, one sequence after the other; owners: of each sequence."""
        count = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(len(seqs) + count, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = seqs
        n = self.n = len(text)
        # Suffix array, in the order of the first depth symbols or more, which is what patterns of
        # that length need: ranks by k symbols, packed three to a key, give those by 3 k (two to a key
        # where three don't fit). Separators are distinct and below all symbols.
        ordinal = text + count
        ordinal[ends] = np.arange(count)
        rank, k, top = ordinal, 1, int(ordinal.max()) + 2
        while True:
            many = 3 if top**3 < 1 << 63 else 2
            key = rank + 1
            for j in range(1, many):
                key = key * top
                key[: max(0, n - j * k)] += rank[j * k :] + 1
            k *= many
            sa = np.argsort(key)
            new = key[sa]
            new = np.concatenate(([0], new[1:] != new[:-1]))
            if k >= depth:
                break
            rank = np.empty(n, np.int64)
            rank[sa] = np.cumsum(new)
            top = int(n) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma)))).astype(np.int32)
        self.levels: list[tuple[int, BitRanks, int]] = []
        x = text[sa - 1]
        for b in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = (x >> b) & 1 == 1
            ranks = BitRanks(bit)
            self.levels.append((b, ranks, len(x) - ranks.ones))
            x = np.concatenate((x[~bit], x[bit]))
        # The base of each symbol's interval, without what comes before it in the last level.
        self.base = (self.before[:sigma] - self._descend(np.arange(sigma), np.zeros(sigma, np.int64))).astype(np.int32)
        same = np.ones(n - 1, bool)
        for j in range(depth):
            a, b = sa[1:] + j, sa[:-1] + j
            same &= (a < n) & (b < n) & (ordinal[np.minimum(a, n - 1)] == ordinal[np.minimum(b, n - 1)])
            if j == depth - 2:
                self.parents = BitRanks(np.concatenate(([True], ~same)))
        new = np.concatenate(([True], ~same))
        self.runs = BitRanks(new)
        least = np.minimum.reduceat(np.repeat(owners, lengths + 1)[sa], np.flatnonzero(new))
        self.owners, code = np.unique(least, return_inverse=True)
        self.least = code.astype(np.min_scalar_type(len(self.owners)))
        own = np.full(n, NEVER)
        own[sa] = least[np.cumsum(new) - 1]
        left = np.repeat(ends, lengths + 1) - np.arange(n)  # symbols from here to the separator
        own[left < depth] = NEVER
        self.own: np.ndarray | None = own[inside]

    @property
    def nbytes(self) -> int:
        vectors = [r for _, r, _ in self.levels] + [self.parents, self.runs]
        return sum(v.nbytes for v in vectors) + self.before.nbytes + self.base.nbytes + self.owners.nbytes + self.least.nbytes

    def least_owner(self, lo: np.ndarray) -> np.ndarray:
        """The least owner below the intervals of depth symbols that begin at lo."""
        return self.owners[self.least[self.runs.rank(lo + 1) - 1]]

    def _parent(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of depth - 1 symbols around lo."""
        k = self.parents.rank(lo + 1).astype(np.int64)
        last = k == self.parents.ones
        return self.parents.select(k - 1), np.where(last, self.n, self.parents.select(np.where(last, 0, k)))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, ranks, zeros in self.levels:
            ones = ranks.rank(i)
            i = np.where((symbol >> b) & 1 == 1, zeros + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the interval of symbol + pattern, from that of the pattern."""
        base = self.base[symbol]
        both = self._descend(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        return base + both[: len(lo)], base + both[len(lo) :]

    def matches(self, text: np.ndarray, start: np.ndarray, length: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``text`` at which the matching statistic reaches ``depth`` symbols, and the
        lower end of their intervals. Sequences stream from right to left, all at once."""
        end = start + length
        pos = end - 1
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n)
        live = np.flatnonzero(length >= depth)
        found: list = [(pos[:0], lo[:0])]
        while len(live):
            c = text[pos[live]]
            a, b = self.step(c, lo[live], hi[live])
            good = (a < b) & (c > 0)
            hit, miss = live[good], live[~good]
            lo[hit], hi[hit] = a[good], b[good]
            full = hit[end[hit] - pos[hit] == depth]
            found.append((pos[full], lo[full]))
            end[full] -= 1
            lo[full], hi[full] = self._parent(lo[full])
            pos[hit] -= 1
            # No window with this symbol and the current match can match: drop its last symbol,
            # or, if the symbol itself is unknown, all of it.
            end[miss] = np.where(c[~good] > 0, np.maximum(end[miss] - 1, pos[miss]), pos[miss])
            restart = miss[end[miss] > start[miss]]
            pos[restart], lo[restart], hi[restart] = end[restart] - 1, 0, self.n
            live = np.concatenate((hit, restart))
            live = live[(pos[live] >= start[live]) & (end[live] - start[live] >= depth)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def least_owners(frags: list[bytes], owners: tuple[np.ndarray, ...], depth: int = WINDOW) -> list[np.ndarray]:
    """For each fragment, and each of its windows, the least owner of a fragment with that window.
    owners: for each shard of documents, the least owner of each fragment there, or NEVER."""
    split = [f.split(b" ") for f in frags]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    words = [w for s in split for w in s]
    ids = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
    seqs = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    del split, words
    start = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(frags)), lengths)
    out = np.full(len(seqs), NEVER)
    for own in owners:
        held = own != NEVER
        if not held.any():
            continue
        here = held[of]
        index = FMIndex(seqs[here], lengths[held], own[held], depth, len(ids) + 1)
        out[here] = np.minimum(out[here], index.own)
        index.own = None
        at, lo = index.matches(seqs, start[~held], lengths[~held], depth)
        out[at] = np.minimum(out[at], index.least_owner(lo))
    return [out[a : a + n - depth + 1] for a, n in zip(start.tolist(), lengths.tolist())]


def window_owners(distinct: DataFrame) -> DataFrame:
    """(m, h, least): for each fragment whose windows some other document may repeat, the least
    document id of each window. distinct: m, h, frag, lo0 and lo1 (the least document of either
    shard, if any), hi; partitioned and sorted by m."""

    def shard(m, h, frag, lo0, lo1, hi):
        least = least_owners(frag, (lo0, lo1))
        keep = [i for i, x in enumerate(least) if x.min() < hi[i]]
        flat = np.concatenate([least[i] for i in keep]) if keep else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(least[i]) for i in keep]))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(m[keep]), pa.array(h[keep]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["m", "h", "least"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        words = 0

        def arrays():
            m, h, frag, *rest = held
            return np.array(m, np.int64), np.array(h, np.int64), frag, *(np.array(x, np.int64) for x in rest)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if words > SHARD_WORDS and row[0] != held[0][-1]:
                    yield shard(*arrays())
                    held, words = [[] for _ in range(6)], 0
                for col, x in zip(held, row):
                    col.append(x)
                words += row[2].count(b" ") + 1
        if held[0]:
            yield shard(*arrays())

    return distinct.mapInArrow(run, "m long, h long, least array<long>")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, marks): the first words of each document's repeated windows; row_hash is
    the xxhash64 of the text. docs: doc_id, text."""
    spark = docs.sparkSession
    spread = minimisers(docs).groupBy("m").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_or("bit").alias("bits")
    ).where("lo < hi").select("m", "n", F.bit_count("bits").alias("kinds"))
    spread = materialize(spread, "substring-minimisers")
    release(spark)
    n_shared, total = spread.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot_at = max(HOT, total // HOT_COUNT)
    over = spread.where((F.col("n") > hot_at) & (F.col("kinds") >= HOT_BITS))
    shared, hot = (spark.sparkContext.broadcast(bit_map(keys, n)) for keys, n in ((spread, n_shared), (over, over.count())))  # MAP_BITS / 8 bytes at most
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    lo = [F.coalesce(F.min(F.when(shard == k, F.col("doc_id"))), F.lit(int(NEVER))).alias(f"lo{k}") for k in range(2)]
    distinct = (
        occurrences(docs, shared, hot, True)
        .groupBy("m", "h", "frag")
        .agg(*lo, F.max("doc_id").alias("hi"))
        .repartition("m")
        .sortWithinPartitions("m")
    )
    least = materialize(window_owners(distinct), "substring-windows")
    del distinct
    release(spark)
    found = occurrences(docs, shared, hot, False).drop("frag").join(least, ["m", "h"])
    starts = F.expr("transform(filter(transform(least, (x, i) -> struct(x, i)), s -> s.x < doc_id), s -> pos + s.i)")
    marks = (
        found.select("doc_id", "row_hash", starts.alias("s"))
        .where(F.size("s") > 0)
        .groupBy("doc_id", "row_hash")
        .agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("marks"))  # at most a document's words
    )
    marks = materialize(marks, "substring-marks")
    del found
    release(spark)
    return marks


def _covered(n: int, marks) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    if marks is not None and len(marks):
        at = np.asarray(marks, np.int64)
        at = at[at + WINDOW <= n]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge[:n]) > 0


def _marked(docs: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """row (a struct of ``columns`` of ``docs``) and marks."""
    marks = repeated_windows(_rows(docs, id_col, text_col))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"))
    return rows.join(marks.hint("shuffle_hash"), ["doc_id", "row_hash"], "left").select("row", "marks")


def _words(text, marks) -> tuple[list[bytes], np.ndarray]:
    words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
    return words, _covered(len(words), marks.values.to_numpy() if marks.is_valid else None)


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, removed, digest = [], [], []
            doc_id, text_of = batch.column(0).flatten()
            for text, marks in zip(text_of, batch.column(1)):
                words, gone = _words(text, marks)
                n_words.append(len(words))
                if gone.any():
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                removed.append(n_words[-1] - len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [doc_id.cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    marked = _marked(docs, id_col, text_col, [id_col, text_col])
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated words removed, in the columns of ``docs``: the kept words of a
    changed text are joined by one space, other texts stay as they are, and a document of which
    nothing is left goes."""
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            out = batch.column(0).flatten()
            for text, marks in zip(out[at], batch.column(1)):
                words, gone = _words(text, marks)
                keep.append(not len(words) or not gone.all())
                if gone.any():
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                    texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                else:
                    texts.append(text.as_py())
            out[at] = pa.array(texts, out[at].type)
            yield pa.RecordBatch.from_arrays(out, columns).filter(pa.array(keep))

    return _marked(docs, id_col, text_col, columns).mapInArrow(run, docs.schema)


#: DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
place AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM place),
owner AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN owner USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
