"""Language-model scoring by Katz backoff, with Good-Turing discounts and exact normalisation.

The model has three orders: trigrams back off to bigrams, these to unigrams, and these to one class
for all words that training lacks. With c the training counts, C(h) the count of context h, d the
order's Good-Turing discounts (counts up to ``K``), h' the context without its first word, and sums
over the words stored after h:

    P(w)   = d(c(w)) c(w) / N;  P(unknown) = 1 - the sum of P(w)
    P(w|h) = d(c(h,w)) c(h,w) / C(h) where (h,w) is stored, else alpha(h) P(w|h')
    alpha(h) = (1 - sum of d(c) c / C(h)) / (1 - sum of P(w|h')), and 1 where C(h) = 0

so that P(.|h) sums to one for each h. Where discounts leave no mass, one count is added to the
denominator and kept for what is unseen. Trigrams are stored from a count of ``STORED`` on, as is
usual for the highest order: those met once (over nine in ten) are left to the backoff, which is
normalised accordingly. A text's first word has the context of a beginning, its second the
beginning and the first word. The tables are partitioned; every text is scored whole.

Counting and looking up every word of every text by joins would move the corpus several times.
Instead a map packs texts into *blocks* of about ``BLOCK`` tokens: one row with the block's
distinct words (their bytes) and its tokens as numbers into them. From then on only distinct words,
pairs and triples of a block travel, compressed, to the partition of the table that owns them, and
the numbers asked for travel back:

1. words of a block -> partitions of the unigram table -> counts and word numbers;
2. pairs of a block, by context -> partitions of the bigram table -> pair counts, and per context
   its counts of counts and the unigram mass of its followers;
3. triples of a block whose two pairs occur twice or more (no other can occur twice), by context and
   with what gives the bigram probability of their last word -> partitions of the trigram table ->
   the same;
4. each block scores its texts, order by order from the lowest.

The questions about triples are worked out once and written; they travel in ``ROUNDS`` shares of the
partitions, each deleted once answered. Blocks are scored in as many shares.

Partitions hold the tables, and write them (``tables``): words, and pairs and triples from a count
of ``STORED`` on. Their number grows with the bytes of text, so that a task's does not. A context
with over 1 / (4 x partitions) of all tokens has its followers dealt over several partitions; there
are at most 4 x partitions such contexts, whose sums are added on the driver and broadcast. What
else reaches the driver is a few counts of counts a partition. Each step is written to the shared
folder.

Cases: null text is empty (one token, the end); rows that repeat an id are scored and counted each;
with no training text every score is that of unknown words, log10 of one; a null id falls in the
fold of the empty string; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, process_cache, release, shared_dir, shuffle_partitions, text_or_empty
from .language_id import remainder
from .substring_dedup import _IS_SPACE, SLAB, _mix

K = 5
STORED = 2
BLOCK = 1_000_000
#: Triples travel, and blocks are scored, in so many rounds, a share each, so that less is in flight
#: at once.
ROUNDS = 4
#: Bytes of text for each partition of the tables, about. Each block sends each partition a message, so
#: messages grow with the square of the input; twice as much took more than 3,000 MB of an executor.
PART_BYTES = 8 << 20
#: The end of a text, as a word.
END = b""
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Fixed by the contract: the added count of the base score.
ADD = 0.1


def _compress(raw: bytes, level: int) -> bytes:
    import zstandard

    return process_cache(("zstd", level), lambda: zstandard.ZstdCompressor(level=level)).compress(raw)


def _decompress(blob: bytes | memoryview) -> bytes:
    import zstandard

    return process_cache(("unzstd",), zstandard.ZstdDecompressor).decompress(blob)


def pack(a: np.ndarray) -> bytes:
    """Compressed, one byte of all numbers after the other; high bytes that are all zero are left out.
    The first byte tells how many are there."""
    kept = a.itemsize
    if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
        kept = max(1, (int(a.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize)[:, :kept].T
    return bytes((kept,)) + _compress(planes.tobytes(), 3)


def unpack(blob: bytes, dtype) -> np.ndarray:
    kept = blob[0]
    raw = np.frombuffer(_decompress(memoryview(blob)[1:]), np.uint8)
    out = np.zeros((len(raw) // kept, np.dtype(dtype).itemsize), np.uint8)
    out[:, :kept] = raw.reshape(kept, -1).T
    return out.view(dtype).ravel()


def pack_words(words: list[bytes]) -> bytes:
    """Compressed; words hold no white space, and there is one at least."""
    return _compress(b" ".join(words), 1)


def unpack_words(blob: bytes) -> list[bytes]:
    return _decompress(blob).split(b" ")


def _split(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of each part in sorted part numbers."""
    cuts = np.searchsorted(keys, np.arange(parts + 1))
    return [(p, int(a), int(b)) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """A stable sort; of short numbers it is a radix sort."""
    return np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0 to K (1 where the counts of counts don't allow one). n[r]: how many
    have count r, r up to K + 1."""
    d = np.ones(K + 1)
    n = n.astype(float)
    if n[1] <= 0:
        return d
    common = (K + 1) * n[K + 1] / n[1]
    for r in range(1, K + 1):
        if n[r] > 0 and common < 1:
            x = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
            if 0 < x < 1:
                d[r] = x
    return d


class Unigrams:
    """P(w) as a function of w's count."""

    def __init__(self, total: int, n: np.ndarray):
        self.total, self.d = total, good_turing(n)
        r = np.arange(1, K + 1)
        self.rest = float(((1 - self.d[1:]) * r * n[1 : K + 1]).sum()) / max(total, 1)
        self.whole = float(total)
        if self.rest <= 0:
            self.whole = total + 1.0
            self.rest = 1 / self.whole

    def __call__(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= K, self.d[np.minimum(c, K)], 1.0)
        return np.where(c > 0, d * c / self.whole, self.rest)


BLOCKS = "block long, ids binary, held binary, lens binary, words binary, parts binary, seen binary, tok binary"


def tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts as bytes, each text followed by END, and how many it has with it."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _IS_SPACE[raw]
    before = np.concatenate(([True], space[:-1]))
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    count = np.bincount(np.searchsorted(bounds, start, "right"), minlength=len(texts))
    size = np.insert(end - start, np.cumsum(count), 0)
    offsets = np.concatenate(([0], np.cumsum(size)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~space].tobytes())])
    return words, count + 1


def word_part(words: list[bytes], parts: int) -> np.ndarray:
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def blocks(docs: DataFrame, parts: int, size: int = BLOCK) -> DataFrame:
    """docs: doc_id, text, held. Of each of the block's words: its bytes, the part of the unigram
    table that owns it, and its training count in the block."""

    def row(n: int, ids: list, held: list, lens: list, toks: list) -> pa.RecordBatch:
        from pyspark import TaskContext

        coded = pa.concat_arrays(toks).dictionary_encode()
        tok, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        lens, held = np.concatenate(lens), np.array(held, np.uint8)
        order = np.argsort(-np.bincount(tok), kind="stable")  # frequent words have small numbers
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        tok, words = place[tok], words.take(pa.array(order)).to_pylist()
        train = np.repeat(held == 0, lens)
        seen = np.bincount(tok[train], minlength=len(words)).astype(np.uint32)
        some = np.array([i is not None for i in ids])
        number = np.array([i or 0 for i in ids], np.int64)
        out = [pack(np.concatenate((number, some.astype(np.int64)))), pack(held), pack(lens.astype(np.uint32)), pack_words(words), pack(word_part(words, parts).astype(np.uint32)), pack(seen), pack(tok)]
        arrays = [pa.array([(TaskContext.get().partitionId() << 24) + n], pa.int64())] + [pa.array([b], pa.binary()) for b in out]
        return pa.RecordBatch.from_arrays(arrays, ["block", "ids", "held", "lens", "words", "parts", "seen", "tok"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, ids, held, lens, toks = 0, 0, [], [], [], []
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in batch.column(1)]
            a = 0
            while a < len(texts):
                b, size_now = a, 0
                while b < len(texts) and (b == a or size_now + len(texts[b]) < SLAB):
                    size_now += len(texts[b])
                    b += 1
                tok, count = tokens(texts[a:b])
                toks.append(tok)
                lens.append(count)
                ids += batch.column(0).slice(a, b - a).to_pylist()
                held += batch.column(2).slice(a, b - a).to_pylist()
                total += len(tok)
                a = b
                if total >= size:
                    yield row(n, ids, held, lens, toks)
                    n, total, ids, held, lens, toks = n + 1, 0, [], [], [], []
        if ids:
            yield row(n, ids, held, lens, toks)

    return bounded_batches(docs).mapInArrow(run, BLOCKS)


#: Answers to a block: kind 1 has counts and numbers of its words, kinds 2 and 3 have counts of its
#: pairs and triples, and counts of counts, stored counts and lower mass of their contexts. block
#: -1: statistics of the part; -2: a slice of a context that is dealt over several parts; -3: the
#: part of the table (words and counts; contexts, words and counts); -4: its contexts.
ANSWER = "block long, kind int, part int, a binary, b binary, c binary"


def _answers(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "kind", "part", "a", "b", "c"])


def word_table(packed: DataFrame, parts: int) -> DataFrame:
    """The unigram table's answers."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, seen in zip(*(c.to_pylist() for c in batch.columns)):
                words, seen = unpack_words(words), unpack(seen, np.uint32)
                part = word_part(words, parts)
                order = np.argsort(part, kind="stable")
                rows = [(p, block, pack_words([words[i] for i in order[a:b]]), pack(seen[order[a:b]])) for p, a, b in _split(part[order], parts)]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("part", "block", "words", "seen"), r)) for r in rows],
                    pa.schema([("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("seen", pa.binary())]),
                )

    def reduce(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        pdf = pdf.sort_values("block")
        words = [unpack_words(b) for b in pdf["words"]]
        seen = np.concatenate([unpack(b, np.uint32) for b in pdf["seen"]])
        coded = pa.array([x for w in words for x in w], pa.large_binary()).dictionary_encode()
        at, own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        c = np.bincount(at, seen, len(own)).astype(np.int64)
        order = np.argsort(-c, kind="stable")  # frequent words have small numbers, which compress better
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, own, c = place[at], own.take(pa.array(order)), c[order]
        n = np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 2]
        out = [(-1, 1, part, pack(np.concatenate(([len(own), (c > 0).sum(), c.sum()], n)).astype(np.int64)), None, None)]
        out.append((-3, 1, part, pack_words(own.to_pylist()), pack(c), None))
        end = 0
        for block, w in zip(pdf["block"], words):
            x = at[end : end + len(w)]
            end += len(w)
            out.append((block, 1, part, pack(c[x]), pack(x.astype(np.uint32)), None))
        return _answers(out)

    asked = packed.select("block", "words", "seen").mapInArrow(ask, "part int, block long, words binary, seen binary")
    return asked.repartition(parts, "part").groupBy("part").applyInPandas(reduce, ANSWER)


class Known:
    """A block and what the unigram table says of its words."""

    def __init__(self, row: pd.Series, answers: pd.DataFrame, parts: int, beginning: int, docs: int):
        ids = unpack(row["ids"], np.int64)
        self.ids, self.some = np.split(ids, 2)
        self.held, self.lens = unpack(row["held"], np.uint8), unpack(row["lens"], np.uint32).astype(np.int64)
        self.tok = unpack(row["tok"], np.uint32).astype(np.int64)
        part = unpack(row["parts"], np.uint32)
        order = np.argsort(part, kind="stable")
        own = answers[answers["kind"] == 1].sort_values("part")
        n = len(order)
        self.c, self.number = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.c[order] = np.concatenate([unpack(b, np.int64) for b in own["a"]])
        self.number[order] = np.concatenate([unpack(b, np.uint32) for b in own["b"]]).astype(np.int64) * parts + part[order].astype(np.int64)
        # The context before the first word; its number is above all others.
        self.c[n], self.number[n] = docs, beginning
        self.begin = n
        # From here on the block's words are in the order of their numbers.
        order = np.argsort(self.number)
        place = np.empty(n + 1, np.int64)
        place[order] = np.arange(n + 1)
        self.c, self.number, self.tok = self.c[order], self.number[order], place[self.tok]
        first = np.cumsum(self.lens) - self.lens
        self.ctx = np.concatenate(([n], self.tok[:-1]))
        self.ctx[first] = n

        self.train = np.repeat(self.held == 0, self.lens)

    def _deal(self, name: np.ndarray, size: np.ndarray, word: np.ndarray, parts: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
        """The part of each context (a mixed name) and word, and whether the context, with size
        counts, is dealt over several."""
        slices = np.minimum(-(-size // hot), parts).astype(np.uint64)
        spread = _mix(self.number[word].astype(np.uint64)) % np.maximum(slices, np.uint64(1))
        return ((name + spread) % np.uint64(parts)).astype(np.int64), slices > 1

    def pairs(self, parts: int, hot: int) -> Asked:
        """The pairs that training may have."""
        width = self.begin + 1
        live = np.flatnonzero(self.c[self.ctx] > 0)
        known = self.c[self.tok[live]] > 0
        # Before an unknown word the context is asked for too, by its pair with the end.
        own, at = np.unique(self.ctx[live] * width + np.where(known, self.tok[live], self.tok[-1]), return_inverse=True)
        seen = np.bincount(at[self.train[live]], minlength=len(own)).astype(np.uint32)
        h, w = own // width, own % width
        part, dealt = self._deal(_mix(self.number[h].astype(np.uint64) + np.uint64(1)), self.c[h], w, parts, hot)
        order = _by_part(part, parts)  # then by context and word: so own is sorted
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        token = np.full(len(self.tok), -1)
        token[live[known]] = place[at[known]]
        context = np.full(len(self.tok), -1)
        context[live] = self.ctx[live]
        h, w = h[order], w[order]
        return Asked(h, np.full(len(h), -1), self.number[h], w, part[order], seen[order], dealt[order], self.c[w], np.zeros(width), token, context, width, order)

    def triples(self, two: Asked, r: np.ndarray, whole: np.ndarray, parts: int, hot: int) -> Asked:
        """The triples that may be stored; r: training counts of the pairs two, whole: what the counts
        of each of their contexts are divided by."""
        width = self.begin + 1
        before = np.concatenate(([-1], two.token[:-1]))  # the pair of the two words before
        before[np.cumsum(self.lens) - self.lens] = -1
        live = np.flatnonzero((before >= 0) & (np.append(r, 0)[before] >= STORED))
        pair = two.token[live]
        real = (pair >= 0) & (np.append(r, 0)[pair] >= STORED)
        own, at = np.unique(two.rank[before[live]] * width + np.where(real, self.tok[live], self.tok[-1]), return_inverse=True)
        seen = np.bincount(at[self.train[live] & real], minlength=len(own)).astype(np.uint32)
        lower = np.zeros(len(own), np.int64)
        lower[at[real]] = r[pair[real]]
        pair_at = np.empty(len(two.rank), np.int64)
        pair_at[two.rank] = np.arange(len(two.rank))
        h, w = pair_at[own // width], own % width
        u, v = self.number[two.h[h]], self.number[two.w[h]]
        part, dealt = self._deal(_mix(_mix(u.astype(np.uint64)) + v.astype(np.uint64)), r[h], w, parts, hot)
        order = _by_part(part, parts)
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        token, context = np.full(len(self.tok), -1), np.full(len(self.tok), -1)
        token[live[real]] = place[at[real]]
        context[live] = before[live]
        return Asked(h[order], u[order], v[order], w[order], part[order], seen[order], dealt[order], lower[order], whole[two.w], token, context, len(r), order)


class Asked:
    """Pairs or triples of a block, sorted by part, context and word: the context in the block (h)
    and by its words' numbers (u, v), the word in the block (w), the part, the training count, whether
    the context is dealt over several parts, and the lower order's count of the word; for each context,
    what that count is divided by; which of them, and which context, each token has (-1: none); how many
    contexts there are; and the rank of each by context and word alone."""

    def __init__(self, h, u, v, w, part, seen, dealt, lower, whole, token, context, contexts, rank):
        self.h, self.u, self.v, self.w, self.part, self.seen, self.dealt = h, u, v, w, part, seen, dealt
        self.lower, self.whole, self.token, self.context, self.contexts, self.rank = lower, whole, token, context, contexts, rank

    def rows(self, block: int, number: np.ndarray, parts: int) -> list[tuple]:
        """What goes to the parts."""
        out = []
        for p, x, y in _split(self.part, parts):
            first = self.first(x, y)
            n = np.diff(np.append(first, y)).astype(np.uint32)
            out.append((
                p, block, pack(self.u[first]), pack(self.v[first]), pack(self.dealt[first].astype(np.uint8)), pack(n),
                pack(number[self.w[x:y]]), pack(self.lower[x:y]), pack(self.whole[self.h[first]].astype(np.int64)), pack(self.seen[x:y]),
            ))
        return out

    def first(self, x: int, y: int) -> np.ndarray:
        h = self.h[x:y]
        return x + np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))

    def answered(self, answers: dict, parts: int, shared: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of what was asked; per context, its counts of counts (from 1, then the sum of stored
        counts) and the lower mass of its followers."""
        r, of_counts, mass = np.zeros(len(self.h), np.int64), np.zeros((self.contexts, K + 1)), np.zeros(self.contexts)
        for p, x, y in _split(self.part, parts):
            a, b, c = answers[p]
            r[x:y] = unpack(a, np.uint32)
            own = self.h[self.first(x, y)]
            b = unpack(b, np.uint32).reshape(-1, len(own)).T
            of_counts[own, : b.shape[1]] = b
            if c is not None:
                mass[own] = unpack(c, np.float64)
        own = np.flatnonzero(self.dealt)
        for i in own[np.unique(self.h[own], return_index=True)[1]]:
            of_counts[self.h[i]], mass[self.h[i]] = shared[int(self.u[i]), int(self.v[i])]
        return r, of_counts, mass


ASKED = "part int, block long, u binary, v binary, dealt binary, n binary, word binary, lower binary, whole binary, seen binary"


def _unique_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct (a, b), in order, and the number of each row's."""
    order = np.lexsort((b, a))
    new = np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
    at = np.empty(len(a), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


def _reduce(kind: int, lower_p):
    """A part of the table of pairs or triples: it adds up the counts, and answers. Pairs back off if
    they are not met, triples if they are not stored. lower_p(count, whole) is the lower order's
    probability of a word."""
    least = 1 if kind == 2 else STORED

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _trim()
        part = int(key[0])
        pdf = pdf.sort_values("block")
        u, v = ([unpack(b, np.int64) for b in pdf[c]] for c in "uv")
        n = [unpack(b, np.uint32) for b in pdf["n"]]
        first, ctx = _unique_rows(np.concatenate(u), np.concatenate(v))
        own_u, own_v = np.concatenate(u)[first], np.concatenate(v)[first]
        own_word, word_at = np.unique(np.concatenate([unpack(b, np.int64) for b in pdf["word"]]), return_inverse=True)
        pair, at = np.unique(np.repeat(ctx, np.concatenate(n)) * len(own_word) + word_at, return_inverse=True)
        del word_at
        r = np.bincount(at, np.concatenate([unpack(b, np.uint32) for b in pdf["seen"]]), len(pair)).astype(np.int64)
        lower = np.zeros(len(pair), np.int64)
        np.maximum.at(lower, at, np.concatenate([unpack(b, np.int64) for b in pdf["lower"]]))
        whole = np.zeros(len(first), np.int64)
        whole[ctx] = np.concatenate([unpack(b, np.int64) for b in pdf["whole"]])
        held = r >= least
        own = pair // len(own_word)
        p = np.where(held, lower_p(lower, whole[own]), 0.0)
        del lower
        start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        of_counts = np.stack([np.add.reduceat(((r == k) & held).astype(np.int64), start) for k in range(1, K + 1)] + [np.add.reduceat(np.where(held, r, 0), start)])
        mass = np.add.reduceat(p, start)
        stats = np.bincount(np.minimum(r, K + 2), minlength=K + 3)[: K + 2]
        out = [(-1, kind, part, pack(np.append(stats, (r * (r >= STORED)).sum()).astype(np.int64)), None, None)]
        some = np.flatnonzero(r >= STORED)
        out.append((-3, kind, part, pack(np.concatenate((own_u[own[some]], own_v[own[some]]))), pack(own_word[pair[some] % len(own_word)]), pack(r[some])))
        some = np.flatnonzero(of_counts[K] > 0)
        out.append((-4, kind, part, pack(np.concatenate((own_u[some], own_v[some]))), pack(of_counts[:, some].ravel()), pack(mass[some])))
        dealt = np.zeros(len(first), bool)
        dealt[ctx[np.concatenate([unpack(b, np.uint8) for b in pdf["dealt"]]) > 0]] = True
        for i in np.flatnonzero(dealt):
            out.append((-2, kind, part, pack(np.array([own_u[i], own_v[i]])), pack(of_counts[:, i]), pack(mass[i : i + 1])))
        end = x = 0
        for block, own_n in zip(pdf["block"], n):
            size = int(own_n.sum())
            i = ctx[x : x + len(own_n)]
            out.append((block, kind, part, pack(r[at[end : end + size]].astype(np.uint32)), pack(of_counts[: K + (kind > 2), i].astype(np.uint32).ravel()), pack(mass[i])))
            end, x = end + size, x + len(own_n)
        return _answers(out)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Model:
    """What the driver knows and all tasks share: a few numbers, and the sums of dealt contexts."""

    def __init__(self, parts: int, beginning: int, types: int, total: int, docs: int, unigrams: Unigrams):
        self.parts, self.beginning, self.types, self.total, self.docs, self.unigrams = parts, beginning, types, total, docs, unigrams
        self.hot = max(1, total // (4 * parts))
        self.d: dict[int, np.ndarray] = {}
        self.shared: dict[int, dict] = {}

    def lower(self, order: int):
        """The probability one order below, of words that it has met in the context."""
        if order == 2:
            return lambda count, _, p=self.unigrams: p(count)
        return lambda count, whole, d=self.d[order - 1]: np.where(count <= K, d[np.minimum(count, K)], 1.0) * count / np.maximum(whole, 1)

    def known(self, row: pd.Series, answers: pd.DataFrame) -> Known:
        return Known(row, answers, self.parts, self.beginning, self.docs)

    def step(self, order: int, asked: Asked, answers: pd.DataFrame, size: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of what was asked, the probability of each token at this order, and what the counts of
        each context are divided by. size: the counts
        of contexts; lower: the probability of each token one order below."""
        own = answers[answers["kind"] == order]
        got = {int(p): (a, b, c) for p, a, b, c in zip(own["part"], own["a"], own["b"], own["c"])}
        r, of_counts, mass = asked.answered(got, self.parts, self.shared[order])
        if order == 2:  # every pair counts
            of_counts[:, K] = size
        d = self.d[order]
        left = size - of_counts[:, K] + (of_counts[:, :K] * ((1 - d[1:]) * np.arange(1, K + 1))).sum(1)
        whole = np.where(left > 1e-9 * size, size, size + 1.0)
        left = np.where(left > 1e-9 * size, left, 1.0)
        alpha = np.where(size > 0, left / np.maximum(whole, 1) / (1 - mass), 1.0)
        count = np.append(r, 0)[asked.token]
        if order > 2:
            count = np.where(count >= STORED, count, 0)
        cut = np.where(count <= K, d[np.minimum(count, K)], 1.0)
        ctx = asked.context
        backed_off = np.append(alpha, 1.0)[ctx] * lower
        return r, np.where(count > 0, cut * count / np.maximum(np.append(whole, 1)[ctx], 1), backed_off), whole

    def evaluate(self, b: Known, answers: pd.DataFrame, order: int):
        """The probability of each token of a block at an order, from the order below; what was asked
        at this order, its counts, and what they are divided by."""
        if order == 1:
            return self.unigrams(b.c[: b.begin])[b.tok], None, None, None
        lower, two, r, whole = self.evaluate(b, answers, order - 1)
        asked = b.pairs(self.parts, self.hot) if order == 2 else b.triples(two, r, whole, self.parts, self.hot)
        if order not in self.d:  # not answered yet: this is the question
            return lower, asked, None, None
        size = b.c.astype(float) if order == 2 else r.astype(float)
        r, p, whole = self.step(order, asked, answers, size, lower)
        return p, asked, r, whole


def _trim() -> None:
    """Give memory of the last group or block back: the C library keeps it, and a worker lives long."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def _ask(model: Model, order: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        _trim()
        rows = []
        for _, row in left.iterrows():
            b = model.known(row, right)
            asked = model.evaluate(b, right, order)[1]
            rows += asked.rows(row["block"], b.number, model.parts)
        return pd.DataFrame(rows, columns=["part", "block", "u", "v", "dealt", "n", "word", "lower", "whole", "seen"])

    return run


def _score(model: Model):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        _trim()
        out = []
        for _, row in left.iterrows():
            b = model.known(row, right)
            p = model.evaluate(b, right, max(model.d))[0]
            at = np.cumsum(b.lens) - b.lens
            per = lambda x: np.add.reduceat(x, at)
            own = b.c[b.tok]
            out.append(pd.DataFrame({
                "doc_id": pd.array(b.ids, "Int64") if b.some.all() else pd.array([i if s else None for i, s in zip(b.ids, b.some)], "Int64"),
                "held_out": b.held > 0,
                "n_tokens": b.lens,
                "n_known": per((own > 0).astype(np.int64)),
                "train_tokens": model.total,
                "base_score": per(np.log10((own + ADD) / (model.total + ADD * (model.types + 1)))),
                "score": per(np.log10(p)),
            }))
        return pd.concat(out)

    return run


def _stats(answers: DataFrame, kind: int) -> dict[int, np.ndarray]:
    rows = answers.where((F.col("block") == -1) & (F.col("kind") == kind)).select("part", "a")
    return {x["part"]: unpack(bytes(x["a"]), np.int64) for x in rows.toLocalIterator()}  # a row a part


def _add_order(model: Model, order: int, answers: DataFrame) -> None:
    """The order's discounts, and the sums of its dealt contexts, at most 8 x parts rows."""
    n = np.zeros(K + 3, np.int64)
    for x in _stats(answers, order).values():
        n += x
    if order > 2:  # triples met once were not all asked for: they are what others leave
        n[1] = max(0, model.total - model.docs - n[K + 2])
    model.d[order] = good_turing(n[: K + 2])
    shared = model.shared.setdefault(order, {})
    for x in answers.where((F.col("block") == -2) & (F.col("kind") == order)).select("a", "b", "c").toLocalIterator():
        u, v = unpack(bytes(x["a"]), np.int64).tolist()
        counts, mass = shared.get((u, v), (np.zeros(K + 1, np.int64), 0.0))
        shared[u, v] = (counts + unpack(bytes(x["b"]), np.int64), mass + float(unpack(bytes(x["c"]), np.float64)[0]))


def _count(model: Model, order: int, packed: DataFrame, answers: DataFrame) -> DataFrame:
    """The written tables and answers of an order. The question needs counts only, not the mass of
    followers."""
    spark = packed.sparkSession
    asked = _with_answers(packed, answers.withColumn("c", F.lit(None).cast("binary")), _ask(model, order), ASKED)

    def answer(asked: DataFrame) -> DataFrame:
        own = asked.repartition(model.parts, "part").groupBy("part")
        return materialize(own.applyInPandas(_reduce(order, model.lower(order)), ANSWER), f"lm-order-{order}")

    if order == 2:
        return answer(asked)
    path, found = f"{shared_dir(spark)}/lm-asked-{uuid.uuid4().hex}", None
    asked.withColumn("turn", F.pmod("part", F.lit(ROUNDS))).write.partitionBy("turn").parquet(path)
    del asked
    release(spark)  # nothing refers to the step's shuffles any more
    for turn in range(ROUNDS):
        part = answer(spark.read.schema(f"{ASKED}, turn int").parquet(path).where(F.col("turn") == turn).drop("turn"))
        found = part if found is None else found.unionByName(part)
        _delete(spark, f"{path}/turn={turn}")
        release(spark)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fit(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, orders: int = 3) -> tuple[Model | None, DataFrame, DataFrame | None]:
    """The model, the blocks, and the written answers and tables. None where there is no text."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_or_empty(text_col))), F.lit(0))).first()[0]
    parts = max(2, shuffle_partitions(spark), size // PART_BYTES)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held"))
    packed = materialize(blocks(rows, parts, block), "lm-blocks")
    words = materialize(word_table(packed, parts), "lm-words")
    release(spark)
    stats = _stats(words, 1)
    if not stats:
        return None, packed, None
    sums = np.sum(list(stats.values()), axis=0)
    beginning = parts * max(int(x[0]) for x in stats.values())  # the number of no word
    train_docs = rows.where(~F.col("held")).count()
    model = Model(parts, beginning, int(sums[1]), int(sums[2]), train_docs, Unigrams(int(sums[2]), sums[3:]))
    answers = words
    for order in range(2, orders + 1):
        more = _count(model, order, packed, answers)
        release(spark)
        _add_order(model, order, more)
        answers = answers.unionByName(more)
    return model, packed, answers


def _with_answers(packed: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """run(block, its answers), a task for every few blocks however many there are."""
    n = max(2, shuffle_partitions(packed.sparkSession), packed.count())
    left, right = packed.drop("words", "seen"), answers.where("block >= 0")
    return left.repartition(n, "block").groupBy("block").cogroup(right.repartition(n, "block").groupBy("block")).applyInPandas(run, schema)


def tables(model: Model, answers: DataFrame) -> DataFrame:
    """The stored n-grams, a row each: order, part, u, v (numbers of the context's words, -1 for none),
    word (its number), text (order 1), count, discounted (its count times the discount; over the
    context's count, that is its probability)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, part, a, b, c in zip(pdf["kind"], pdf["part"], pdf["a"], pdf["b"], pdf["c"]):
                if kind == 1:
                    text, count = unpack_words(a), unpack(b, np.int64)
                    out = {"u": -1, "v": -1, "word": np.arange(len(count)) * model.parts + part, "text": text}
                else:
                    (u, v), word, count = unpack(a, np.int64).reshape(2, -1), unpack(b, np.int64), unpack(c, np.int64)
                    out = {"u": u, "v": v, "word": word, "text": None}
                d = model.unigrams.d if kind == 1 else model.d[kind]
                cut = np.where(count <= K, d[np.minimum(count, K)], 1.0)
                yield pd.DataFrame({"order": kind, "part": part, **out, "count": count, "discounted": cut * count})

    rows = answers.where("block = -3").select("kind", "part", "a", "b", "c")
    return rows.mapInPandas(run, "order int, part int, u long, v long, word long, text binary, count long, discounted double")


def contexts(model: Model, answers: DataFrame) -> DataFrame:
    """The contexts of pairs and triples, a row each: order, u, v, context_count, backoff (its weight).
    Contexts that no stored n-gram has back off with weight one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, a, b, c in zip(pdf["kind"], pdf["a"], pdf["b"], pdf["c"]):
                (u, v), of_counts, mass = unpack(a, np.int64).reshape(2, -1), unpack(b, np.int64).reshape(K + 1, -1), unpack(c, np.float64)
                saved = (of_counts[:K].T * ((1 - model.d[kind][1:]) * np.arange(1, K + 1))).sum(1)
                yield pd.DataFrame({"order": kind, "u": u, "v": v, "stored": of_counts[K], "saved": saved, "mass": mass})

    rows = answers.where("block = -4").select("kind", "a", "b", "c")
    parts = rows.mapInPandas(run, "order int, u long, v long, stored long, saved double, mass double")
    parts = parts.groupBy("order", "u", "v").agg(F.sum("stored").alias("stored"), F.sum("saved").alias("saved"), F.sum("mass").alias("mass"))  # slices of dealt contexts
    pairs = tables(model, answers).where("order = 2").select(F.lit(3).alias("order"), F.col("v").alias("u"), F.col("word").alias("v"), "count")
    count = F.when(F.col("order") == 2, F.col("stored")).otherwise(F.col("count"))  # all pairs are counted
    left = F.col("context_count") - F.col("stored") + F.col("saved")
    none = left <= 1e-9 * F.col("context_count")
    weight = F.when(none, 1 / (F.col("context_count") + 1)).otherwise(left / F.col("context_count")) / (1 - F.col("mass"))
    return parts.join(pairs, ["order", "u", "v"], "left").withColumn("context_count", count).select("order", "u", "v", "context_count", weight.alias("backoff"))


def katz_scores(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, orders: int = 3) -> DataFrame:
    """One row per row of ``docs``; texts for which ``held`` is true don't train the model."""
    spark = docs.sparkSession
    model, packed, answers = fit(docs, held, id_col, text_col, block, orders)
    if model is None:
        return spark.createDataFrame([], SCORES)
    scores = None
    for turn in range(ROUNDS):
        own = F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == turn
        part = materialize(_with_answers(packed.where(own), answers.where(own), _score(model), SCORES), "lm-scores")
        release(spark)
        scores = part if scores is None else scores.unionByName(part)
    return scores


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores by a model that learns from the rows outside fold 0 of 10."""
    return katz_scores(docs, remainder("doc_id", 10) == 0)
