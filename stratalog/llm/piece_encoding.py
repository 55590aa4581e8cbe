"""SentencePiece encoding and decoding by suffix-array matching.

The public model is byte-pair encoding with byte fallback; ids equal those of the library (tested).
Text is normalised as the model says (a space in front, spaces become the space mark). No piece
crosses from a letter into a space mark, so text falls into *units*, each starting at a space
mark, that are encoded independently. Per batch of texts:

1. The units not seen before are concatenated, and a suffix array over ``MAX_PIECE`` symbols is
   built from packed keys of four symbols each.
2. Every piece of the vocabulary is binary-searched, all at once, for its range of suffixes: its
   occurrences.
3. Occurrences become edges (start, end, piece), sorted by end position; letters that no piece
   covers get an edge of their own, which stands for their bytes.
4. Edges are relaxed in that order. In byte-pair encoding a prefix has exactly one encoding, and an
   edge extends it if its piece and the last piece before it *stay apart*: encoding the two
   together gives back the two. That is decided once for each pair of pieces and kept. So each
   position has at most one valid edge, and following them back gives the ids.

Memory: a batch of ``BATCH_CHARS`` characters, ``UNIT_CACHE`` units, one number for each pair of
pieces met. Nothing is shuffled.

Cases: null and empty text have no ids; text in which the space mark itself occurs decodes with a
space in its place, as in the library; a text of any length is encoded whole; repeated rows each
get a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, process_cache

MODEL = "piece_bpe_32k.model"
MAX_PIECE = 16
BATCH_CHARS = 2_000_000
UNIT_CACHE = 600_000
MARK = "▁"
UNREACHED, BEGIN, UNKNOWN = -3, -2, -1
SCHEMA = "doc_id long, n_ids int, ids array<int>, round_trip boolean"


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.strings = [sp.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.strings[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if max(len(self.strings[i]) for i in self.plain) > MAX_PIECE:
            raise ValueError(f"pieces of over {MAX_PIECE} symbols")
        self.score = {self.strings[i]: sp.get_score(i) for i in self.plain}
        self.silent = {i for i in range(n) if sp.is_control(i)}

    def merge(self, text: str) -> list[str]:
        """Plain byte-pair encoding of a short text: best score first, then leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def decode(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids) and self.silent.isdisjoint(ids):
            return "".join(map(self.strings.__getitem__, ids)).replace(MARK, " ").removeprefix(" ")
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.strings[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ").removeprefix(" ")


class PairTable:
    """Which pairs of pieces stay apart: sorted keys, and what was added since."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.keys, self.apart, self.new = vocabulary, np.zeros(0, np.int64), np.zeros(0, bool), {}

    def settle(self) -> None:
        if self.new:
            keys = np.concatenate((self.keys, np.fromiter(self.new, np.int64, len(self.new))))
            apart = np.concatenate((self.apart, np.fromiter(self.new.values(), bool, len(self.new))))
            order = np.argsort(keys)
            self.keys, self.apart, self.new = keys[order], apart[order], {}

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.v.strings) + b
        out = np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        hit = self.keys[at] == key if len(self.keys) else out.copy()
        out[hit] = self.apart[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            own, place = np.unique(key[miss], return_inverse=True)
            values = np.zeros(len(own), bool)
            s, n = self.v.strings, len(self.v.strings)
            for j, k in enumerate(own.tolist()):
                got = self.new.get(k)
                if got is None:
                    x, y = s[k // n], s[k % n]
                    got = self.new[k] = self.v.merge(x + y) == [x, y]
                values[j] = got
            out[miss] = values[place]
        return out


class SuffixMatcher:
    """All occurrences of all pieces in a text of units."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        ids = vocabulary.plain
        self.ids = np.array(ids, np.int64)
        self.lens = np.array([len(vocabulary.strings[i]) for i in ids], np.int64)
        self.codes = np.zeros((len(ids), MAX_PIECE), np.int64)
        for row, i in zip(self.codes, ids):
            row[: len(vocabulary.strings[i])] = [ord(c) + 1 for c in vocabulary.strings[i]]

    @staticmethod
    def _packed(symbols: np.ndarray) -> np.ndarray:
        """Four 16-bit symbols from each position on."""
        padded = np.concatenate((symbols, np.zeros(3, np.uint64)))
        n = len(symbols)
        out = np.zeros(n, np.uint64)
        for j in range(4):
            out = (out << np.uint64(16)) | padded[j : j + n]
        return out

    @staticmethod
    def _sorted(first: np.ndarray) -> np.ndarray:
        """Suffixes by MAX_PIECE symbols, from keys of four symbols, by doubling."""
        n, size = len(first), 4
        order = np.argsort(first)
        while size < MAX_PIECE:
            same = first[order[1:]] != first[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([1], 1 + np.cumsum(same)))
            if rank[order[-1]] == n:
                break
            second = np.concatenate((rank[size:], np.zeros(min(size, n), np.int64)))[:n]
            first = rank * (n + 1) + second
            order = np.argsort(first)
            size *= 2
        return order

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """codes: code points + 1, and 0 between units. Start, length, piece of each occurrence."""
        alphabet = np.unique(np.concatenate(([0], codes)))
        n = len(codes)
        text = np.searchsorted(alphabet, codes).astype(np.uint64)
        packed = np.concatenate((self._packed(text), np.zeros(MAX_PIECE, np.uint64)))
        suffixes = self._sorted(packed[:n])
        keys = [packed[4 * j : 4 * j + n][suffixes] for j in range(MAX_PIECE // 4)]
        # Pieces in the text's alphabet.
        at = np.minimum(np.searchsorted(alphabet, self.codes), len(alphabet) - 1)
        known = (alphabet[at] == self.codes).all(1)
        piece, lens = at[known].astype(np.uint64), self.lens[known]
        free = np.arange(MAX_PIECE)[None, :] >= lens[:, None]
        pack4 = lambda x: [sum(x[:, 4 * j + i] << np.uint64(48 - 16 * i) for i in range(4)) for j in range(MAX_PIECE // 4)]
        lo = self._search(keys, pack4(np.where(free, np.uint64(0), piece)), n, False)
        hi = self._search(keys, pack4(np.where(free, np.uint64(0xFFFF), piece)), n, True)
        count = hi - lo
        start = suffixes.astype(np.int32)[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        return start, np.repeat(lens.astype(np.int32), count), np.repeat(self.ids[known].astype(np.int32), count)

    @staticmethod
    def _search(keys: list, want: list, n: int, right: bool) -> np.ndarray:
        """For each wanted key the number of suffixes below it (or not above it)."""
        lo, hi = np.zeros(len(want[0]), np.int64), np.full(len(want[0]), n)
        for _ in range(n.bit_length() + 1):
            mid = np.minimum((lo + hi) >> 1, n - 1)
            below, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k, w in zip(keys, want):
                x = k[mid]
                below |= equal & (x < w)
                equal &= x == w
            go = (below | (equal & right)) & (lo < hi)
            lo, hi = np.where(go, mid + 1, lo), np.where(go, hi, np.where(lo < hi, mid, hi))
        return lo


class Numbering(dict):
    """Numbers units in the order in which they first come; ``new`` has those since it was cleared."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.matcher, self.apart = vocabulary, SuffixMatcher(vocabulary), PairTable(vocabulary)
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbering()
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and how many each has."""
        lens = np.fromiter(map(len, units), np.int64, len(units))
        start = np.cumsum(lens + 1) - (lens + 1)
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.zeros(int((lens + 1).sum()), np.int64)
        inside = np.ones(len(codes), bool)
        inside[start + lens] = False
        codes[inside] = flat + 1
        if len(np.unique(codes)) > 0xFFFE and len(units) > 1:
            half = len(units) // 2
            parts = self.encode_units(units[:half]), self.encode_units(units[half:])
            return tuple(np.concatenate(x) for x in zip(*parts))
        a, size, piece = self.matcher.edges(codes)
        bare = inside.copy()
        bare[a[size == 1]] = False
        bare = np.flatnonzero(bare).astype(np.int32)
        a = np.concatenate((a, bare))
        end = a + np.concatenate((size, np.ones(len(bare), np.int32)))
        piece = np.concatenate((piece, np.full(len(bare), UNKNOWN, np.int32)))
        # Edges by how far from the unit's start they end: edges of one group don't depend on each other.
        reach = end - np.repeat(start.astype(np.int32), lens + 1)[a]
        narrow = reach.astype(np.uint16) if reach.max(initial=0) < 1 << 16 else reach
        order = np.argsort(narrow, kind="stable")
        a, end, piece = a[order], end[order], piece[order]
        cuts = np.flatnonzero(np.diff(narrow[order])) + 1
        last = np.full(len(codes) + 1, UNREACHED, np.int32)
        origin = np.zeros(len(codes) + 1, np.int32)
        last[start] = BEGIN
        for x, y in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(a)]))):
            live = x + np.flatnonzero(last[a[x:y]] != UNREACHED)
            left, p = last[a[live]], piece[live]
            good = np.ones(len(live), bool)
            ask = np.flatnonzero((left >= 0) & (p >= 0))
            if len(ask):
                good[ask] = self.apart(left[ask].astype(np.int64), p[ask].astype(np.int64))
            live, p = live[good], p[good]
            to = end[live]
            last[to], origin[to] = p, a[live]
        self.apart.settle()
        # Back from each unit's end; a token is noted at its first position.
        token = np.full(len(codes), UNREACHED, np.int32)
        first, at = start[lens > 0], (start + lens)[lens > 0]
        while len(at):
            before = origin[at]
            token[before] = last[at]
            more = before > first
            first, at = first[more], before[more]
        where = np.flatnonzero(token != UNREACHED)
        ids = token[where]
        count = np.bincount(np.searchsorted(start, where, "right") - 1, minlength=len(units))
        odd = np.flatnonzero(ids == UNKNOWN)
        if len(odd):  # letters of no piece: their bytes
            own = [[self.v.id_of_byte[b] for b in chr(int(codes[p]) - 1).encode("utf-8", "surrogatepass")] for p in where[odd]]
            size = np.ones(len(ids), np.int64)
            size[odd] = [len(x) for x in own]
            unit = np.searchsorted(start, where, "right") - 1
            count = np.bincount(unit, size, len(units)).astype(np.int64)
            ids = np.repeat(ids, size)
            ids[ids == UNKNOWN] = list(chain.from_iterable(own))
        return ids, count

    @staticmethod
    def units(text: str) -> list[str]:
        """Parts that start at a space mark, which is left out where it is the only one."""
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, marks = [], ""
        for p in parts:
            marks += MARK
            if p:
                out.append(marks + p if len(marks) > 1 else p)
                marks = ""
        return out + [marks] if marks else out

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, a batch at a time."""
        a = 0
        while a < len(texts):
            if len(self.numbers) > UNIT_CACHE:
                self.forget()
            b, size, rows, number = a, 0, [], self.numbers.__getitem__
            while b < len(texts) and (b == a or size + len(texts[b] or "") < BATCH_CHARS):
                size += len(texts[b] or "")
                rows.append(list(map(number, self.units(texts[b]))) if texts[b] else [])
                b += 1
            if new := self.numbers.new:
                ids, count = self.encode_units([u if u[0] == MARK else MARK + u for u in new])
                self.ids = np.concatenate((self.ids, ids))
                self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(count)))
                new.clear()
            flat = np.fromiter(chain.from_iterable(rows), np.int64, sum(map(len, rows)))
            n = self.ends[flat + 1] - self.ends[flat]
            place = np.concatenate(([0], np.cumsum(n)))
            ids = self.ids[np.repeat(self.ends[flat] - place[:-1], n) + np.arange(place[-1])]
            cuts = place[np.concatenate(([0], np.cumsum([len(r) for r in rows])))]
            for x, y in zip(cuts.tolist(), cuts[1:].tolist()):
                yield ids[x:y]
            a = b


def encoder(path: str) -> Encoder:
    return process_cache(("piece-encoder", path), lambda: Encoder(Vocabulary(path)))


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_ids, ids, round_trip (whether decoding gives the text
    back). model_path must be readable on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path or default_model_path())
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                texts = part.column(1).to_pylist()
                ids = list(own.encode(texts))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                same = [own.v.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(same)],
                    ["doc_id", "n_ids", "ids", "round_trip"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with ids; null ids give null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path or default_model_path()).v
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
