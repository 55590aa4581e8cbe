"""Best-fit packing of token sequences by a grouping genetic algorithm.

1. Texts become token ids on the executors; a document's end is id 0. A document longer than a
   sequence is cut into full pieces, with the remainder first. Only (id, piece, start, length,
   crc32) leaves that pass, so texts are tokenised once and never shuffled.
2. Full pieces are sequences by themselves. The rest is dealt by hash to districts of about
   ``DISTRICT`` pieces: enough that a district wastes less than a sequence, and few enough that a
   task's memory is fixed.
3. Each district evolves on ``ISLANDS`` islands, each a task with a seed of its own. A chromosome
   is a list of bins; the first ones fill bins in random orders. Crossover injects well-filled bins
   of one parent whole into the other and removes the bins that hold a duplicate of an injected
   document; mutation dissolves some of the poorest bins that are left. Best fit, the longest
   first, then places the documents displaced by either, and only those. After each epoch an
   island's elite (its best packing) migrates to the next island of the ring, through a shuffle of
   narrow rows. An island stops at the lower bound on bins.
4. The district's best packing wins, the lower island number at a tie.

Ids are those of the ``tokenizers`` library for ``byte_bpe_50k.json``; the default encoder reads
the same vocabulary as ranks, with equal ids (tested), several times as fast.

Cases: null text is empty: one piece of one id; repeated rows are packed each; documents with
equal lengths are told apart by their place in the district; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, process_cache

CAPACITY = 2048
DISTRICT = 4096
ISLANDS = 4
EPOCHS = 2
POPULATION = 4
CHILDREN = 3
GENERATIONS = 3
#: Shares of the poorest bins that a mutation dissolves.
DISSOLVED = (0.02, 0.1, 0.3)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, row long"


def tiktoken_encoder():
    """text -> ids as uint32, for the vocabulary of byte_bpe_50k."""

    def make():
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: np.array(own.encode_ordinary(text), np.uint32)

    return process_cache(("byte_bpe_50k", "tiktoken"), make)


def token_pieces(docs: DataFrame, encoder=tiktoken_encoder, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document. sequence_id is set for full pieces; ``row`` tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, n = encoder(), TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                cuts = list(range(len(ids) % capacity, len(ids) + 1, capacity))
                if cuts[0]:
                    cuts.insert(0, 0)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    n += 1
                    whole = b - a == capacity
                    for col, x in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), (1 << 62) | n if whole else None, n)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "row"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(run, PIECES)


class Packer:
    """The grouping genetic algorithm over one district's lengths. A bin is its fill and its items."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.len, self.cap, self.rng = lengths, capacity, random.Random(seed)
        total = sum(lengths)
        self.bound = max(-(-total // capacity), sum(1 for x in lengths if 2 * x > capacity))
        self.generations = 0

    def fit(self, bins: list[tuple], items: list[int]) -> list[tuple]:
        """Best fit: each item in turn into the fullest bin that has room. Bins are kept by room,
        with a bit for each room that some bin has."""
        cap, lens = self.cap, self.len
        rooms: dict[int, list] = {}
        bits = 0
        for b in bins:
            r = cap - b[0]
            if r in rooms:
                rooms[r].append(b[1])
            else:
                rooms[r] = [b[1]]
                bits |= 1 << r
        for i in items:
            x = lens[i]
            over = bits >> x
            if over:
                r = (over & -over).bit_length() - 1 + x
                own = rooms[r]
                b = own.pop()
                if not own:
                    del rooms[r]
                    bits &= ~(1 << r)
                b, r = (*b, i), r - x
            else:
                b, r = (i,), cap - x
            if r in rooms:
                rooms[r].append(b)
            else:
                rooms[r] = [b]
                bits |= 1 << r
        return [(cap - r, b) for r, own in rooms.items() for b in own]

    def fitness(self, bins: list[tuple]) -> tuple:
        """Fewer bins first, then the mean squared fill."""
        return (-len(bins), sum(b[0] * b[0] for b in bins))

    def first(self) -> list[tuple]:
        """A packing that fills bins in a random order."""
        items = list(range(len(self.len)))
        self.rng.shuffle(items)
        return self.fit([], items)

    def cross(self, a: list[tuple], b: list[tuple]) -> list[tuple]:
        full = self.cap - self.cap // 100
        good = [x for x in b if x[0] >= full] or [max(b)]
        injected = self.rng.sample(good, -(-len(good) // 2))
        taken = {i for x in injected for i in x[1]}
        kept, displaced = [], []
        for x in a:
            if taken.isdisjoint(x[1]):
                kept.append(x)
            else:
                displaced += [i for i in x[1] if i not in taken]
        kept.sort()
        poor = min(len(kept), max(2, int(len(kept) * self.rng.choice(DISSOLVED))))
        displaced += [i for x in kept[:poor] for i in x[1]]
        displaced.sort(key=self.len.__getitem__, reverse=True)
        return self.fit(kept[poor:] + injected, displaced)

    def evolve(self, elites: list[list[tuple]], generations: int = GENERATIONS) -> list[tuple]:
        people = list(elites)
        while len(people) < POPULATION:
            people.append(self.first())
        people.sort(key=self.fitness, reverse=True)
        for _ in range(generations):
            if len(people[0]) <= self.bound:
                break
            children = [self.cross(*self.rng.sample(people, 2)) for _ in range(CHILDREN)]
            people = sorted(people + children, key=self.fitness, reverse=True)[:POPULATION]
            self.generations += 1
        return people[0]


def _bins(pdf: pd.DataFrame, col: str) -> list[tuple]:
    own: dict[int, list] = {}
    for i, b in enumerate(pdf[col]):
        own.setdefault(b, []).append(i)
    lens = pdf["length"].tolist()
    return [(sum(lens[i] for i in x), tuple(x)) for x in own.values()]


ISLAND = "district long, island int, kind int, row long, length long, bin int"


def _epoch(capacity: int, islands: int, epoch: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        district, island = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["kind", "row"], kind="stable")
        own = pdf[pdf["kind"] == pdf["kind"].iloc[0]].reset_index(drop=True)
        elites = [] if epoch == 0 else [_bins(g.reset_index(drop=True), "bin") for _, g in pdf.groupby("kind")]
        packer = Packer(own["length"].tolist(), capacity, hash((district, island, epoch)))
        best = packer.evolve(elites)
        number = np.zeros(len(own), np.int32)
        for b, (_, items) in enumerate(best):
            number[list(items)] = b
        out = own.assign(bin=number, kind=0, island=island)[["district", "island", "kind", "row", "length", "bin"]]
        if last or islands == 1:
            return out
        return pd.concat([out, out.assign(kind=1, island=(island + 1) % islands)])

    return run


def _best_island(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf.groupby("island")["bin"].nunique()
        own = pdf[pdf["island"] == n.index[int(n.to_numpy().argmin())]].sort_values(["bin", "row"])
        offset = own.groupby("bin")["length"].cumsum() - own["length"]
        return pd.DataFrame({"row": own["row"], "seq": own["bin"].astype("int64") + (int(key[0]) << 31), "offset": offset})

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, district: int = DISTRICT, islands: int = ISLANDS, epochs: int = EPOCHS, encoder=tiktoken_encoder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(token_pieces(docs, encoder, capacity, id_col, text_col), "packing-pieces")
    loose = pieces.where("sequence_id IS NULL")
    districts = max(1, round(loose.count() / district))
    deal = F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(districts)).alias("district")
    people = loose.select(
        deal, F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(0).alias("kind"),
        "row", "length", F.lit(0).alias("bin"),
    )
    for epoch in range(epochs):
        run = _epoch(capacity, islands, epoch, epoch == epochs - 1)
        people = people.groupBy("district", "island").applyInPandas(run, ISLAND)
    placed = people.groupBy("district").applyInPandas(_best_island(capacity), "row long, seq long, offset long")
    return pieces.join(placed, "row", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", "seq").alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"),
    )
