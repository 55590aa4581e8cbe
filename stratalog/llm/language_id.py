"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over *all* its segmentations into pieces, computed by a forward recursion; a text's
log-likelihood is the sum over its words, and the language with the largest one wins.

Words are the lower-cased letters of a token, with a start mark. Words of any length are scored
whole, over all pieces of the vocabulary that letters can match, whatever their length: the
recursion keeps only as many positions as the longest piece has letters, and is rescaled every
``RESCALE`` letters. Letters that no piece covers have an edge of their own with a small
probability, the same for all languages.

Training is expectation-maximisation over forward-backward piece counts, on the driver, from a
bounded sample of labelled rows: ``TRAIN_DOCS`` rows a language (those with the smallest hash of id
and text), of these the ``TRAIN_WORDS`` most frequent words of at most ``TRAIN_LETTERS`` letters.
Every labelled language is learned. Prediction is a map over whole texts: no shuffle, memory
bounded by ``WORD_CACHE`` words.

``language_filter`` compares the learned languages with one another. It rejects text without a
letter and text that it can't tell apart (mostly a few short words); text of some length in a
language that no row is labelled with goes to the learned language that is least unlike it.

Cases: null text, and text without a letter, is ``und`` with score 0; equal likelihoods go to the
first language in order; repeated rows each get a row; no labelled text at all makes every
prediction ``und``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, process_cache

VOCABULARY = "piece_bpe_32k.model"
TRAIN_DOCS = 400
TRAIN_WORDS = 100_000
TRAIN_LETTERS = 40
EM_ROUNDS = 4
RESCALE = 24
WORD_CACHE = 300_000
SCORE_CHARS = 1_000_000
#: Letters whose edges are held at a time.
LETTERS = 400_000
#: Words from this length on are scored one by one.
LONG = 2_000
UNKNOWN = 1e-7
START = "▁"
SCHEMA = "doc_id long, lang_pred string, score double"


class Lattice:
    """Pieces of the vocabulary as a table of hashes, and the forward and backward
    recursions over all words of a batch at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        own = np.zeros((len(pieces), self.longest), np.uint64)
        lens = np.zeros(len(pieces), np.int64)
        for i, p in enumerate(pieces):
            own[i, : len(p)] = [ord(c) + 1 for c in p]
            lens[i] = len(p)
        h = self._start(len(pieces))
        out = np.zeros(len(pieces), np.uint64)
        # Slots of 2^22 that some beginning of a piece has: others need not be looked at further.
        self.begins = np.zeros(1 << 22, bool)
        for k in range(self.longest):
            h = self._step(h, own[:, k])
            out = np.where(lens == k + 1, h, out)
            self.begins[h[lens > k] >> np.uint64(42)] = True
        # A direct-mapped table of 2^20 slots; pieces that share a slot go to further layers.
        self.hashes, self.slots = out, []
        rest = np.arange(len(pieces))
        while len(rest):
            slot = out[rest] >> np.uint64(44)
            _, first = np.unique(slot, return_index=True)
            layer = np.zeros(1 << 20, np.int32)
            layer[slot[first]] = rest[first]
            self.slots.append(layer)
            rest = np.delete(rest, first)

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1."""
        slot = h >> np.uint64(44)
        piece = np.full(len(h), -1, np.int64)
        for layer in self.slots:
            at = layer[slot]
            piece = np.where(self.hashes[at] == h, at, piece)
        return piece

    @staticmethod
    def _start(n: int) -> np.ndarray:
        return np.full(n, 1469598103934665603, np.uint64)

    @staticmethod
    def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def _edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of words, and of each edge, sorted by (end, length): word, end, length, piece. A
        letter that is no piece still has an edge, with piece -1."""
        lens = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        word = np.repeat(np.arange(len(words)), lens)
        left = np.repeat(np.cumsum(lens), lens) - np.arange(len(chars))  # letters from here to the end
        live, h = np.arange(len(chars)), self._start(len(chars))
        parts: list = []
        for k in range(self.longest):
            keep = left[live] > k
            live, h = live[keep], h[keep]
            h = self._step(h, chars[live + k])
            piece = self._lookup(h)
            hit = slice(None) if k == 0 else piece >= 0
            at = live[hit]
            parts.append((word[at], lens[word[at]] - left[at] + k + 1, np.full(len(at), k + 1), piece[hit]))
            more = self.begins[h >> np.uint64(42)]
            live, h = live[more], h[more]
            if not len(live):
                break
        who, end, size, piece = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(end * (self.longest + 1) + size, kind="stable")
        return lens, who[order], end[order], size[order], piece[order]

    def edges(self, words: list[str]) -> tuple[np.ndarray, list, int]:
        """Lengths, and for each end the edges there, as (length, words, pieces)."""
        lens, who, end, size, piece = self._edges(words)
        width = int(lens.max())
        found: list = [[] for _ in range(width + 1)]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(end) != 0) | (np.diff(size) != 0))))
        for a, b in zip(first.tolist(), np.append(first[1:], len(end)).tolist()):
            found[int(end[a])].append((int(size[a]), who[a:b], piece[a:b]))
        return lens, found, width

    def forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations, for each word and language. prob: a row a piece,
        and a last row for letters outside the vocabulary."""
        out = np.zeros((len(words), prob.shape[1]))
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        a = 0
        while a < len(order):  # words of like length together, so many that their letters fit
            b = a + 1
            while b < len(order) and size[order[b]] <= 2 * size[order[a]] + 8 and (b - a) * size[order[b]] < LETTERS:
                b += 1
            some = [words[i] for i in order[a:b]]
            out[order[a:b]] = self._forward(some, prob) if b - a > 1 or len(some[0]) < LONG else self._forward_one(some[0], prob)
            a = b
        return out

    def _forward_one(self, word: str, prob: np.ndarray) -> np.ndarray:
        """As _forward, for one long word: letter by letter, without arrays a position."""
        out, langs = np.zeros(prob.shape[1]), range(prob.shape[1])
        rows = prob.tolist()
        ring = self.longest + 1
        alpha = [[1.0] * len(langs)] + [[0.0] * len(langs) for _ in range(ring - 1)]
        scale = [0.0] * len(langs)
        for a in range(0, len(word), LETTERS):  # edges of so many letters at a time
            back = min(a, self.longest)
            _, _, ends, sizes, pieces = self._edges([word[a - back : a + LETTERS]])
            keep = ends > back
            at, now = back, alpha[0]
            for end, k, piece in zip(ends[keep].tolist(), sizes[keep].tolist(), pieces[keep].tolist()):
                if end != at:
                    if (a + at - back) % RESCALE == 0:
                        by = [x if x > 0 else 1.0 for x in alpha[(a + at - back) % ring]]
                        scale = [s + math.log(x) for s, x in zip(scale, by)]
                        alpha = [[y / x for y, x in zip(row, by)] for row in alpha]
                    at = end
                    now = alpha[(a + at - back) % ring] = [0.0] * len(langs)
                before, p = alpha[(a + end - back - k) % ring], rows[piece]
                for j in langs:
                    now[j] += before[j] * p[j]
        for j in langs:
            out[j] = math.log(max(alpha[len(word) % ring][j], 1e-300)) + scale[j]
        return out

    def _forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        lens, found, width = self.edges(words)
        ring = self.longest + 1
        alpha = np.zeros((min(ring, width + 1), len(words), prob.shape[1]))
        ring = len(alpha)
        alpha[0] = 1
        scale, out = np.zeros(alpha.shape[1:]), np.zeros(alpha.shape[1:])
        for end in range(1, width + 1):
            now = alpha[end % ring]
            now[:] = 0
            for k, who, piece in found[end]:
                now[who] += alpha[(end - k) % ring, who] * prob[piece]
            done = lens == end
            if done.any():
                out[done] = np.log(np.maximum(now[done], 1e-300)) + scale[done]
            if end % RESCALE == 0 and end < width:
                by = np.where(now > 0, now, 1.0)
                scale += np.log(by)
                alpha /= by
        return out

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected piece counts of one language. prob: as above, one column."""
        lens, found, width = self.edges(words)
        n = len(words)
        alpha, beta = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        alpha[0] = 1
        p = prob[:, 0]
        for end in range(1, width + 1):
            for k, who, piece in found[end]:
                alpha[end, who] += alpha[end - k, who] * p[piece]
        beta[lens, np.arange(n)] = 1
        weight = counts / np.maximum(alpha[lens, np.arange(n)], 1e-300)
        out = np.zeros(len(p))
        for end in range(width, 0, -1):
            for k, who, piece in found[end]:
                through = p[piece] * beta[end, who]
                out += np.bincount(piece % len(p), alpha[end - k, who] * through * weight[who], len(p))
                beta[end - k, who] += through
        return out


def word_of(token: str) -> str:
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


def vocabulary() -> list[str]:
    """The lower-cased pieces made of letters, with or without the start mark: all that a word of
    letters can contain."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(VOCABULARY))
    out = {START}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i).lower()
        if p.lstrip(START).isalpha() and START not in p[1:]:
            out.add(p)
    return sorted(out)


def lattice() -> Lattice:
    return process_cache(("language-lattice", VOCABULARY), lambda: Lattice(vocabulary()))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities, from a bounded sample of ``docs``: at most ``per_lang``
    rows of each language. Rows are thinned by hash to a few times ``per_lang`` a language where
    there are more, and only what is left is ranked; a row's text and label stay together."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")
    )
    counts = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    share = F.ceil(F.lit(4 * per_lang << 32) / F.col("n")).alias("share")  # of hashes below 2^32
    thin = rows.withColumn("u", F.pmod(F.xxhash64("i", "t"), F.lit(1 << 32))).join(F.broadcast(counts.select("l", share)), "l").where("u < share")  # a row a language, as the model has columns
    w = Window.partitionBy("l").orderBy("u", "i", "t")
    sample = thin.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_lang)
    words = sample.select("l", F.explode(F.split(F.lower("t"), r"\s+")).alias("w")).where(F.length("w").between(1, TRAIN_LETTERS))
    table = words.groupBy("l", "w").count()
    w = Window.partitionBy("l").orderBy(F.desc("count"), "w")
    return fit(table.withColumn("r", F.row_number().over(w)).where(F.col("r") <= TRAIN_WORDS).select("l", "w", "count").toPandas())


def fit(table) -> tuple[list[str], np.ndarray]:
    """table: columns l, w, count."""
    net = lattice()
    langs = sorted(table["l"].unique())
    n = len(net.pieces)
    prob = np.full((n + 1, len(langs)), 1.0 / n)
    prob[n] = UNKNOWN
    for j, lang in enumerate(langs):
        counts: dict[str, float] = {}
        part = table[table["l"] == lang]
        for token, c in zip(part["w"], part["count"]):
            if w := word_of(token):
                counts[START + w] = counts.get(START + w, 0) + c
        if not counts:
            continue
        words, weights = list(counts), np.array(list(counts.values()), float)
        own = prob[:, j : j + 1].copy()
        for _ in range(EM_ROUNDS):
            total = np.full(n, 0.05)
            for a in range(0, len(words), 20_000):
                total += net.expected(words[a : a + 20_000], weights[a : a + 20_000], own)[:n]
            own[:n, 0] = total / total.sum()
        prob[:, j : j + 1] = own
    return langs, prob


class Scorer:
    """Log-likelihoods of whole texts; words seen before are looked up."""

    def __init__(self, langs: list[str], prob: np.ndarray):
        self.langs, self.prob, self.net = langs, prob, lattice()
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, len(langs)))

    def _learn(self, tokens: set[str]) -> None:
        todo = list(tokens)
        for a in range(0, len(todo), 10_000):
            own, parts = [], []
            for i, t in enumerate(todo[a : a + 10_000]):
                if w := word_of(t):
                    own.append(i)
                    parts.append(START + w)
            out = np.zeros((len(todo[a : a + 10_000]), len(self.langs)))
            if parts:
                out[own] = self.net.forward(parts, self.prob)
            at = len(self.seen)
            while at + len(out) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at : at + len(out)] = out
            self.seen.update(zip(todo[a : a + 10_000], range(at, at + len(out))))

    def score(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        a = 0
        while a < len(texts):  # so many texts at a time that their words fit memory and cache
            b, size, split, new = a, 0, [], set()
            while b < len(texts) and (b == a or size + len(texts[b] or "") < SCORE_CHARS):
                size += len(texts[b] or "")
                split.append((texts[b] or "").lower().split())
                new.update(split[-1])
                b += 1
            if len(self.seen) + len(new) > WORD_CACHE:
                self.seen.clear()
            new.difference_update(self.seen)
            if new:
                self._learn(new)
            for words in split:
                yield self._best(words)
            a = b

    def _best(self, words: list[str]) -> tuple[str, float]:
        if not self.langs or not any(any(c.isalpha() for c in w) for w in words):
            return "und", 0.0
        seen = self.seen
        total = self.rows[[seen[w] for w in words]].sum(0)
        best = int(total.argmax())
        return self.langs[best], 1.0 / sum(math.exp(max(x - total[best], -700.0)) for x in total)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (posterior under equal priors)."""
    langs, prob = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, prob))  # vocabulary x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            got = list(scorer.score(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(run, SCHEMA)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Predictions for all rows by a model that learns from the rows outside fold 2 of 4."""
    model = train(docs.where(remainder("doc_id", 4) != 2))
    return predict(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def language_filter(docs: DataFrame, least_score: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language can be told, in the columns of ``docs``: it rejects ``und``
    (no letter) and predictions with a posterior below ``least_score`` among the learned languages.
    A map without a shuffle. If no row has a language to learn from, it rejects only text without
    a letter."""
    langs, prob = train(docs, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast((langs, prob))  # vocabulary x languages
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if scorer.langs:
                keep = [lang != "und" and score >= least_score for lang, score in scorer.score(texts)]
            else:
                keep = [any(c.isalpha() for c in t or "") for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
