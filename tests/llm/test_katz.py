"""The trigram model against a plain Katz model in Python."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import lm_scoring

SCHEMA = "doc_id long, text string"


def corpus():
    rng = random.Random(8)
    vocab = ["the", "of", "and", "stone", "river", "Über", "ça", "x9", "light", "Wind", "salt", "rare"]
    texts = [" ".join(rng.choices(vocab, [9, 7, 5, 3, 3, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 40))) for _ in range(120)]
    texts += texts[:15] + [None, "", " \t", "unseen words only here", "THE of AND", "the " * 300, "a" * 3000]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, "no id the of"), rows[3]]


class Plain:
    """P(w | two words before), from training texts as lists of words with an end."""

    def __init__(self, texts):
        self.n = [collections.Counter() for _ in range(3)]
        self.ctx = [collections.Counter() for _ in range(3)]
        for w in texts:
            w = ["<s>", *w]
            for i in range(1, len(w)):
                self.n[0][w[i]] += 1
                for k in (1, 2):
                    if i >= k:
                        self.n[k][(*w[i - k : i], w[i])] += 1
                        self.ctx[k][tuple(w[i - k : i])] += 1
        self.d = []
        for c in self.n:
            of = np.zeros(lm_scoring.K + 2)
            for v in c.values():
                if v <= lm_scoring.K + 1:
                    of[v] += 1
            self.d.append(lm_scoring.good_turing(of))
        self.followers = [collections.defaultdict(list) for _ in range(3)]
        for k, least in ((1, 1), (2, lm_scoring.STORED)):
            for g, v in self.n[k].items():
                if v >= least:
                    self.followers[k][g[:-1]].append((g[-1], v))

    def cut(self, k, c):
        return (self.d[k][c] if c <= lm_scoring.K else 1.0) * c

    def p(self, w, h):
        if not h:
            total = sum(self.n[0].values())
            seen = sum(self.cut(0, c) for c in self.n[0].values())
            whole, rest = (total, 1 - seen / total) if seen < total - 1e-9 else (total + 1, 1 / (total + 1))
            return self.cut(0, self.n[0][w]) / whole if self.n[0][w] else rest
        k, size = len(h), self.ctx[len(h)][h]
        if not size:
            return self.p(w, h[1:])
        left = size - sum(self.cut(k, c) for _, c in self.followers[k][h])
        whole = size
        if left <= 1e-9 * size:
            left, whole = 1, size + 1
        for x, c in self.followers[k][h]:
            if x == w:
                return self.cut(k, c) / whole
        return left / whole / (1 - sum(self.p(x, h[1:]) for x, _ in self.followers[k][h])) * self.p(w, h[1:])


def words(text):
    return [*(text or "").encode().translate(lm_scoring.LOWER).split(), "</s>"]


def held(i):
    return i is not None and i % 10 == 0


@pytest.fixture(scope="module")
def plain():
    return Plain([words(t) for i, t in corpus() if not held(i)])


def fold():
    return F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False))



@pytest.mark.parametrize("block", [300, 100_000])
def test_scores(spark, plain, block):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    got = lm_scoring.katz_scores(docs, fold(), block=block).collect()
    total, types = sum(plain.n[0].values()), len(plain.n[0])
    want = []
    for i, t in corpus():
        w = words(t)
        x = ["<s>", *w]
        score = sum(math.log10(plain.p(x[j], tuple(x[max(0, j - 2) : j]))) for j in range(1, len(x)))
        base = sum(math.log10((plain.n[0][y] + 0.1) / (total + 0.1 * (types + 1))) for y in w)
        want.append((str(i), held(i), len(w), sum(plain.n[0][y] > 0 for y in w), total, round(base, 6), round(score, 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == sorted(want)


def test_sums_to_one_at_every_order(plain):
    for h in [(), ("<s>",), (b"the",), (b"rare",), ("<s>", b"the"), (b"the", b"of"), (b"of", b"the"), (b"salt", b"rare")]:
        assert sum(plain.p(w, h) for w in plain.n[0]) + plain.p("never seen", h) == pytest.approx(1)


def test_stored_tables(spark, plain):
    """Counts, discounts and backoff weights as they are written."""
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model, _, answers = lm_scoring.fit(docs, fold(), block=300)
    rows = lm_scoring.tables(model, answers).toPandas()
    one = rows[rows["order"] == 1]
    name = {int(n): bytes(t) or "</s>" for n, t in zip(one["word"], one["text"])} | {-1: None, model.beginning: "<s>"}
    assert {name[w]: c for w, c in zip(one["word"], one["count"]) if c} == dict(plain.n[0])
    for k, order in ((1, 2), (2, 3)):
        some = rows[rows["order"] == order]
        got = {tuple(name[x] for x in g if x >= 0): (c, round(d, 9)) for *g, c, d in some[["u", "v", "word", "count", "discounted"]].itertuples(index=False)}
        assert got == {g: (c, round(plain.cut(k, c), 9)) for g, c in plain.n[k].items() if c >= lm_scoring.STORED}
    weights = lm_scoring.contexts(model, answers).toPandas()
    assert set(weights["order"]) == {2, 3}
    for r in weights.itertuples():
        h = tuple(name[x] for x in (r.u, r.v) if x >= 0)
        lacks = next(w for w in [*plain.n[0], "never seen"] if w not in dict(plain.followers[len(h)][h]))
        assert r.context_count == plain.ctx[len(h)][h]
        assert r.backoff == pytest.approx(plain.p(lacks, h) / plain.p(lacks, h[1:]))


def test_words_that_a_polynomial_hash_confuses(spark):
    """Two words of a and b that agree in every polynomial hash modulo 2^64 are two words."""
    x = "a"
    for _ in range(11):
        x += x.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, x), (10, x.translate(str.maketrans("ab", "ba")))], SCHEMA)
    got = {r["doc_id"]: r["n_known"] for r in lm_scoring.katz_scores(docs, fold()).collect()}
    assert got == {1: 2, 10: 1}


def test_blocks_work_out_their_questions_once(spark, plain, monkeypatch):
    """Two questions a block (pairs, triples), however many rounds they travel in; the written questions
    are deleted."""
    asked, deleted = spark.sparkContext.accumulator(0), []
    rows, delete = lm_scoring.Asked.rows, lm_scoring._delete

    def counted(self, *args):
        asked.add(1)
        return rows(self, *args)

    monkeypatch.setattr(lm_scoring.Asked, "rows", counted)
    monkeypatch.setattr(lm_scoring, "_delete", lambda s, path: (deleted.append(path), delete(s, path)))
    docs = spark.createDataFrame(corpus(), SCHEMA).coalesce(1)
    model, packed, answers = lm_scoring.fit(docs, fold(), block=300)
    assert asked.value == 2 * packed.count()
    assert len(deleted) == lm_scoring.ROUNDS
    assert lm_scoring.tables(model, answers).where("order = 3").count() == sum(c >= lm_scoring.STORED for c in plain.n[2].values())


@pytest.mark.parametrize("dtype", ["uint8", "uint32", "int64", "float64"])
def test_packed_numbers(dtype):
    for a in ([], [0], [0, 1, 255], [3, 200] * 40, [256, 65_536, 2**31], [-1, 5], [2**62, 0]):
        if a and (min(a) < 0 and dtype[0] == "u" or dtype[0] != "f" and max(a) > np.iinfo(dtype).max):
            continue
        x = np.array(a, dtype)
        got = lm_scoring.unpack(lm_scoring.pack(x), dtype)
        assert got.dtype == x.dtype and got.tolist() == x.tolist()
    small = lm_scoring.pack(np.random.default_rng(1).integers(0, 256, 1000))
    assert len(small) < 1100
