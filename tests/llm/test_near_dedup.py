"""The pipeline's near-duplicate stage against all pairs."""

import random
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from stratalog.llm import near_dedup

STAGE = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_kept(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(d for i, (d, _) in enumerate(rows) if d == least[find(i)])


@pytest.mark.parametrize("sample", [20_000, 3])
def test_near_dedup(spark, monkeypatch, sample):
    """Copies with single words changed, around the bound; a common passage; short and empty texts."""
    monkeypatch.setattr(near_dedup, "SAMPLE", sample)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(20, 300))
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.randint(0, max(1, len(w) // 30))):
                w[at] = rng.choice(vocabulary)
            texts.append(" ".join(w[rng.randint(0, 3) :]))
    texts += ["", None, " \t", "one two", "One  TWO", "one", texts[0].upper(), texts[0]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in STAGE(spark, docs, "").collect())
    assert got == brute_kept(rows)


def test_near_dedup_drops_rows_not_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(3, a), (5, a + " more"), (5, b), (None, a)], "doc_id long, text string")
    assert {tuple(r) for r in near_dedup.near_dedup(docs).collect()} == {(3, a), (5, b), (None, a)}
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_search_of_a_bucket_in_little_memory():
    """All pairs of a bucket within the distance, in slices that leave an executor's memory alone."""
    rng = np.random.default_rng(1)
    n = 3000
    fp = rng.integers(-(2**63), 2**63 - 1, 40)[rng.integers(0, 40, n)]
    for _ in range(15):
        fp = fp ^ (np.int64(1) << rng.integers(0, 63, n))
    size, c = rng.integers(70, 130, n), rng.integers(0, 60, n)
    tracemalloc.start()
    found = list(near_dedup._other_pairs([np.zeros(n, np.int64), np.arange(n), size, fp, c]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    bits = fp.view(np.uint64)
    want = set()
    for a in range(n):
        b = np.arange(a + 1, n)
        fits = (np.bitwise_count(bits[a] ^ bits[b]) <= near_dedup.DISTANCE) & (c[a] != c[b])
        fits &= 5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b])
        want.update((a, int(x)) for x in b[fits])
    assert len(want) > 10_000
    assert sorted((x["a"], x["b"]) for batch in found for x in batch.to_pylist()) == sorted(want)
    assert most < 64e6


def test_pairs_to_check_are_few(spark, monkeypatch):
    """A large group of near copies, and many texts that share a passage and are not alike: what is
    checked on whole texts is linear in both, and nothing is lost."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(5000)]
    base, passage = rng.choices(vocabulary, k=120), rng.choices(vocabulary, k=70)
    texts = []
    for _ in range(200):
        w = list(base)
        for at in rng.sample(range(len(w)), 2):
            w[at] = rng.choice(vocabulary)
        texts.append(" ".join(w))
        texts.append(" ".join(passage + rng.choices(vocabulary, k=60)))
    rows = list(enumerate(texts))
    checked, similar = [], near_dedup._similar

    def counted(pairs, texts):
        checked.append(pairs.distinct().count())
        return similar(pairs, texts)

    monkeypatch.setattr(near_dedup, "_similar", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dedup.near_dedup(docs).collect()) == brute_kept(rows)
    assert sum(checked) < 8 * len(rows)


def test_parities_lose_no_pair():
    """Sets of similarity 0.8 or more differ in at most a ninth of both sizes; others mostly in more."""
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 300, 1500, 20_000):
        s = rng.integers(-(2**63), 2**63 - 1, 2 * n)
        for shared in (n - n // 10, n // 2):
            a, b = s[:n], np.concatenate((s[:shared], s[n : 2 * n - shared]))
            x, y = (near_dedup._parity_words([near_dedup.parities(z)]) for z in (a, b))
            differ = int(near_dedup._parity_distance(x, y, np.zeros(1, int), np.zeros(1, int))[0])
            assert differ <= 2 * (n - shared)
            assert shared > n // 2 or not 40 <= n <= 1500 or 9 * differ > 2 * n
