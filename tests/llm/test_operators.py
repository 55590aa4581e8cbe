"""Each operator against brute force on small fixtures that hold the awkward cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

from stratalog.llm import (
    components,
    exact_dedup,
    html_extraction,
    language_id,
    lm_scoring,
    packing,
    piece_encoding,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
)

from . import layouts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return (text or "").encode().split()


def fixture_rows():
    rng = random.Random(5)
    vocab = ["the", "of", "and", "stone", "river", "Über", "señal", "ça", "x9", "light", "Wind", "salt"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = " ".join(f"p{i}" for i in range(60))
    base = [make(rng.randint(0, 60)) for _ in range(40)]
    texts = base + base[:10] + [f"{make(8)} {passage} {make(9)}" for _ in range(6)]
    near = make(120)
    texts += [near, near.replace(near.split()[3], "changed", 1), near + " tail"]
    texts += [None, "", " \t\n", "a\tb", "a  b", "!!! 123", "line\nline\nother\nline", make(3000), "x" * 5000, " nbsp is a word", "🎉 " * 30]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s1", None, "s0", "s0"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, "no id here", "en", "s0", 10))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names clash with what operators compute."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3)
    clash = {c: F.lit("clash") for c in ("h", "norm", "kept", "keep_id", "fp", "component_id", "marks", "bytes", "depth", "w", "n_words", "score", "block", "row")}
    return df.withColumns(clash).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(rows):
    return [r for r in rows if r[0] is not None]


# 3: exact dedup


def test_exact_dedup(docs):
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = fixture_rows()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = sorted(
        (str(r[0]), min((i for i in groups[norm(r[1])] if i is not None), default=None), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest())
        for r in rows
    )
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["keep_id"] == r["doc_id"]) for r in got if r["doc_id"] is not None)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {r["keep_id"] for r in got if r["keep_id"] is not None}


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0


# 6: sharding


def test_sharding(docs):
    rows = sharding.assign_shards(docs, limit_bytes=900, bits_per_round=3).toPandas()
    assert len(rows) == docs.count()
    per = rows.groupby("shard").agg(total=("bytes", "sum"), n=("bytes", "size"), stated=("shard_bytes", "first"), docs=("shard_docs", "first"))
    assert (per["total"] == per["stated"]).all() and (per["n"] == per["docs"]).all()
    assert ((per["total"] <= 900) | (per["n"] == 1)).all()
    # Split only as far as needed: the parent bucket would not have fitted.
    plain = rows[~rows["shard"].str.contains(r"\.")]
    for shard in set(plain["shard"]) - {""}:
        parent = rows[rows["shard"].str.startswith(shard[:-1])]
        assert parent["bytes"].sum() > 900


def test_sharding_hot_key(spark):
    """Rows of one key overflow into pages that fit; identical rows share one."""
    rows = [(7, f"text number {i} " * 5) for i in range(50)] + [(8, "z" * 2000), (9, None)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 500, bits_per_round=20).toPandas()
    per = got.groupby("shard")["bytes"].agg(["sum", "size"])
    assert len(got) == 52 and ((per["sum"] <= 500) | (per["size"] == 1)).all()


def test_sharding_empty(empty):
    assert sharding.assign_shards(empty).count() == 0


def test_write_shards(docs, spark, tmp_path):
    some = docs.where("doc_id IS NOT NULL").select("doc_id", "text").distinct()
    sharding.write_shards(some, str(tmp_path / "out"), 2000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == some.count()


# 10: quality rules


def brute_metrics(text):
    w = words_of(text)
    windows = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    covered = np.zeros(len(w), bool)
    for j in range(len(w) - 7):
        if windows[tuple(w[j : j + 8])] > 1:
            covered[j : j + 8] = True
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), int(covered.sum())


def test_quality_base_metrics(docs):
    want = {r[0]: brute_metrics(r[1]) for r in fixture_rows()}
    got = quality_rules.quality_verdicts(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        n = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_fences_adapt(spark):
    """What is normal for one source is an outlier in another."""
    rng = random.Random(1)
    make = lambda sym: " ".join(rng.choice(["stone", "river", "light", "wind", "salt", "cloud"]) + str(i) + (sym if rng.random() < 0.5 else "") for i in range(60))
    rows = [(i, make("###"), "en", "symbols") for i in range(300)] + [(1000 + i, make(""), "en", "plain") for i in range(300)]
    rows += [(5000, make("###"), "en", "plain")]
    v = {r["doc_id"]: r for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not v[5000]["kept"] and v[5000]["failed"] == "symbol_ratio"
    assert sum(not v[i]["kept"] for i in range(300)) == 0 and sum(not v[1000 + i]["kept"] for i in range(300)) == 0


def test_quality_empty(empty):
    assert quality_rules.quality_verdicts(empty).count() == 0


# 2: language identification


def test_forward_sums_all_segmentations():
    net = language_id.Lattice(["a", "b", "ab", "ba", "aba", language_id.START])
    prob = np.array([[0.3], [0.2], [0.1], [0.05], [0.02], [0.5], [1e-7]])
    table = dict(zip(net.pieces, prob[:, 0]))

    def brute(w):
        if not w:
            return 1.0
        return sum(p * brute(w[len(s) :]) for s, p in table.items() if w.startswith(s))

    words = [language_id.START + w for w in ("a", "ab", "aba", "abab", "bbaab")]
    assert np.allclose(np.exp(net.forward(words, prob)[:, 0]), [brute(w) for w in words])
    assert np.exp(net.forward([language_id.START + "q"], prob))[0, 0] == pytest.approx(0.5 * 1e-7)
    # Expected counts add up to the letters covered.
    counts = net.expected(words, np.ones(5), prob)
    assert sum(c * len(p) for c, p in zip(counts, net.pieces)) == pytest.approx(sum(map(len, words)))


def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.held_out_predictions(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert len(got) == docs.count() and (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()


def test_language_odd_texts(docs, empty):
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for row in fixture_rows():
        if not any(c.isalpha() for c in row[1] or ""):
            assert (got[row[0]]["lang_pred"], got[row[0]]["score"]) == ("und", 0.0)
        else:
            assert got[row[0]]["lang_pred"] in model[0]
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    kept = language_id.language_filter(docs)
    assert kept.columns == docs.columns and kept.count() > 50
    assert language_id.language_filter(empty).count() == 0


# 5: SimHash


def brute_fingerprint(text):
    w = [x.decode() for x in (text or "").encode().translate(simhash.LOWER).split()]
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    if not shingles:
        return 0
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(fps):
    """fps: (id, fingerprint) pairs -> id: least reachable id."""
    ids_ = [i for i, _ in fps]
    parent = {i: i for i in ids_}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 3:
                x, y = find(fps[a][0]), find(fps[b][0])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids_}


def test_simhash(docs):
    rows = ids(fixture_rows())
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows}
    want = brute_components(sorted(fps.items()))
    got = simhash.near_duplicates(docs.where("doc_id IS NOT NULL")).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_in_clusters(spark, limit):
    """Clusters of near fingerprints, also where every bucket counts as hot."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    f = base[rng.integers(0, 4, 300)]
    for _ in range(3):
        f = f ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    f = np.unique(np.concatenate((f, rng.integers(0, 2**63, 200, dtype=np.uint64), [np.uint64(0), np.uint64(7), ~np.uint64(0)])))
    rows = list(zip(f.view(np.int64).tolist(), range(len(f))))
    edges = simhash.link_edges(spark.createDataFrame(rows, "fp long, v long"), limit=limit)
    assert edges.count() <= 8 * len(f) * (1 if limit > 3 else 4)
    comp = {r["v"]: r["component"] for r in components.components(edges).collect()}
    want = brute_components(list(zip(range(len(f)), map(int, f))))
    assert {i: comp.get(i, i) for i in range(len(f))} == want


def test_gray_index_takes_whole_groups():
    f = np.array([0, 1, 2, 3, 4, 5, 6, 7], np.uint64)
    a, b = simhash.forest(f, np.zeros(8, np.int64))
    assert len(a) == 7


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_random(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["v"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges for v in e if find(v) != v}


# 7: substring dedup


def brute_removal(rows):
    first = {}
    for i, text, *_ in sorted(ids(rows), key=lambda r: r[0]):
        w = words_of(text)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    out = {}
    for i, text, *_ in rows:
        w = words_of(text)
        gone = np.zeros(len(w), bool)
        if i is not None:
            for j in range(len(w) - 12):
                if first[tuple(w[j : j + 13])] < i:
                    gone[j : j + 13] = True
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(docs, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    want = brute_removal(fixture_rows())
    got = substring_dedup.removal_report(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    assert sum(r["n_removed"] for r in got) > 300


@pytest.mark.parametrize("bits", [48, 0])
def test_passage_in_many_documents_stays_whole(spark, monkeypatch, bits):
    """Equal fragments of a common passage are not dealt by window: only its ends, where contexts
    differ, are, and the joined rows grow with the documents."""
    monkeypatch.setattr(substring_dedup, "HOT", 150)
    monkeypatch.setattr(substring_dedup, "HOT_BITS", bits)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(200)]
    def word():
        return "".join(rng.choices("abcdefgh", k=7))
    rows = [(i, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, occurrences = [], substring_dedup.occurrences

    def counted(*args):
        out = occurrences(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "occurrences", counted)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.removal_report(docs).collect()}
    assert got == {i: (240, 200 if i else 0) for i in range(200)}
    assert bits == 0 or max(made) < 200 * 100  # by windows: 188 in each document


def test_substring_dedup_with_a_full_bit_map(docs, monkeypatch):
    """With too many keys for the map every fragment goes on, and all windows count as hot; the
    result is the same."""
    monkeypatch.setattr(substring_dedup, "bit_map", lambda keys, n: b"\xff" * 1024)
    want = brute_removal(fixture_rows())
    got = substring_dedup.removal_report(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want


def test_substring_dedup_needs_its_index(monkeypatch):
    """Without the matching statistics of streamed fragments, repeats between shards are lost."""
    none = lambda self, text, *_: (text[:0], text[:0])
    frags = [" ".join(f"w{i}" for i in range(a, a + 20)).encode() for a in range(6)]
    lo = np.array([1, 2, 3, 4, 5, 6])
    odd, even = np.where(lo % 2, lo, substring_dedup.NEVER), np.where(lo % 2, substring_dedup.NEVER, lo)
    assert [x.tolist() for x in substring_dedup.least_owners(frags, (odd, even))] == [[max(1, i + j - 6) if i + j > 7 else 1 for j in range(8)] for i in range(6)]
    monkeypatch.setattr(substring_dedup.FMIndex, "matches", none)
    assert substring_dedup.least_owners(frags, (odd, even))[1].tolist() == [2] * 8


def test_substring_dedup_keeps_columns(docs, empty):
    out = substring_dedup.substring_dedup(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    want = brute_removal(fixture_rows())
    for i, text, *_ in fixture_rows():
        n, removed, sha = want[i]
        if removed == 0:
            assert texts[i] == text
        elif removed == n:
            assert i not in texts
        else:
            assert hashlib.sha256(texts[i].encode()).hexdigest() == sha
    assert substring_dedup.removal_report(empty).count() == 0


def test_fm_index_matches_external_text():
    """Streams that are not in the index: matches of three symbols against a plain search."""
    rng = random.Random(2)
    seqs = [[rng.randint(1, 4) for _ in range(rng.randint(1, 12))] for _ in range(20)]
    lens = np.array([len(s) for s in seqs])
    index = substring_dedup.FMIndex(np.array([x for s in seqs for x in s]), lens, np.arange(20) * 10, 3, 6)
    queries = [[rng.randint(1, 5) for _ in range(15)] for _ in range(30)]
    text = np.array([x for q in queries for x in q])
    at, lo = index.matches(text, np.arange(30) * 15, np.full(30, 15), 3)
    have = {}
    for k, s in enumerate(seqs):
        for i in range(len(s) - 2):
            have.setdefault(tuple(s[i : i + 3]), k * 10)
    want = {q * 15 + i: have[tuple(queries[q][i : i + 3])] for q in range(30) for i in range(13) if tuple(queries[q][i : i + 3]) in have}
    assert dict(zip(at.tolist(), index.least_owner(lo).tolist())) == want
    assert index.own.tolist() == [have[tuple(s[i : i + 3])] if i + 3 <= len(s) else substring_dedup.NEVER for s in seqs for i in range(len(s))]


def test_fm_index_sorts_to_its_depth_only(monkeypatch):
    """Sequences that agree in far more symbols than the depth take no more sorts."""
    rng = np.random.default_rng(8)
    long = rng.integers(1, 50, 4000)
    sorts, argsort = [], np.argsort

    def counted(*args, **kwargs):
        sorts.append(1)
        return argsort(*args, **kwargs)

    monkeypatch.setattr(np, "argsort", counted)
    index = substring_dedup.FMIndex(np.concatenate((long, long)), np.array([4000, 4000]), np.array([7, 3]), 13, 50)
    assert len(sorts) <= 3
    index.own = None
    at, lo = index.matches(long, np.array([0]), np.array([4000]), 13)
    assert sorted(at.tolist()) == list(range(4000 - 12)) and set(index.least_owner(lo).tolist()) == {3}


def test_fm_index_is_smaller_than_its_text():
    rng = np.random.default_rng(1)
    vocab = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10))) for _ in range(5000)])
    lens = np.full(6000, 20)
    seqs = rng.integers(1, 5001, 120_000)
    index = substring_dedup.FMIndex(seqs, lens, np.arange(6000), 13, 5001)
    index.own = None
    assert not any(isinstance(x, np.ndarray) and len(x) >= index.n for x in vars(index).values() if x is not index.least)
    assert index.nbytes < sum(len(w) + 1 for w in vocab[seqs - 1])


# 8: language model


def test_katz(docs, empty):
    from pyspark.sql import functions as F

    rows = fixture_rows()
    got = lm_scoring.katz_scores(docs, F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False)), block=500, orders=2).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and i % 10 == 0
    uni, bi, ctx, texts = collections.Counter(), collections.Counter(), collections.Counter(), []
    for i, text, *_ in rows:
        w = (text or "").encode().translate(lm_scoring.LOWER).split() + ["</s>"]
        texts.append((i, w))
        if not held(i):
            uni.update(w)
            for h, x in zip(["<s>"] + w, w):
                bi[h, x] += 1
                ctx[h] += 1
    n = sum(uni.values())

    def counts(c):
        out = np.zeros(7)
        for v in c.values():
            if v <= 6:
                out[v] += 1
        return out

    du, db = lm_scoring.good_turing(counts(uni)), lm_scoring.good_turing(counts(bi))
    cut = lambda d, c: d[c] if c <= 5 else 1.0
    seen = sum(cut(du, c) * c for c in uni.values()) / n
    whole = n if seen < 1 else n + 1
    rest = 1 - seen if seen < 1 else 1 / (n + 1)
    p1 = lambda w: cut(du, uni[w]) * uni[w] / whole if uni[w] else rest
    follow = collections.defaultdict(list)
    for (h, x), c in bi.items():
        follow[h].append((x, c))

    def p2(h, x):
        if h not in follow:
            return p1(x)
        some = any(c <= 5 and db[c] < 1 for _, c in follow[h])
        size = ctx[h] if some else ctx[h] + 1
        if bi.get((h, x)):
            return cut(db, bi[h, x]) * bi[h, x] / size
        left = 1 - sum(cut(db, c) * c for _, c in follow[h]) / size
        return left / (1 - sum(p1(y) for y, _ in follow[h])) * p1(x)

    assert sum(p2("<s>", x) for x in uni) + p2("<s>", "never seen") == pytest.approx(1)
    want = sorted(
        (str(i), len(w), sum(uni[x] > 0 for x in w), round(sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (len(uni) + 1))) for x in w), 6),
         round(sum(math.log10(p2(h, x)) for h, x in zip(["<s>"] + w, w)), 6))
        for i, w in texts
    )
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    assert lm_scoring.held_out_scores(empty).count() == 0


def test_katz_with_nothing_to_learn_from(docs):
    from pyspark.sql import functions as F

    got = lm_scoring.katz_scores(docs, F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["score"] == 0 for r in got) and len(got) == docs.count()


# 9: packing


def tokenizers_encoder():
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)


def odd_texts():
    rng = random.Random(9)
    out = ["", " ", "\n\n  x", "<|endoftext|> y", "don't WE'LL 1234 ½ ² ٣", "日本語テキスト🎉", "a b c\u0085d", "\x00\x01", "ǅ ʰ ՙ ߴ", "tab\tnew\r\nline  "]
    return out + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FF), rng.randint(0x370, 0x1FFF)])) for _ in range(50)) for _ in range(100)]


def test_fast_encoder_has_the_same_ids():
    slow, fast = tokenizers_encoder(), packing.tiktoken_encoder()
    for t in odd_texts() + [r[1] or "" for r in fixture_rows()]:
        assert slow(t).tolist() == fast(t).tolist(), repr(t)


def test_packing(docs, empty):
    encode = packing.tiktoken_encoder()
    got = packing.pack(docs, capacity=64, district=16).toPandas()
    want = collections.Counter()
    for i, text, *_ in fixture_rows():
        n = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
        cuts = [0] if len(n) % 64 else []
        cuts += list(range(len(n) % 64, len(n) + 1, 64))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[str(i), k, a, b - a, zlib.crc32(n[a:b].tobytes())] += 1
    have = collections.Counter((str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert have == want
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id")["length"].cumsum() - by["length"] == by["offset"]).all()
    assert by.groupby("sequence_id")["length"].sum().max() <= 64
    assert packing.pack(empty).count() == 0


def best_fit_decreasing(lengths, cap):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            i = min(fits, key=rooms.__getitem__)
            rooms[i] -= x
        else:
            rooms.append(cap - x)
    return len(rooms)


def holds_all(bins, lengths, cap):
    return sorted(i for _, b in bins for i in b) == list(range(len(lengths))) and all(f == sum(lengths[i] for i in b) <= cap for f, b in bins)


@pytest.mark.parametrize("seed", range(4))
def test_genetic_packing_is_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 40), rng.randint(20, 100)]) for _ in range(120)]
    p = packing.Packer(lengths, 100, seed)
    best = p.evolve([], 30)
    assert holds_all(best, lengths, 100)
    assert p.bound <= len(best) <= best_fit_decreasing(lengths, 100)
    child = p.cross(p.first(), p.first())
    assert holds_all(child, lengths, 100)


def test_genetic_packing_beats_best_fit():
    """Triplets that fill their bins, which best fit decreasing does not find."""
    rng = random.Random(3)
    lengths = []
    for _ in range(40):
        a = rng.randint(380, 490)
        b = rng.randint(251, (1000 - a) // 2 - 1)
        lengths += [a, b, 1000 - a - b]
    p = packing.Packer(lengths, 1000, 1)
    best = p.evolve([], 200)
    assert holds_all(best, lengths, 1000) and p.generations > 0
    assert len(best) < best_fit_decreasing(lengths, 1000)


def test_packing_evolves(spark):
    """On the documents of sf0.01: generations run, and at most two sequences a district over the bound."""
    pieces = packing.token_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("sequence_id IS NULL").toPandas()
    p = packing.Packer(pieces["length"].tolist(), packing.CAPACITY, 1)
    one = p.evolve([])
    two = p.evolve([one, p.evolve([])])
    assert p.generations > 0 and len(two) <= len(one)
    assert len(two) <= p.bound + 2


# 4: piece encoding


def test_piece_encoding_equals_the_library(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.default_model_path())
    e = piece_encoding.encoder(piece_encoding.default_model_path())
    texts = odd_texts() + [r[1] for r in fixture_rows()] + ["a" * 300, "  a   b ", "▁x▁▁y", "def f(x):\n    return x\n\n\n", "http://a.b/c?d=1&e=22222"]
    for t, got in zip(texts, e.encode(texts)):
        assert got.tolist() == sp.encode(t or ""), repr(t)
        assert e.v.decode(got.tolist()) == sp.decode(got.tolist())
    rows = piece_encoding.encode(docs).collect()
    assert len(rows) == docs.count() and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in rows)
    back = piece_encoding.decode(piece_encoding.encode(docs)).collect()
    assert sorted((r["text"] for r in back)) == sorted(r[1] or "" for r in fixture_rows())
    assert piece_encoding.encode(empty).count() == 0


def test_piece_encoding_finds_every_occurrence():
    v = piece_encoding.Vocabulary(piece_encoding.default_model_path())
    text = "▁the▁there▁other"
    start, size, piece = piece_encoding.SuffixMatcher(v).edges(np.array([ord(c) + 1 for c in text]))
    want = {(i, len(s), n) for n in v.plain for s in [v.strings[n]] for i in range(len(text)) if text.startswith(s, i)}
    assert set(zip(start.tolist(), size.tolist(), piece.tolist())) == want


# 1: HTML extraction


@pytest.fixture(scope="module")
def model():
    return html_extraction.train()


def test_held_out_pages(model):
    right = total = 0
    for page in html_extraction.labelled_pages(100, seed=99):
        good = model.marginals(page) > 0.5
        for owner, _ in page.blocks:
            right += good[owner] == (page.nodes[owner].label == 1)
            total += 1
    assert right / total > 0.97


def test_layouts_that_the_generator_has_not(model):
    f1, wrong = layouts.score(model.extract)
    assert f1 >= 0.97, wrong


def test_parsing_takes_linear_time():
    import time

    def took(n):
        began = time.perf_counter()
        page = html_extraction.parse("<div></b>" * n)
        assert len(page.nodes) == n + 1
        return time.perf_counter() - began

    took(1000)
    assert took(100_000) < 40 * took(10_000) + 1


def test_marginals_are_exact(model):
    """Against the sum over all labellings of a small tree."""
    page = html_extraction.parse("<body><nav><a href=x>one</a></nav><article><h1>Two</h1><p>Three, four. Five.</p></article></body>")
    nodes = page.nodes
    total, on = 0.0, np.zeros(len(nodes))
    for mask in range(1 << len(nodes)):
        y = [mask >> i & 1 for i in range(len(nodes))]
        logp = model.root[y[0]]
        for i, node in enumerate(nodes):
            logp += model.potential(node, page)[y[i]]
            if i:
                logp += model.edges.get(node.tag, model.edges["*"])[y[node.parent], y[i]]
        p = math.exp(logp)
        total += p
        on += p * np.array(y)
    assert np.allclose(model.marginals(page), on / total)


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One,\n two.<p>Three <b>bold</b>er. Four.</article><footer>&copy; x</footer>", "A & B\n\nOne, two.\n\nThree bolder. Four."),
        ("<article><p>Text one. It goes on.</p><script>var a='<p>no</p>';</script><!-- <p>no</p> --><style>p{}</style><p>Text two, here.</p></article>", "Text one. It goes on.\n\nText two, here."),
        ("<article><h1>T</h1><p>Never closed, but read to the end. Yes", "T\n\nNever closed, but read to the end. Yes"),
        ("<p title=\"a>b\">Quoted attribute, fine. Good.</p>", "Quoted attribute, fine. Good."),
    ],
)
def test_extraction(model, source, text):
    assert model.extract(source) == text


def test_extraction_of_pages(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in html_extraction.extract_text(pages).collect()}
    assert len(got) == pages.count()
    for row in pages.collect():
        inner = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[row["page_id"]]["text"] == want and got[row["page_id"]]["n_chars"] == len(want)


def test_extraction_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (3, "u", "<" * 2000), (4, "u", "<div " * 3000), (5, "u", "<div>" * 3000 + "deep text. Yes, deep."), (6, "u", "plain words only, no tags. Fine.")]
    got = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 7 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extraction.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
