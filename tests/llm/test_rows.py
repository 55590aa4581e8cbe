"""What filters keep is decided row by row; null ids, repeated ids and clashing names lose nothing."""

from __future__ import annotations

import collections
import math
import random

import pytest

from stratalog.llm import exact_dedup, language_id, quality_rules, simhash, substring_dedup

from .test_operators import brute_metrics, fixture_rows


def test_exact_dedup_keeps_the_only_copy_of_a_repeated_id(spark):
    rows = [(3, "A a"), (5, "A a"), (5, "only copy of B"), (None, "A  a"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, exact_dedup.exact_dedup(docs).collect())) == sorted(
        f"Row(doc_id={i}, text={t!r})" for i, t in [(3, "A a"), (5, "only copy of B"), (None, "no id")]
    )


def test_null_ids_link_others(spark, monkeypatch):
    """1 - null - 2 at three bits each are one component."""
    prints = {"a": 0, "b": 7, "c": 63}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.selectExpr("doc_id", "CASE text WHEN 'a' THEN 0L WHEN 'b' THEN 7L ELSE 63L END AS fp"))
    docs = spark.createDataFrame([(2, "a"), (None, "b"), (1, "c")], "doc_id long, text string")
    got = {r["fingerprint"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == {f"{f:016x}": 1 for f in prints.values()}


def test_substring_dedup_with_its_own_column_names(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage, "x", 5, "y"), (2, "tail " + passage, "x", 6, "y")], "doc_id long, text string, _marks string, _marked_id long, _marked_text string")
    out = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert out[2]["text"] == "tail" and out[1]["text"] == passage and out[2]["_marked_id"] == 6


# Quality rules: the verdict by a plain model.


def brute_kept(rows):
    """rows: id, text, lang, source -> verdicts, in order."""
    shift = math.ceil(40 * math.log(2) / math.log(1.01))
    number = lambda x: 0 if x <= 0 else max(1, math.ceil(math.log(x) / math.log(1.01)) + shift)
    value = lambda b: 0.0 if b == 0 else 1.01 ** (b - shift) * (2 / 2.01)
    data = []
    for _, text, lang, source, *_ in rows:
        n, chars, symbols, dup, repeat = brute_metrics(text)
        w = (text or "").encode().split()
        t = text or ""
        upper = sum(__import__("unicodedata").category(c) == "Lu" for c in t)
        lines = [x for x in t.split("\n") if x.encode().split()]
        stutter = sum(a == b for a, b in zip(w, w[1:]))
        per = lambda a, b: a / max(b, 1)
        m = {"symbol_ratio": per(symbols, chars), "upper_ratio": per(upper, chars), "dup_line_ratio": per(dup, len(lines)), "repeat_ratio": per(repeat, n),
             "stutter_ratio": per(stutter, n), "mean_word_chars": per(chars, n)}
        data.append((lang, source, m, n < 20 or 100 * repeat > 30 * n))

    def quartiles(some, metric):
        bins = sorted(number(m[metric]) for *_, m, _ in some)
        return len(bins), [value(bins[-(-len(bins) * p // 100) - 1]) for p in (25, 50, 75)]

    groups = collections.defaultdict(list)
    for d in data:
        groups[d[0], d[1]].append(d)
    fences = {}
    for (lang, source), own in groups.items():
        for metric, (spread, low) in quality_rules.METRICS.items():
            _, a = quartiles(data, metric)
            ln, b = quartiles([d for d in data if d[0] == lang], metric)
            gn, c = quartiles(own, metric)
            q = [(gn * x + 50 * (ln * y + 50 * z) / (ln + 50)) / (gn + 50) for x, y, z in zip(c, b, a)]
            width = 3 * max(q[2] - q[1], q[1] - q[0], spread)
            fences[lang, source, metric] = (q[1] - width if low else -math.inf, q[1] + width)
    return [not failed and all(fences[lang, source, k][0] <= x <= fences[lang, source, k][1] for k, x in m.items()) for lang, source, m, failed in data]


def test_quality_verdicts_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()), key=lambda r: r[0])
    want = dict(zip((r[0] for r in rows), brute_kept(rows)))
    assert {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(docs).collect()} == want
    assert 0 < sum(want.values()) < len(want)
    assert {r["doc_id"] for r in quality_rules.quality_filter(docs).collect()} == {i for i, k in want.items() if k}


def test_fences_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality_rules._ratios(quality_rules.base_metrics(docs))
    one, two = (sorted(map(str, quality_rules.adaptive_thresholds(r).collect())) for r in (rows.coalesce(1), rows.repartition(13, "doc_id")))
    assert one == two


def test_quality_filter_drops_rows_not_ids(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["stone", "river", "light", "wind"]) + str(rng.randint(0, 99)) for _ in range(60))
    a, b = good(), good()
    rows = [(i, good(), "en", "s") for i in range(30)] + [(100, a, "en", "s"), (100, "short", "en", "s"), (None, "short", "en", None), (None, b, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, [r for r in docs.collect() if r["text"] != "short"]))


# Language identification: words of any length.


def test_forward_of_long_words(monkeypatch):
    monkeypatch.setattr(language_id, "LONG", 60)
    monkeypatch.setattr(language_id, "LETTERS", 130)
    net = language_id.Lattice(["a", "b", "ab", "ba", "aba", "babab", language_id.START])
    import numpy as np

    prob = np.random.default_rng(0).random((8, 2)) * 1e-3
    table = {p: i for i, p in enumerate(net.pieces)}
    rng = random.Random(1)
    words = [language_id.START + "".join(rng.choice("abq") for _ in range(n)) for n in (1, 24, 25, 48, 59, 60, 130, 400, 700)]
    for word, got in zip(words, net.forward(words, prob)):
        out = [np.zeros(2)]
        for end in range(1, len(word) + 1):
            parts = [out[end - k] + np.log(prob[table[word[end - k : end]]]) for k in range(1, min(5, end) + 1) if word[end - k : end] in table]
            out.append(np.logaddexp.reduce(parts or [out[end - 1] + np.log(prob[-1])], axis=0))
        assert got == pytest.approx(out[-1])


def test_many_languages(spark):
    """As many languages as are labelled, and every piece made of letters."""
    rng = random.Random(2)
    rows = [(k, " ".join("".join(rng.choices(chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k), k=3)) for _ in range(20)), f"l{k:03}", "s", 1) for k in range(230)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert len(model[0]) == 230
    assert max(map(len, language_id.vocabulary())) == language_id.lattice().longest > 12


def test_fixture_is_awkward():
    assert any(r[0] is None for r in fixture_rows())
