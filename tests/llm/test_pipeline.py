"""The pipeline, stage by stage, against brute force; and the registered queries."""

import re

import pytest

import corpus_pipeline
from stratalog.llm import language_id, queries

from .test_near_dedup import brute_kept
from .test_operators import brute_removal, words_of


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    model = language_id.train(docs)
    pred = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    one = stages["language_id"](spark, docs, sf_dir)
    assert one.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if pred[r["doc_id"]]["lang_pred"] != "und" and pred[r["doc_id"]]["score"] >= 0.5}
    assert {r["doc_id"] for r in one.collect()} == set(texts)
    two = stages["exact_dedup"](spark, one, sf_dir)
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(first.values())
    three = stages["simhash_near_dedup"](spark, two, sf_dir)
    left = brute_kept([(i, texts[i]) for i in sorted(first.values())])
    assert sorted(r["doc_id"] for r in three.collect()) == left
    four = stages["substring_dedup"](spark, three, sf_dir)
    want = brute_removal([(i, texts[i]) for i in left])
    rows = four.collect()
    assert four.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert {r["doc_id"]: len(words_of(r["text"])) for r in rows} == {i: n - k for i, (n, k, _) in want.items() if n - k or not n}
    five = stages["best_fit_packing"](spark, four, sf_dir)
    assert {r["doc_id"] for r in five.collect()} == {r["doc_id"] for r in rows}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name])


def test_registered():
    import __spark_entry__ as entry

    have = entry.queries()
    assert "pipeline" in have and sum(n.startswith("op") and n[2].isdigit() for n in have) == 10
