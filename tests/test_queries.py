"""Every query with a SQL twin gives DuckDB's rows; the others run."""

import pytest

from stratalog.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_commit_rule_control_differs(spark, sf_dir):
    """The wrong commit rule is caught: it commits an entry of an old term."""
    right = catalog.QUERIES["commit_index"](spark, sf_dir).first()[0]
    wrong = catalog.QUERIES["commit_index_naive_rule"](spark, sf_dir).first()[0]
    assert wrong >= right


def test_linearizable_histories_are_ok(spark, sf_dir):
    rows = catalog.QUERIES["linearizable_per_key"](spark, sf_dir).toPandas()
    assert (rows["verdict"] == "ok").all()
