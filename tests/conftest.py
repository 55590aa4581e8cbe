from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def canonical(pdf):
    """Rows as sorted tuples of text, columns by name."""

    def one(v):
        if v is None or v != v:
            return None
        return repr(float(v)) if isinstance(v, float) else str(v)

    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(map(one, r)) for r in pdf.itertuples(index=False)), key=str), sorted(pdf.columns)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, sf_dir):
    def check(query, sql):
        import pandas as pd

        got = query(spark, sf_dir).toPandas()
        want = duck.execute(sql).df()
        # Integer columns with nulls come as floats from one side or the other.
        for frame in (got, want):
            for c in frame.columns:
                if pd.api.types.is_float_dtype(frame[c]) and (frame[c].dropna() % 1 == 0).all():
                    frame[c] = frame[c].astype("float64")
                elif pd.api.types.is_integer_dtype(frame[c]):
                    frame[c] = frame[c].astype("float64")
        a, b = canonical(got), canonical(want)
        assert a[1] == b[1]
        assert a[0] == b[0]

    return check
