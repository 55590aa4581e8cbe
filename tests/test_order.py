"""Values of later rows: against plain Python, and without frames that Spark computes anew per row."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.operators import faults, log
from stratalog.operators.order import least_later

LAST = (1, 0)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


@pytest.mark.parametrize("levels", [0, 1, 2, 3])
def test_least_later(spark, levels):
    rng = random.Random(levels)
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.1 else rng.randint(-50, 50), i, None if rng.random() < 0.3 else rng.randint(0, 99)) for i in range(400)]
    df = spark.createDataFrame(rows, "t string, at long, ord long, v long")
    got = {r["ord"]: r["later"] for r in least_later(df, ["t"], F.floor(F.col("at") / 3), ["at", "ord"], "v", "later", 4, levels).collect()}
    place = lambda r: (LAST if r[1] is None else (0, r[1]), r[2])
    want = {r[2]: min((x[3] for x in rows if x[0] == r[0] and place(x) > place(r) and x[3] is not None), default=None) for r in rows}
    assert got == want


def test_open_intervals_without_time_or_target(spark):
    """Nulls last, as in SQL; no frame up to the end, which is quadratic in a target's events."""
    rows = [(1, 10, 0, True), (1, None, 1, True), (1, 2_000_000_000, 2, False), (1, None, 3, False), (None, 5, 4, True), (None, 6, 5, False), (2, 7, 6, True)]
    got = faults.open_intervals(spark.createDataFrame(rows, "target long, at long, ord long, opens boolean"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 10, 2_000_000_000), (1, None, None), (None, 5, 6), (2, 7, None)], key=str)
    assert "unboundedfollowing" not in _plan(got)


def test_wal_survivors_of_many_segments(spark):
    """A cut reaches back over thousands of segments; no frame up to the end, over segments or in one."""
    wal = spark.range(9000).selectExpr(
        "cast(id as int) AS segment", "id AS ord", "if(id IN (4500, 8998), 'truncate', 'entries') AS kind", "if(id = 8998, 3L, if(id = 4500, 1L, id)) AS from_index",
        "if(id IN (4500, 8998), null, array(named_struct('index', id, 'term', 0L))) AS entries",
    )
    got = log.wal_survivors(wal)
    assert sorted(r["index"] for r in got.collect()) == [0, 8999]
    assert "unboundedfollowing" not in _plan(got)
