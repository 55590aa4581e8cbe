"""The event-by-event search against all orders, and on histories longer than any step limit."""

import random

import pandas as pd
import pytest

from stratalog.operators import history
from stratalog.plans import catalog, linearizability
from stratalog.plans.linearizability import linearizable

NAMES = ["id", "op", "in_value", "out_value", "found", "ok", "unknown", "invoke", "ret"]


def all_orders(rows):
    """Wing and Gong without any short cut."""
    must = {r[0] for r in rows if r[8] is not None and not r[6]}
    seen = set()

    def go(done, state):
        if must <= done:
            return True
        if (done, state) in seen:
            return False
        seen.add((done, state))
        limit = min(r[8] for r in rows if r[0] in must - done)
        for i, op, value, out, found, _, _, invoke, _ in rows:
            if i in done or invoke > limit:
                continue
            if op == "GET":
                if i not in must or (found, out) == state:
                    if go(done | {i}, state):
                        return True
            elif go(done | {i}, (True, value) if op == "PUT" else (False, None)):
                return True
        return False

    return "ok" if go(frozenset(), (False, None)) else "illegal"


@pytest.mark.parametrize("prune_above", [0, 16])
def test_search_equals_all_orders(monkeypatch, prune_above):
    monkeypatch.setattr(linearizability, "PRUNE_ABOVE", prune_above)
    rng = random.Random(11)
    verdicts = []
    for _ in range(1500):
        rows, width = [], rng.choice([3, 8, 20])
        for i in range(rng.randint(1, 9)):
            invoke = rng.randint(0, 20)
            ret = None if rng.random() < 0.15 else invoke + rng.randint(0, width)
            op = rng.choice(["PUT", "PUT", "DELETE", "GET", "GET", "GET"])
            value = rng.choice("abc")
            found = op == "GET" and rng.random() < 0.75
            rows.append((i, op, value if op == "PUT" else None, value if found else None, found, True, rng.random() < 0.1, invoke, ret))
        want = all_orders(rows)
        verdicts.append(want)
        assert linearizable(pd.DataFrame(rows, columns=NAMES).astype({"ret": object}), None) == want, rows
    assert min(verdicts.count("ok"), verdicts.count("illegal")) > 150


@pytest.mark.parametrize("stale", [False, True])
def test_hot_key_is_decided(spark, stale):
    """One key with more operations than the former limit of 200,000 steps."""
    n = 210_000
    ops = spark.range(n).selectExpr(
        "id", "if(id % 2 = 0, 'PUT', 'GET') AS op", "'k' AS key", "if(id % 2 = 0, double(id), null) AS in_value",
        f"if(id % 2 = 1, double(if({str(stale).lower()} AND id = {n - 1}, id - 3, id - 1)), null) AS out_value", "id % 2 = 1 AS found",
        "true AS ok", "false AS unknown", "id * 10 AS invoke", "id * 10 + 5 AS ret",
    )
    rows = history.linearizable_per_key(ops).collect()
    assert [tuple(r) for r in rows] == [("k", n, "illegal" if stale else "ok")]


def test_query_has_real_intervals(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(history, "linearizable_per_key", lambda ops: seen.append(ops) or ops)
    catalog.QUERIES["linearizable_per_key"](spark, sf_dir)
    assert seen[0].where("ret IS NULL").count() > 0 and seen[0].where("ret > invoke + 1").count() > 0


def crowd(n, clients, seed=5):
    """Operations that take effect at their call and last until their client's next: many in flight,
    few of them where it matters."""
    rng = random.Random(seed)
    rows, state, ends = [], (False, None), {}
    for i in reversed(range(n)):
        client = rng.randrange(clients)
        rows.append([i, rng.choice(["PUT", "PUT", "DELETE", "GET", "GET"]), None, None, False, True, False, i * 10, ends.get(client)])
        ends[client] = i * 10 - 1
    rows.reverse()
    for r in rows:
        if r[1] == "GET":
            r[4], r[3] = state
        else:
            r[2] = float(rng.randrange(n // 3)) if r[1] == "PUT" else None
            state = (r[1] == "PUT", r[2])
    return rows


@pytest.mark.parametrize("stale", [False, True])
def test_crowded_history_takes_few_steps(monkeypatch, stale):
    """Work follows what is still open between the configurations, not the operations in flight."""
    rows = crowd(4000, 400)
    if stale:  # the last read that returned saw a value that is never written
        last = max(i for i, r in enumerate(rows) if r[1] == "GET" and r[8] is not None)
        rows[last][3:5] = [-1.0, True]
    made = []
    monkeypatch.setattr(linearizability, "Search", lambda n, f=linearizability.Search: made.append(f(n)) or made[-1])
    pdf = pd.DataFrame(rows, columns=NAMES).astype({"ret": object})
    assert linearizable(pdf, None) == ("illegal" if stale else "ok")
    assert made[0].steps < 100 * len(rows)


def test_repeated_ids(spark):
    """An operation called again before its return is illegal; without outcome, it is another one."""
    row = lambda i, ret, unknown=False: (i, "PUT", 1.0, None, False, True, unknown, 0, ret)
    of = lambda rows: linearizable(pd.DataFrame(rows, columns=NAMES).astype({"ret": object}))
    assert of([row(1, 5), row(1, 6)]) == "illegal"
    assert of([row(1, None), row(1, 6), row(1, None)]) == "ok"


def test_reach_equals_model(spark):
    """What Spark's windows find of later reads and writes is what plain Python finds."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        op, v, invoke = rng.choice(["PUT", "DELETE", "GET", "GET"]), rng.choice([0.0, 1.0, 2.0, float("nan"), None]), rng.randint(0, 200)
        found = op == "GET" and rng.random() < 0.7
        rows.append((i, op, f"k{i % 3}", v if op == "PUT" else None, v if found else None, found, True, rng.random() < 0.1, invoke, None if rng.random() < 0.1 else invoke + rng.randint(0, 30)))
    df = spark.createDataFrame(rows, "id long, op string, key string, in_value double, out_value double, found boolean, ok boolean, unknown boolean, invoke long, ret long")
    got = {r["id"]: (r["until"], r["again"]) for r in history._reach(df.withColumn("unknown", df.unknown | df.ret.isNull()), 7).collect()}
    assert len(got) == len(rows)
    for k in ("k0", "k1", "k2"):
        calls = []
        for i, op, key, a, b, found, _, unknown, invoke, ret in rows:
            if key == k:
                value = a if op == "PUT" else b if found else None
                calls.append((invoke, i, (op == "PUT" or found, None if value is None or value != value else value), op == "GET", not unknown and ret is not None, ret))
        for call, (until, again) in zip(calls, linearizability.reach(calls)):
            if not call[3]:
                assert got[call[1]][0] == until
            elif call[4]:
                assert got[call[1]][1] == again
