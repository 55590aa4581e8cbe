"""Operators against plain Python models, on random input."""

import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stratalog.functions import hashing
from stratalog.operators import benchmarks, consensus, faults, history, log, runs, state
from stratalog.plans.linearizability import linearizable
from stratalog.plans.store import RunStore
from stratalog.sources import binary_log, documents, schemas

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
VERSIONS = "key string, seq long, value double, tombstone boolean"
version = st.tuples(st.sampled_from("abcdef"), st.integers(1, 40), st.floats(0, 9, width=16), st.booleans())


def distinct(rows):
    """One payload for each (key, seq)."""
    return [(k, s, None if t else v, t) for (k, s), (v, t) in {(k, s): (v, t) for k, s, v, t in rows}.items()]


def model(rows):
    out = {}
    for k, s, v, t in sorted(rows, key=lambda r: r[1]):
        out[k] = (s, v, t)
    return {k: v for k, (s, v, t) in out.items() if not t}


@FEW
@given(st.lists(version, min_size=1, max_size=40))
def test_latest_state_is_a_dict(spark, rows):
    rows = distinct(rows)
    random.shuffle(rows)
    got = {r["key"]: r["value"] for r in state.read_view(spark.createDataFrame(rows, VERSIONS)).collect()}
    assert got == model(rows)


@FEW
@given(st.lists(version, min_size=1, max_size=40))
def test_store_reads_do_not_change_by_compaction(spark, tmp_path_factory, rows):
    rows = distinct(rows)
    df = spark.createDataFrame(rows, VERSIONS)
    store = RunStore(spark, str(tmp_path_factory.mktemp("store")))
    for through in (8, 16, 24, 32, 40):
        store.flush(df, through)
    before = {r["key"]: r["value"] for r in store.read().collect()}
    files = store.live().count()
    rounds = store.compact()
    assert before == {r["key"]: r["value"] for r in store.read().collect()} == model(rows)
    assert (rounds > 0) == (files >= 4)
    again = RunStore(spark, store.path)
    assert again.live().count() == store.live().count() and again.flushed_index() == store.flushed_index() == 40
    assert len(store.vacuum()) >= 4 * rounds and store.vacuum() == []
    for key in "abc":
        assert [r["value"] for r in store.read(key).collect()] == ([model(rows)[key]] if key in model(rows) else [])
    with pytest.raises(ValueError):
        store.flush(df, 3)


def test_dropping_tombstones_in_a_merge_would_resurrect(spark):
    """Negative control: why merges keep tombstones."""
    old, new = [("a", 1, 1.0, False)], [("a", 5, None, True)]
    merged = runs.merge_runs(spark.createDataFrame(new, VERSIONS))
    assert state.read_view(merged.unionByName(spark.createDataFrame(old, VERSIONS))).count() == 0
    wrong = merged.where("NOT tombstone").unionByName(spark.createDataFrame(old, VERSIONS))
    assert state.read_view(wrong).count() == 1


@FEW
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 9)), min_size=1, max_size=30))
def test_dedup_is_a_session_table(spark, cmds):
    rows = [(i, c, s) for i, (c, s) in enumerate(cmds)]
    got = {r["idx"]: r["duplicate"] for r in log.dedup_flags(spark.createDataFrame(rows, "idx long, client_id long, seq long")).collect()}
    last, want = {}, {}
    for i, c, s in rows:
        want[i] = s <= last.get(c, 0)
        if not want[i]:
            last[c] = s
    assert got == want


@FEW
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 6), st.integers(1, 3)), min_size=1, max_size=25))
def test_wal_replay(spark, records):
    """Truncations and overlapping records against a list."""
    live, rows, top = [], [], 0
    for o, (cut, back, n) in enumerate(records):
        at = max(0, top - back) + 1
        live = [e for e in live if e[0] < at]
        entries = [] if cut else [(at + i, o) for i in range(n)]
        live += entries
        top = live[-1][0] if live else 0
        rows.append((o // 4, o, "truncate" if cut else "entries", at, None if cut else entries))
    df = spark.createDataFrame(rows, "segment int, ord long, kind string, from_index long, entries array<struct<index:long,term:long>>")
    assert sorted((r["index"], r["term"]) for r in log.wal_survivors(df).collect()) == live


@FEW
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(5, 40)), min_size=1, max_size=40))
def test_flush_generations(spark, rows):
    df = spark.createDataFrame([(0, i, k, b) for i, (k, b) in enumerate(rows)], "shard long, ord long, key long, bytes long")
    got = [r["generation"] for r in runs.flush_generations(df, 100).orderBy("ord").collect()]
    assert got == list(runs.reference_flush(rows, 100))


def test_data_blocks_keep_keys_together(spark):
    rows = [("f", i, i // 5, 30) for i in range(40)]
    blocks = runs.data_blocks(spark.createDataFrame(rows, "file string, pos long, key long, bytes long"), 100)
    joined = blocks.join(spark.createDataFrame(rows, "file string, pos long, key long, bytes long"), ["file", "pos"])
    assert runs.block_violations(joined).count() == 0
    assert blocks.select("block").distinct().count() == 8


def test_size_class_boundaries(spark):
    sizes = [0, 4095, 4096, 16383, 16384, 65535, 65536, (1 << 62) - 1, 1 << 62]
    want = [0, 0, 1, 1, 2, 2, 3, 25, 26]
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(runs.size_class(F.col("s"))).collect()]
    assert got == want


def ops(rows):
    names = ["id", "op", "in_value", "out_value", "found", "ok", "unknown", "invoke", "ret"]
    return pd.DataFrame(rows, columns=names)


@pytest.mark.parametrize(
    "rows, verdict",
    [
        ([(1, "PUT", "x", None, False, True, False, 0, 1), (2, "GET", None, "x", True, True, False, 2, 3)], "ok"),
        ([(1, "PUT", "x", None, False, True, False, 0, 1), (2, "GET", None, None, False, True, False, 2, 3)], "illegal"),
        ([(1, "PUT", "x", None, False, True, False, 0, None), (2, "GET", None, None, False, True, False, 2, 3)], "ok"),
        ([(1, "PUT", "x", None, False, True, False, 0, None), (2, "GET", None, "x", True, True, False, 2, 3)], "ok"),
        ([(1, "DELETE", None, None, False, True, False, 0, None), (2, "GET", None, None, False, True, False, 2, 3)], "ok"),
        ([(1, "PUT", "x", None, False, False, False, 0, 1)], "illegal"),
        ([(1, "GET", None, "", True, True, False, 0, 1)], "illegal"),
        ([(1, "PUT", "", None, False, True, False, 0, 1), (2, "GET", None, "", True, True, False, 2, 3)], "ok"),
    ],
)
def test_linearizability(rows, verdict):
    assert linearizable(ops(rows), 10_000) == verdict


def test_linearizability_gives_up_visibly():
    rows = [(i, "PUT", str(i), None, False, True, False, 0, 100) for i in range(12)] + [(99, "GET", None, "none", True, True, False, 1, 100)]
    assert linearizable(ops(rows), 50) == "unchecked"


def test_checksums():
    assert hashing.crc32c_bytes(b"123456789") == 0xE3069283
    assert int(hashing.fnv_vector(pd.Series([b"a"]), hashing.FNV_OFFSET)[0]) == 0xAF63DC4C8601EC8C


def test_bloom_filter(spark):
    keys = [(0, f"key-{i}".encode()) for i in range(500)]
    data = bytes(hashing.bloom_filters(spark.createDataFrame(keys, "g int, k binary"), "g", "k").first()["filter"])
    assert all(hashing.contains(data, k) for _, k in keys)
    false = sum(hashing.contains(data, f"no-{i}".encode()) for i in range(2000))
    assert false < 60
    with pytest.raises(ValueError):
        hashing.contains(data[:-1], b"x")


def test_binary_log_round_trip_and_torn_tail(spark, tmp_path):
    payloads = [b"", b"\xfa\xfb", bytes(range(256))]
    whole = b"".join(map(binary_log.frame, payloads))
    (tmp_path / "segment-1.wal").write_bytes(whole)
    (tmp_path / "segment-2.wal").write_bytes(whole[:-5])
    rows = binary_log.read_segments(spark, str(tmp_path)).orderBy("segment", "ord").collect()
    assert [bytes(r["payload"]) for r in rows if r["payload"] is not None] == [*payloads, *payloads[:2]]
    torn = log.torn_tail(spark.createDataFrame([(r["segment"], r["ord"], r["terminated"]) for r in rows], "segment int, ord long, terminated boolean")).collect()
    assert [(r["segment"], r["verdict"]) for r in torn] == [(2, "drop")]


@pytest.mark.parametrize("at", range(0, 20, 3))
def test_corrupt_byte_is_seen(at):
    data = bytearray(binary_log.frame(b"abcdef"))
    data[1 + at] ^= 1
    assert [p for _, p, _ in binary_log.frames(bytes(data))] != [b"abcdef"]


def test_strict_documents(spark):
    good = '{"trial":1,"seed":1,"flush_threshold_bytes":65536,"operations":2000,"elapsed_ns":5}'
    rows = documents.strict_rows(spark.createDataFrame([(good,)], "text string"), "write_throughput")
    assert rows.first()["operations"] == 2000
    for bad in (good.replace("}", ',"extra":1}'), good[:-1]):
        with pytest.raises(Exception):
            documents.strict_rows(spark.createDataFrame([(bad,)], "text string"), "write_throughput").collect()


BAD_SCHEDULE = """{"Version":3,"Crashes":[{"Node":1,"Save":0,"Point":1,"RetainUnsynced":-1},{"Node":2,"Save":4,"Point":9,"RetainUnsynced":-2},{"Node":2,"Save":4,"Point":1,"RetainUnsynced":0}],
"Events":[{"Time":-1,"Kind":1,"Rate":0.5},{"Time":1,"Kind":1,"Rate":1.5},{"Time":2,"Kind":9,"Node":1,"Multiplier":3.0},{"Time":3,"Kind":3,"From":2,"To":2},{"Time":4,"Kind":5,"Groups":[[1,2],[2]]},
{"Time":5,"Kind":5,"Groups":[[1]]},{"Time":6,"Kind":77},{"Time":7,"Kind":7,"Node":9},{"Time":8,"Kind":6,"Groups":[[1],[]]}],"LSMCrashes":[{"Node":1,"Op":"","Occurrence":0,"Point":1,"RetainUnsynced":0}]}"""


def test_schedule_round_trip(spark):
    s = documents.decode_schedules(spark.createDataFrame([(1, BAD_SCHEDULE)], "seed long, text string"))
    again = documents.decode_schedules(documents.encode_schedules(s))
    assert s.collect() == again.collect()


def test_generated_schedules_are_valid_and_reproducible(spark):
    a = faults.generate_schedules(spark, 20, tasks=1).orderBy("seed", "ordinal").collect()
    assert a == faults.generate_schedules(spark, 20, tasks=4).orderBy("seed", "ordinal").collect()
    for seed in range(20):
        pairs, opened = [r for r in a if r["seed"] == seed and r["kind"] in ("partition", "heal", "pause", "resume", "partition-groups", "heal-groups")], 0
        for r in pairs:
            opened += 1 if r["kind"] in ("partition", "pause", "partition-groups") else -1
            assert opened in (0, 1)


def test_profile_rows():
    assert sum(benchmarks.REPORT.expected_rows().values()) == 130


def test_point_read_rules(spark):
    row = (1, 1, 1, True, "hit", 1000, 9000, 1, 2, 3, 4, 1000, 0, 5, 5)
    broken = (1, 1, 1, True, "miss", 1000, 3, 5, 2, 3, 4, 10, 900, 0, 0)
    found = benchmarks.point_read_violations(spark.createDataFrame([row, broken], schemas.POINT_READ_ROW), benchmarks.SMOKE).collect()
    rules = {(r["cell"], r["rule"]) for r in found}
    assert ("1/1/true/miss", "quantiles") in rules and ("1/1/true/miss", "counts") in rules and ("1/1/true/miss", "elapsed below max") in rules
    assert not any(c == "1/1/true/hit" for c, _ in rules) and sum(r == "missing cell" for _, r in rules) == 6


def test_old_term_is_not_committed(spark):
    entries = spark.createDataFrame([(1, 1), (2, 1)], "idx long, term long")
    match = spark.createDataFrame([(n, 2) for n in range(3)] + [(3, 0), (4, 0)], "node long, match_index long")
    assert consensus.commit_index(entries, match, 5, 2).first()[0] == 0
    assert consensus.commit_index(entries, match, 5, 2, any_term=True).first()[0] == 2
    assert consensus.commit_index(entries, match, 5, 1).first()[0] == 2


def test_interval_bounds_differ(spark):
    """A fault at an operation's start doesn't catch it; a client is in flight then."""
    f = spark.createDataFrame([(1, 10)], "fault_id long, at long")
    o = spark.createDataFrame([(7, 10, 20)], "client_id long, invoke long, ret long")
    assert history.faults_in_flight(f, o).first()["clients"] == 0
    assert history.faults_in_flight(f, o, strict_start=False).first()["clients"] == 1


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], VERSIONS)
    assert state.read_view(empty).count() == 0
    assert state.applied_index(spark.createDataFrame([], "idx long")).first()[0] == 0
    assert tuple(log.first_last(spark.createDataFrame([], "idx long")).first()) == (1, 0)
    assert runs.pick_compaction(spark.createDataFrame([], "file string, tier int")).count() == 0
    assert history.max_concurrency(spark.createDataFrame([], "invoke long, ret long")).first()[0] == 0


def test_stream_sessions(spark, tmp_path):
    from stratalog.streaming import sessions

    rows = [(1, 1, "start", 0, 0), (1, 2, "deadline", 0, 9), (1, 3, "deadline", 0, 1), (1, 4, "retry", 0, 0), (1, 5, "applied", 1, 0), (1, 6, "applied", 1, 0)]
    spark.createDataFrame(rows, sessions.SESSION_EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.command_stream(spark, str(tmp_path / "in"), sessions.SESSION_EVENT)
    out = sessions.run_to_files(spark, sessions.session_automaton(stream), str(tmp_path / "out"), "append", str(tmp_path / "cp"))
    assert [r["action"] for r in out.orderBy("ord").collect()] == ["submit", "ignored", "schedule-retry", "submit", "complete", "ignored"]


def test_stream_into_store(spark, tmp_path, sf_dir):
    from stratalog.plans import catalog
    from stratalog.streaming import sessions

    store = RunStore(spark, str(tmp_path / "store"))
    path = catalog._stream_input(spark, sf_dir)
    sessions.apply_batches(sessions.command_stream(spark, path), store, str(tmp_path / "cp")).awaitTermination()
    want = {str(r["key"]): r["value"] for r in catalog.QUERIES["kv_latest_state"](spark, sf_dir).collect()}
    assert {r["key"]: r["value"] for r in store.read().collect()} == want


def test_plans_push_filters_and_prune_columns(spark, sf_dir):
    from stratalog.sources import commands

    plan = commands.table(spark, sf_dir, "lineitem").where("l_orderkey = 7").select("l_orderkey", "l_partkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,7)" in text and "l_comment" not in text and "struct<l_orderkey:bigint,l_partkey:bigint>" in text


def test_campaign_catches_broken_reads(spark):
    """Negative control: reads that miss the last write are not linearizable."""
    from stratalog.plans import campaign

    assert campaign.summaries(spark, 4).where("bad_keys > 0").count() == 0
    assert campaign.summaries(spark, 4, break_reads=True).where("bad_keys > 0").count() == 4


def test_charts(spark):
    from stratalog.plans import charts

    rows = [(1, "a", 2.0), (2, "a", 3.0), (1, "b", 5.0), (2, "b", 1.0)]
    draw = lambda r: charts.chart(spark.createDataFrame(r, "x int, s string, v double"), "x", "v", "s", "A & B")
    assert draw(rows) == draw(rows[::-1]) and "A &amp; B" in draw(rows) and draw(rows).count("<polyline") == 2
    assert charts.bounds([]) == charts.bounds([float("nan")]) == (0.0, 1.0) and charts.bounds([0.0]) == (0.0, 1.0)


def test_command_line(capsys):
    from stratalog.__main__ import main, parser

    assert main(["list"]) == 0 and "kv_latest_state" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        parser().parse_args(["campaign", "--seeds", "0"])
