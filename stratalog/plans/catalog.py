"""Every registered query of the log and storage engine, with its DuckDB twin.

A query is a function (spark, sf_dir) -> DataFrame over whole tables; SQL without a twin would be
an iterative search, a byte-exact hash, a stream or a random draw.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, scalars
from ..operators import benchmarks, consensus, faults, history, log, runs, state
from ..sources import commands as src
from ..sources import documents, schemas
from ..sources.commands import with_cte

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, raw: bool = False):
    """Register a function under its name, with its SQL over the common table expressions."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            text = sql if raw else with_cte(sql)
            SQL[f.__name__] = text.replace("WITH ", "WITH RECURSIVE ", 1) if "FROM walk" in text else text
        return f

    return register


# State.

LATEST = """, w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM ver)"""


@query(LATEST + "SELECT key, seq, value FROM w WHERE r = 1 AND NOT tombstone")
def kv_latest_state(spark, sf):
    return state.read_view(src.versions(spark, sf)).select("key", "seq", "value")


@query(LATEST + "SELECT key, seq, value, tombstone FROM w WHERE r = 1")
def kv_versions_lww_with_tombstones(spark, sf):
    return state.latest_versions(src.versions(spark, sf))


@query(LATEST + "SELECT key, seq, value, tombstone FROM w WHERE r = 1 AND key = 42")
def kv_point_read(spark, sf):
    return state.point_read(src.versions(spark, sf), 42)


@query(LATEST + """, want AS (SELECT DISTINCT (user_id % 137)::INTEGER AS key FROM events)
SELECT want.key, w.key IS NOT NULL AS found, w.value FROM want LEFT JOIN (SELECT * FROM w WHERE r = 1 AND NOT tombstone) w USING (key)""")
def kv_multi_get_hit_miss(spark, sf):
    want = src.table(spark, sf, "events").select((F.col("user_id") % 137).cast("int").alias("key")).distinct()
    return state.multi_get(src.versions(spark, sf), want)


@query("SELECT op, count(*) AS n FROM cmd0 GROUP BY op")
def kv_op_counts(spark, sf):
    return log.op_counts(src.raw_commands(spark, sf))


@query("SELECT key, seq, count(DISTINCT (tombstone, CASE WHEN NOT tombstone THEN value END)) AS payloads FROM item GROUP BY key, seq HAVING payloads > 1")
def run_conflicts(spark, sf):
    return state.conflicts(src.item_versions(spark, sf))


@query(""", w AS (SELECT *, row_number() OVER (PARTITION BY file, key ORDER BY seq DESC) AS r FROM ver)
SELECT file, sum(CASE WHEN tombstone THEN 17 ELSE 25 END)::BIGINT AS bytes, count(*) AS entries FROM w WHERE r = 1 GROUP BY file""")
def memtable_bytes(spark, sf):
    return state.memtable_bytes(src.versions(spark, sf), "file")


@query(""", f AS (SELECT max(idx) // 2 AS f FROM cmd0), w AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM ver WHERE seq > (SELECT f FROM f))
SELECT key, seq, value, tombstone FROM w WHERE r = 1""")
def active_snapshot(spark, sf):
    half = src.raw_commands(spark, sf).agg(F.floor(F.max("idx") / 2)).first()[0]
    return state.unflushed(src.versions(spark, sf), half)


@query("SELECT coalesce(max(idx), 0) AS applied_index FROM cmd0")
def log_applied_index(spark, sf):
    return state.applied_index(src.raw_commands(spark, sf))


@query("""SELECT greatest((SELECT max(idx) FROM cmd0), (SELECT max(flushed_index) FROM edit)) AS target""")
def automatic_flush_target(spark, sf):
    applied = state.applied_index(src.raw_commands(spark, sf))
    flushed = runs.flushed_index(src.manifest_edits(spark, sf))
    return applied.join(F.broadcast(flushed)).select(state.flush_target(F.col("applied_index"), F.col("flushed_index")).alias("target"))


@query(""", s AS (SELECT client_id AS stream, idx AS arrival, CASE WHEN idx % 11 = 0 THEN idx - 9 ELSE idx END AS i FROM cmd0),
m AS (SELECT *, max(i) OVER (PARTITION BY stream ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT stream, arrival, i, before FROM m WHERE i < before""")
def applied_index_regressions(spark, sf):
    s = src.raw_commands(spark, sf).select(
        F.col("client_id").alias("stream"), F.col("idx").alias("arrival"), F.when(F.col("idx") % 11 == 0, F.col("idx") - 9).otherwise(F.col("idx")).alias("i")
    )
    return state.applied_regressions(s, "arrival", "i")


@query()
def state_digest(spark, sf):
    return state.state_digest(kv_latest_state(spark, sf))


@query(LATEST + """, d AS (SELECT key, max(seq) + 1000000 AS seq, NULL::DOUBLE AS value, true AS tombstone FROM ver WHERE key % 10 = 0 GROUP BY key),
w2 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM (SELECT key, seq, value, tombstone FROM ver UNION ALL SELECT * FROM d))
SELECT key, seq, value FROM w2 WHERE r = 1 AND NOT tombstone""")
def kv_state_after_deletes(spark, sf):
    v = src.versions(spark, sf).drop("file")
    keys = v.where("key % 10 = 0").groupBy("key").agg((F.max("seq") + 1000000).alias("seq"))
    return state.read_view(v.unionByName(state.tombstones(keys))).select("key", "seq", "value")


# Log.

DEDUP = """, flag AS (SELECT *, coalesce(seq <= max(seq) OVER (PARTITION BY client_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS duplicate FROM cmd),
acc AS (SELECT * FROM flag WHERE NOT duplicate),
asof0 AS (SELECT idx, client_id, key, op,
  max(CASE WHEN op <> 'GET' THEN idx END) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM acc),
reads AS (SELECT a.idx, a.client_id, a.key, coalesce(c.op = 'PUT', false) AS found, CASE WHEN c.op = 'PUT' THEN c.value END AS result
  FROM asof0 a LEFT JOIN cmd c ON c.idx = a.m WHERE a.op = 'GET')
"""


@query(DEDUP + "SELECT idx, client_id, seq, duplicate FROM flag")
def log_dedup_flags(spark, sf):
    return log.dedup_flags(src.commands(spark, sf)).select("idx", "client_id", "seq", "duplicate")


@query(DEDUP + """, w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS r FROM acc WHERE op <> 'GET')
SELECT key, idx AS seq, value FROM w WHERE r = 1 AND op = 'PUT'""")
def kv_latest_state_after_dedup(spark, sf):
    live = log.accepted(src.commands(spark, sf)).where("op <> 'GET'").select(
        "key", F.col("idx").alias("seq"), F.when(F.col("op") == "PUT", F.col("value")).alias("value"), (F.col("op") == "DELETE").alias("tombstone")
    )
    return state.read_view(live).select("key", "seq", "value")


@query(DEDUP + "SELECT idx, client_id, key, found, result FROM reads")
def log_get_results_asof(spark, sf):
    return log.asof_reads(log.accepted(src.commands(spark, sf)))


@query(DEDUP + """, last AS (SELECT idx, client_id, duplicate, max(CASE WHEN NOT duplicate THEN idx END) OVER (PARTITION BY client_id ORDER BY idx) AS a FROM flag)
SELECT l.idx, l.client_id, l.duplicate, coalesce(r.found, false) AS found, r.result FROM last l LEFT JOIN reads r ON r.idx = l.a""")
def log_dedup_cached_result(spark, sf):
    return log.results(src.commands(spark, sf))


@query(DEDUP + "SELECT client_id, max(seq) AS last_seq, max(idx) AS at_index FROM acc GROUP BY client_id")
def client_session_table(spark, sf):
    return log.session_table(src.commands(spark, sf))


@query("""SELECT idx, CASE WHEN client_id = 0 OR idx % 101 = 0 THEN 'client_id is zero' WHEN seq <= 0 THEN 'seq is not positive' ELSE 'unknown op' END AS reason
FROM (SELECT idx, client_id, CASE WHEN idx % 107 = 0 THEN 0 ELSE seq END AS seq FROM cmd) WHERE client_id = 0 OR idx % 101 = 0 OR seq <= 0 OR idx % 103 = 0""")
def invalid_commands(spark, sf):
    c = src.commands(spark, sf)
    c = c.withColumns({
        "client_id": F.when(c.idx % 101 == 0, 0).otherwise(c.client_id), "op": F.when(c.idx % 103 == 0, "UNSPECIFIED").otherwise(c.op),
        "seq": F.when(c.idx % 107 == 0, 0).otherwise(c.seq),
    })
    return log.invalid_commands(c).select("idx", "reason")


@query("SELECT replayed, count(*) AS n FROM (SELECT idx <= (SELECT max(idx) // 3 FROM cmd0) AS replayed FROM cmd0) GROUP BY replayed")
def log_replay_mode(spark, sf):
    c = src.raw_commands(spark, sf)
    ceiling = c.agg(F.floor(F.max("idx") / 3)).first()[0]
    return log.replay_mode(c, ceiling).groupBy("replayed").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT idx FROM cmd0 c WHERE op <> 'DELETE' AND idx > 0 AND NOT EXISTS (SELECT 1 FROM cmd0 d WHERE d.idx = c.idx - 1 AND d.op <> 'DELETE') AND idx > (SELECT min(idx) FROM cmd0 WHERE op <> 'DELETE')")
def log_index_gaps(spark, sf):
    return log.gaps(src.raw_commands(spark, sf).where("op <> 'DELETE'")).select("idx")


@query("SELECT min(idx) AS first_index, max(idx) AS last_index FROM cmd0")
def log_first_last(spark, sf):
    return log.first_last(src.raw_commands(spark, sf))


@query("SELECT idx, op, key FROM cmd0 WHERE idx >= 100 AND idx < 300")
def log_range_read(spark, sf):
    return log.entries_between(src.raw_commands(spark, sf), 100, 300).select("idx", "op", "key")


@query(""", rec AS (SELECT *, min(from_index) OVER (ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cut FROM wal),
ent AS (SELECT ord, cut, term, unnest(range(ord, ord + n)) AS index FROM rec WHERE kind = 'entries')
SELECT ord, index, term FROM ent WHERE cut IS NULL OR cut > index""")
def wal_truncation_survivors(spark, sf):
    return log.wal_survivors(src.wal(spark, sf))


@query("""SELECT segment, ord, CASE WHEN ord = (SELECT max(ord) FROM wal) THEN 'drop' ELSE 'corrupt' END AS verdict
FROM wal WHERE ord % 997 = 5 OR ord = (SELECT max(ord) FROM wal)""")
def wal_torn_tail(spark, sf):
    w = src.wal(spark, sf)
    last = w.agg(F.max("ord").alias("m"))
    return log.torn_tail(w.join(F.broadcast(last)).withColumn("terminated", ~((F.col("ord") % 997 == 5) | (F.col("ord") == F.col("m")))))


@query("SELECT s + 1 AS segment FROM (SELECT DISTINCT segment AS s FROM wal WHERE segment % 7 <> 3) WHERE s + 1 > 1 AND s NOT IN (SELECT DISTINCT segment + 1 FROM wal WHERE segment % 7 <> 3)")
def segment_gaps(spark, sf):
    return log.segment_gaps(src.wal(spark, sf).where("segment % 7 <> 3").select((F.col("segment") + 1).alias("segment")))


@query(""", l AS (SELECT idx, term FROM node_log WHERE node = 4), r AS (SELECT idx, term FROM node_log WHERE node = 3),
c AS (SELECT min(r.idx) AS c FROM r LEFT JOIN l USING (idx) WHERE l.term IS NULL OR l.term <> r.term)
SELECT idx, term, 'local' AS origin FROM l, c WHERE c IS NULL OR idx < c UNION ALL SELECT idx, term, 'leader' FROM r, c WHERE idx >= c""")
def log_conflict_append(spark, sf):
    n = src.node_logs(spark, sf)
    return log.conflict_append(n.where("node = 4").select("idx", "term"), n.where("node = 3").select("idx", "term"))


@query("SELECT idx, idx > 800 AS unstable, idx > 600 AND idx <= 700 AS newly_committed FROM cmd0 WHERE idx > 800 OR (idx > 600 AND idx <= 700)")
def ready_batch(spark, sf):
    return log.ready_batch(src.raw_commands(spark, sf), 800, 600, 700)


@query("SELECT idx, greatest(idx // 250, idx // 300 + 1) AS term FROM cmd0")
def effective_message_term(spark, sf):
    return src.raw_commands(spark, sf).select("idx", log.effective_term(F.floor(F.col("idx") / 250), F.floor(F.col("idx") / 300) + 1).cast("long").alias("term"))


# Runs.

META = ", meta AS (SELECT file, min(key) AS min_key, max(key) AS max_key, count(*) AS n, min(seq) AS min_seq, max(seq) AS max_seq FROM ver GROUP BY file)\n"


@query(META + "SELECT * FROM meta")
def run_metadata(spark, sf):
    return runs.run_metadata(src.versions(spark, sf))


@query(META + "SELECT file, min_key, max_key FROM meta WHERE min_key <= 2 AND max_key >= 2")
def run_prune_candidates(spark, sf):
    return runs.prune_candidates(runs.run_metadata(src.versions(spark, sf)), 2).select("file", "min_key", "max_key")


@query(LATEST + "SELECT key, seq, value, tombstone FROM w WHERE r = 1")
def run_kway_merge(spark, sf):
    return runs.merge_runs(src.versions(spark, sf))


@query(""", p AS (SELECT file, seq AS pos, key, seq, lag(key) OVER x AS pk, lag(seq) OVER x AS ps FROM ver WINDOW x AS (PARTITION BY file ORDER BY seq))
SELECT file, pos, key, seq FROM p WHERE pk > key OR (pk = key AND ps <= seq)""")
def run_order_violations(spark, sf):
    return runs.order_violations(src.versions(spark, sf).withColumn("pos", F.col("seq")))


@query(META + """, stated AS (SELECT file, min_key, max_key, CASE WHEN n % 3 = 0 THEN n + 1 ELSE n END AS n FROM meta WHERE n % 5 <> 0)
SELECT file, m.n AS found, s.n AS stated FROM meta m FULL JOIN stated s USING (file)
WHERE NOT (m.n IS NOT DISTINCT FROM s.n AND m.min_key IS NOT DISTINCT FROM s.min_key AND m.max_key IS NOT DISTINCT FROM s.max_key)""")
def run_metadata_violations(spark, sf):
    v = src.versions(spark, sf)
    m = runs.run_metadata(v)
    stated = m.where("n % 5 <> 0").withColumn("n", F.when(F.col("n") % 3 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return runs.metadata_violations(v, stated)


@query("""SELECT o_orderkey AS id, CASE WHEN s < 4096 THEN 0 ELSE 1 + (length(bin(s // 4096)) - 1) // 2 END::INTEGER AS size_class
FROM (SELECT o_orderkey, (o_totalprice * 100)::BIGINT AS s FROM orders)""")
def tier_size_class(spark, sf):
    size = F.round(F.col("o_totalprice") * 100).cast("long")
    return src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), runs.size_class(size).alias("size_class"))


@query(META + """, t AS (SELECT file, CASE WHEN n * 64 < 4096 THEN 0 ELSE 1 + (length(bin(n * 64 // 4096)) - 1) // 2 END AS tier FROM meta),
pick AS (SELECT min(tier) AS tier FROM (SELECT tier FROM t GROUP BY tier HAVING count(*) >= 4))
SELECT file, tier::INTEGER AS tier FROM t WHERE tier = (SELECT tier FROM pick) ORDER BY file LIMIT 4""")
def compaction_pick(spark, sf):
    files = runs.run_metadata(src.versions(spark, sf)).select("file", runs.size_class(F.col("n") * 64).alias("tier"))
    return runs.pick_compaction(files).select("file", "tier")


LIVE = """, act AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord DESC, action) AS r FROM edit),
live AS (SELECT file FROM act WHERE r = 1 AND action = 'add')
"""


@query(LIVE + "SELECT file FROM live")
def manifest_live_files(spark, sf):
    return runs.live_files(src.manifest_edits(spark, sf))


@query("SELECT coalesce(max(flushed_index), 0) AS flushed_index FROM edit")
def manifest_flushed_index(spark, sf):
    return runs.flushed_index(src.manifest_edits(spark, sf))


@query(LIVE + "SELECT DISTINCT file FROM edit WHERE file NOT IN (SELECT file FROM live)")
def orphans_anti(spark, sf):
    e = src.manifest_edits(spark, sf)
    return runs.orphans(e.select("file").distinct(), runs.live_files(e))


#: Each day adds its run; by the number of the day something is wrong with it, or a second edit is.
BAD_EDITS = """, m AS (SELECT file, min(key) AS lo, max(key) AS hi, count(*) AS n, max(seq) AS top FROM ver GROUP BY file),
d AS (SELECT *, row_number() OVER (ORDER BY file) AS d FROM m),
e AS (SELECT d * 2 AS ord, 'add' AS action, CASE WHEN d % 6 = 5 THEN 'x' || d ELSE printf('%06d.sst', d) END AS file, CASE WHEN d % 6 = 3 THEN 0 ELSE n END AS n,
    CASE WHEN d % 6 = 4 THEN hi + 1 ELSE lo END AS min_key, CASE WHEN d % 6 = 4 THEN lo ELSE hi END AS max_key, CASE WHEN d % 7 = 6 THEN 1 ELSE top END AS flushed_index FROM d
  UNION ALL SELECT d * 2 + 1, 'add', printf('%06d.sst', d), n, lo, hi, NULL FROM d WHERE d % 6 = 1
  UNION ALL SELECT d * 2 + 1, 'remove', printf('%06d.sst', d + 900000), NULL, NULL, NULL, NULL FROM d WHERE d % 6 = 2
  UNION ALL SELECT d * 2 + 1, NULL, NULL, NULL, NULL, NULL, NULL FROM d WHERE d % 6 = 0)
"""


def _bad_edits(spark, sf):
    m = src.versions(spark, sf).groupBy("file").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"), F.max("seq").alias("top"))
    d = m.withColumn("d", F.row_number().over(Window.orderBy("file")).cast("long"))  # a row a day
    name, none = F.format_string("%06d.sst", "d"), F.lit(None)
    reversed_ = F.col("d") % 6 == 4
    first = d.select(
        (F.col("d") * 2).alias("ord"), F.lit("add").alias("action"), F.when(F.col("d") % 6 == 5, F.concat(F.lit("x"), F.col("d").cast("string"))).otherwise(name).alias("file"),
        F.when(F.col("d") % 6 == 3, 0).otherwise(F.col("n")).alias("n"), F.when(reversed_, F.col("hi") + 1).otherwise(F.col("lo")).alias("min_key"),
        F.when(reversed_, F.col("lo")).otherwise(F.col("hi")).alias("max_key"), F.when(F.col("d") % 7 == 6, 1).otherwise(F.col("top")).alias("flushed_index"),
    )
    second = d.where("d % 6 < 3").select(
        (F.col("d") * 2 + 1).alias("ord"), F.when(F.col("d") % 6 == 1, "add").when(F.col("d") % 6 == 2, "remove").alias("action"),
        F.when(F.col("d") % 6 == 1, name).when(F.col("d") % 6 == 2, F.format_string("%06d.sst", F.col("d") + 900000)).alias("file"),
        *[F.when(F.col("d") % 6 == 1, F.col(c)).alias(k) for c, k in (("n", "n"), ("lo", "min_key"), ("hi", "max_key"))], none.cast("long").alias("flushed_index"),
    )
    return first.unionByName(second)


@query(BAD_EDITS + """, f AS (SELECT ord, max(flushed_index) AS f, count(file) AS k FROM e GROUP BY ord),
b AS (SELECT *, max(f) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM f)
SELECT ord, 'adds a live file' AS rule, file FROM e x WHERE action = 'add' AND (SELECT count(*) FILTER (action = 'add') > count(*) FILTER (action = 'remove') FROM e y WHERE y.file = x.file AND y.ord < x.ord)
UNION ALL SELECT ord, 'removes a file that is not live', file FROM e x WHERE action = 'remove' AND NOT EXISTS (SELECT 1 FROM e y WHERE y.file = x.file AND y.ord < x.ord AND action = 'add')
UNION ALL SELECT ord, 'count is not positive', file FROM e WHERE action = 'add' AND n <= 0
UNION ALL SELECT ord, 'bounds are reversed', file FROM e WHERE action = 'add' AND min_key > max_key
UNION ALL SELECT ord, 'invalid file name', file FROM e WHERE action = 'add' AND NOT regexp_full_match(file, '[0-9]{6,}[.]sst')
UNION ALL SELECT ord, 'flushed index regresses', NULL FROM b WHERE f < b
UNION ALL SELECT ord, 'empty edit', NULL FROM b WHERE k = 0 AND coalesce(f, b, 0) = coalesce(b, 0)""")
def manifest_edit_violations(spark, sf):
    return runs.edit_violations(_bad_edits(spark, sf))


@query(""", p AS (SELECT key % 8 AS shard, seq AS ord, key, CASE WHEN tombstone THEN 17 ELSE 25 END AS bytes, row_number() OVER (PARTITION BY key % 8 ORDER BY seq) AS r FROM ver),
walk AS (SELECT shard, ord, r, 0 AS generation, MAP {key: bytes} AS held FROM p WHERE r = 1 UNION ALL
  SELECT p.shard, p.ord, p.r, CASE WHEN list_sum(map_values(w.held)) >= 256 THEN w.generation + 1 ELSE w.generation END,
    CASE WHEN list_sum(map_values(w.held)) >= 256 THEN MAP {p.key: p.bytes} ELSE map_concat(w.held, MAP {p.key: p.bytes}) END
  FROM walk w JOIN p ON p.shard = w.shard AND p.r = w.r + 1)
SELECT shard::BIGINT AS shard, ord, generation::BIGINT AS generation FROM walk""")
def flush_generations(spark, sf):
    rows = src.versions(spark, sf).select(
        F.pmod("key", F.lit(8)).cast("long").alias("shard"), F.col("seq").alias("ord"), "key", F.when(F.col("tombstone"), 17).otherwise(25).cast("long").alias("bytes")
    )
    return runs.flush_generations(rows, 256)


@query(""", p AS (SELECT file, key, row_number() OVER (PARTITION BY file ORDER BY key, seq DESC) AS pos FROM ver),
walk AS (SELECT file, pos, key, 0 AS block, 40 AS filled FROM p WHERE pos = 1 UNION ALL
  SELECT p.file, p.pos, p.key, CASE WHEN w.filled + 40 > 512 AND p.key <> w.key THEN w.block + 1 ELSE w.block END,
    CASE WHEN w.filled + 40 > 512 AND p.key <> w.key THEN 40 ELSE w.filled + 40 END FROM walk w JOIN p ON p.file = w.file AND p.pos = w.pos + 1)
SELECT file, pos, block::BIGINT AS block FROM walk""")
def data_blocks(spark, sf):
    v = src.versions(spark, sf)
    pos = F.row_number().over(Window.partitionBy("file").orderBy("key", F.desc("seq"))).cast("long")
    return runs.data_blocks(v.select("file", "key", pos.alias("pos"), F.lit(40).alias("bytes")), 512)


@query("SELECT op, count(*) AS calls, sum(strlen(props))::BIGINT AS bytes, CASE WHEN idx3 = 0 THEN 'sstable' WHEN idx3 = 1 THEN 'manifest' ELSE 'other' END AS class FROM (SELECT props, event_id % 3 AS idx3, CASE WHEN event_id % 2 = 0 THEN 'read' ELSE 'write' END AS op FROM events) GROUP BY op, class", raw=True)
def io_accounting(spark, sf):
    e = src.table(spark, sf, "events")
    path = F.when(e.event_id % 3 == 0, F.format_string("db/%06d.sst", e.event_id)).when(e.event_id % 3 == 1, "db/MANIFEST").otherwise("db/LOCK")
    return benchmarks.io_accounting(e.select(path.alias("path"), F.when(e.event_id % 2 == 0, "read").otherwise("write").alias("op"), F.octet_length("props").cast("long").alias("bytes")))


# Consensus.

MATCH = ", m AS (SELECT node, max(idx) AS match_index FROM node_log GROUP BY node), held AS (SELECT match_index AS h FROM m ORDER BY match_index DESC LIMIT 1 OFFSET 2)\n"


def _match(spark, sf):
    return src.node_logs(spark, sf).groupBy("node").agg(F.max("idx").alias("match_index"))


def _commit(spark, sf, any_term):
    n = src.node_logs(spark, sf).where("node = 0")
    term = n.agg(F.max("term")).first()[0] + (1 if any_term else 0)
    return consensus.commit_index(n.select("idx", "term"), _match(spark, sf), 5, term, any_term)


@query(MATCH + "SELECT coalesce(max(idx), 0) AS commit_index FROM node_log, held WHERE node = 0 AND idx <= h AND term = (SELECT max(term) FROM node_log WHERE node = 0)")
def commit_index(spark, sf):
    return _commit(spark, sf, False)


@query(MATCH + "SELECT coalesce(max(idx), 0) AS commit_index FROM node_log, held WHERE node = 0 AND idx <= h")
def commit_index_naive_rule(spark, sf):
    """The wrong rule, which counts replicas of old terms: a negative control."""
    return _commit(spark, sf, True)


VOTES = ", votes AS (SELECT idx // 50 AS term, client_id % 5 AS voter, (client_id + idx // 17) % 3 AS candidate FROM cmd0)\n"


def _votes(spark, sf):
    c = src.raw_commands(spark, sf)
    return c.select(F.floor(c.idx / 50).alias("term"), (c.client_id % 5).alias("voter"), ((c.client_id + F.floor(c.idx / 17)) % 3).alias("candidate"))


@query(VOTES + "SELECT term, candidate, count(DISTINCT voter) AS votes FROM votes GROUP BY term, candidate HAVING votes >= 3")
def votes_majority(spark, sf):
    return consensus.elected(_votes(spark, sf), 5)


@query(VOTES + "SELECT term, voter, count(DISTINCT candidate) AS candidates FROM votes GROUP BY term, voter HAVING candidates > 1")
def double_votes(spark, sf):
    return consensus.double_votes(_votes(spark, sf))


def _appends(spark, sf):
    c = src.raw_commands(spark, sf)
    return c.select(F.floor(c.idx / 40).alias("term"), F.pmod(F.floor(c.idx / 43), F.lit(5)).alias("node"))


APPENDS = ", app AS (SELECT idx // 40 AS term, (idx // 43) % 5 AS node FROM cmd0)\n"


@query(APPENDS + "SELECT term, count(DISTINCT node) AS leaders FROM app GROUP BY term HAVING leaders > 1")
def leaders_per_term(spark, sf):
    return consensus.leaders_per_term(_appends(spark, sf))


@query(APPENDS + "SELECT term, array_to_string(list_sort(list(DISTINCT node)), ',') AS nodes FROM app GROUP BY term")
def leaderships(spark, sf):
    return consensus.leaderships(_appends(spark, sf)).select("term", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query(APPENDS + "SELECT max(term) AS highest_term FROM app")
def highest_term(spark, sf):
    return consensus.highest_term(_appends(spark, sf))


@query(""", p AS (SELECT l.node AS "left", r.node AS "right", l.idx, l.term = r.term AS same, NOT (l.term = r.term AND l.data = r.data) AS diff
  FROM node_log l JOIN node_log r ON l.idx = r.idx AND l.node < r.node)
SELECT "left", "right", min(CASE WHEN diff THEN idx END) AS first_difference, max(CASE WHEN same THEN idx END) AS last_agreement
FROM p GROUP BY "left", "right" HAVING last_agreement >= first_difference""")
def log_matching_pairs(spark, sf):
    return consensus.log_matching(src.node_logs(spark, sf))


@query("SELECT l.node, l.term > r.term OR (l.term = r.term AND l.idx >= r.idx) AS up_to_date FROM (SELECT node, max(term) AS term, max(idx) AS idx FROM node_log GROUP BY node) l, (SELECT max(term) AS term, max(idx) AS idx FROM node_log WHERE node = 0) r")
def candidate_log_up_to_date(spark, sf):
    last = src.node_logs(spark, sf).groupBy("node").agg(F.max("term").alias("term"), F.max("idx").alias("idx"))
    own = last.where("node = 0").select(F.col("term").alias("t"), F.col("idx").alias("i"))
    return last.join(F.broadcast(own)).select("node", consensus.log_up_to_date(F.col("term"), F.col("idx"), F.col("t"), F.col("i")).alias("up_to_date"))


@query(""", m AS (SELECT client_id % 5 AS node, idx AS ord, CASE WHEN idx % 6 = 0 THEN idx // 90 END AS leader FROM cmd0)
SELECT node, ord, last_value(leader IGNORE NULLS) OVER (PARTITION BY node ORDER BY ord) AS hint FROM m""")
def leader_hints(spark, sf):
    c = src.raw_commands(spark, sf)
    m = c.select((c.client_id % 5).alias("node"), c.idx.alias("ord"), F.when(c.idx % 6 == 0, F.floor(c.idx / 90)).alias("leader"))
    return consensus.leader_hints(m).select("node", "ord", "hint")


@query(""", a AS (SELECT idx, term FROM node_log WHERE node = 3), w AS (SELECT idx, term FROM node_log WHERE node = 0 AND data = 'purchase'
  UNION ALL SELECT max(idx) + 5, 0 FROM cmd0)
SELECT w.idx, w.term, CASE WHEN a.term IS NULL THEN 'pending' WHEN a.term = w.term THEN 'applied' ELSE 'stale' END AS outcome FROM w LEFT JOIN a USING (idx)""")
def waiter_outcomes(spark, sf):
    """Whoever asked for a purchase or a signup waits; signups have been cancelled."""
    n = src.node_logs(spark, sf)
    own = n.where("node = 0")
    late = src.raw_commands(spark, sf).agg((F.max("idx") + 5).alias("idx")).withColumn("term", F.lit(0).cast("long"))
    waiters = own.where("data IN ('purchase', 'signup')").select("idx", "term").unionByName(late)
    return consensus.fulfilled(waiters, n.where("node = 3").select("idx", "term"), own.where("data = 'signup'").select("idx", "term"))


@query("""SELECT l.node, l.idx, l.term, CASE WHEN r.term IS NULL THEN 'pending' WHEN r.term = l.term THEN 'applied' ELSE 'leadership-lost' END AS outcome
FROM (SELECT node, idx, idx // 250 AS term FROM (SELECT unnest(range(0, 5)) AS node), cmd0) l LEFT JOIN node_log r USING (node, idx)""")
def attempt_outcomes(spark, sf):
    c = src.raw_commands(spark, sf)
    tried = c.select(F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")).alias("node"), "idx", F.floor(c.idx / 250).alias("term"))
    return consensus.attempts(tried, src.node_logs(spark, sf))


@query("SELECT term, min(idx) AS idx FROM (SELECT idx // 250 AS term, idx FROM cmd0) GROUP BY term HAVING min(idx) % 500 <> 0")
def terms_without_noop(spark, sf):
    c = src.raw_commands(spark, sf)
    return consensus.terms_without_noop(c.select(F.floor(c.idx / 250).alias("term"), "idx", F.when(c.idx % 500 == 0, "NOOP").otherwise("NORMAL").alias("type")))


# Histories.


@query("SELECT id, client_id, op, invoke, ret FROM oper")
def history_intervals(spark, sf):
    return src.operations(spark, sf).select("id", "client_id", "op", "invoke", "ret")


@query(""", ev AS (SELECT id, invoke AS at, false AS is_return FROM oper UNION ALL SELECT id, coalesce(ret, 4611686018427387903), true FROM oper)
SELECT id, is_return, row_number() OVER (ORDER BY at, is_return, id) AS place FROM ev""")
def history_call_return_order(spark, sf):
    e = history.call_return_events(src.operations(spark, sf))
    return history.placed(e, ["at", "is_return", "id"], 600_000_000).select("id", "is_return", "place")


@query(""", pt AS (SELECT invoke AS at, 1 AS d FROM oper UNION ALL SELECT ret, -1 FROM oper WHERE ret IS NOT NULL),
lvl AS (SELECT sum(d) OVER (ORDER BY at, d DESC ROWS UNBOUNDED PRECEDING) AS l FROM pt) SELECT max(l)::BIGINT AS max_concurrent FROM lvl""")
def history_max_concurrency(spark, sf):
    return history.max_concurrency(src.operations(spark, sf), 600_000_000)


#: Every error event is a fault.
FAULTS = ", fault AS (SELECT event_id AS fault_id, epoch_us(ts) + 1 AS at FROM events WHERE event_type = 'error')\n"


def _faults(spark, sf):
    return src.raw_commands(spark, sf).where("op = 'DELETE'").select(F.col("idx").alias("fault_id"), (F.col("us") + 1).alias("at"))


@query(FAULTS + "SELECT fault_id, count(DISTINCT client_id) AS clients FROM fault LEFT JOIN oper ON invoke < at AND (ret IS NULL OR ret >= at) GROUP BY fault_id")
def faults_in_flight(spark, sf):
    return history.faults_in_flight(_faults(spark, sf), src.operations(spark, sf))


@query(FAULTS.replace(" + 1 AS at", " AS at") + "SELECT fault_id, count(DISTINCT client_id) AS clients FROM fault LEFT JOIN oper ON invoke <= at AND (ret IS NULL OR ret >= at) GROUP BY fault_id")
def clients_in_flight(spark, sf):
    return history.faults_in_flight(_faults(spark, sf).withColumn("at", F.col("at") - 1), src.operations(spark, sf), strict_start=False)


@query(""", s AS (SELECT o.id, o.client_id, c.seq, o.invoke, CASE WHEN o.id % 9 = 0 THEN o.ret + 5 WHEN o.id % 31 = 0 THEN NULL ELSE o.ret END AS ret FROM oper o JOIN cmd c ON c.idx = o.id),
p AS (SELECT *, lag(id) OVER w AS prev, lag(ret) OVER w AS pr, lag(seq) OVER w AS ps FROM s WINDOW w AS (PARTITION BY client_id ORDER BY invoke, id))
SELECT id, 'outstanding' AS rule FROM p WHERE prev IS NOT NULL AND (pr IS NULL OR pr > invoke) UNION ALL SELECT id, 'sequence' FROM p WHERE prev IS NOT NULL AND seq <= ps""")
def session_violations(spark, sf):
    ops = src.operations(spark, sf).join(src.commands(spark, sf).select(F.col("idx").alias("id"), "seq"), "id")
    ret = F.when(F.col("id") % 9 == 0, F.col("ret") + 5).when(F.col("id") % 31 == 0, None).otherwise(F.col("ret"))
    return history.session_violations(ops.withColumn("ret", ret))


@query("SELECT DISTINCT client_id FROM oper WHERE ret IS NULL")
def outstanding_clients(spark, sf):
    return history.outstanding(src.operations(spark, sf))


@query(""", wr AS (SELECT key, invoke, ret, CASE WHEN op = 'PUT' THEN round(value) END AS value FROM oper WHERE op <> 'GET' AND ret IS NOT NULL),
src AS (SELECT key, value, max(ret) AS w_ret FROM wr WHERE value IS NOT NULL GROUP BY key, value),
rd AS (SELECT id, key, invoke, round(value) AS value FROM oper WHERE op = 'GET')
SELECT rd.id FROM rd JOIN src USING (key, value) WHERE w_ret < (SELECT max(wr.invoke) FROM wr WHERE wr.key = rd.key AND wr.ret < rd.invoke)""")
def history_stale_read_candidates(spark, sf):
    return history.stale_read_candidates(src.operations(spark, sf).withColumn("value", F.round("value")))


@query()
def linearizable_per_key(spark, sf):
    """Reads answered from the log, so that each key's history has a linearization; calls and
    returns as they are, so operations overlap and the last of each client is open."""
    ops = src.operations(spark, sf)
    reads = log.asof_reads(src.raw_commands(spark, sf)).select(F.col("idx").alias("id"), "found", F.col("result").alias("out_value"))
    full = ops.join(reads, "id", "left").select(
        "id", "op", "key", F.col("value").alias("in_value"), "out_value", F.coalesce("found", F.lit(False)).alias("found"),
        F.lit(True).alias("ok"), F.lit(False).alias("unknown"), "invoke", "ret",
    )
    return history.linearizable_per_key(full)


# Faults.

@query(""", s AS (SELECT client_id % 5 AS target, us AS at, value AS v FROM cmd0 WHERE op = 'DELETE'), p AS (SELECT client_id % 5 AS target, idx AS probe_id, us AS at FROM cmd0 WHERE op <> 'DELETE')
SELECT probe_id, v AS in_force FROM p ASOF LEFT JOIN s ON p.target = s.target AND p.at >= s.at""")
def fault_state_asof(spark, sf):
    """Errors set a rate; all other events ask which is in force."""
    c = src.raw_commands(spark, sf).withColumn("target", F.col("client_id") % 5)
    settings = c.where("op = 'DELETE'").select("target", F.col("idx").alias("ord"), F.col("us").alias("at"), F.col("value").alias("v"))
    return faults.in_force(c.where("op <> 'DELETE'").select("target", F.col("idx").alias("probe_id"), F.col("us").alias("at")), settings)


@query(""", p AS (SELECT client_id % 5 AS target, idx AS ord, us AS at, op = 'PUT' AS opens FROM cmd0 WHERE op <> 'GET'),
n AS (SELECT *, min(CASE WHEN NOT opens THEN at END) OVER (PARTITION BY target ORDER BY at, ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed FROM p)
SELECT target, at AS opened, closed FROM n WHERE opens""")
def fault_open_intervals(spark, sf):
    c = src.raw_commands(spark, sf).where("op <> 'GET'")
    return faults.open_intervals(c.select((c.client_id % 5).alias("target"), c.us.alias("at"), c.idx.alias("ord"), (c.op == "PUT").alias("opens")))


@query(""", p AS (SELECT idx // 6 AS seed, idx % 6 AS i, (idx * 7919) % 6007 AS a, (idx * 104729) % 5003 AS b FROM cmd0),
pt AS (SELECT seed, unnest([a, b]) AS t FROM p), r AS (SELECT seed, t, row_number() OVER (PARTITION BY seed ORDER BY t) - 1 AS r FROM pt),
d AS (SELECT seed, r // 2 AS i, min(t) AS opens, max(t) AS closes FROM r GROUP BY ALL) SELECT p.seed, p.i, d.opens, d.closes FROM p JOIN d USING (seed, i)""")
def fault_pairs_normalized(spark, sf):
    c = src.raw_commands(spark, sf)
    pairs = c.select(F.floor(c.idx / 6).alias("seed"), (c.idx % 6).alias("i"), ((c.idx * 7919) % 6007).alias("a"), ((c.idx * 104729) % 5003).alias("b"))
    return faults.normalized_pairs(pairs)


@query("SELECT category FROM (VALUES ('fault crash'), ('fault drop-rate'), ('operation GET'), ('crash point after-send'), ('crash point after-sync-before-send'), ('crash point before-sync'), ('actual network drop'), ('actual network duplicate'), ('fault duplicate-rate'), ('fault partition'), ('fault heal'), ('fault partition-groups'), ('fault heal-groups'), ('fault pause'), ('fault resume'), ('fault clock-skew'), ('fault restart')) t(category) WHERE category NOT IN ('operation PUT', 'operation DELETE', 'operation GET', 'fault crash')", raw=True)
def fault_coverage_gaps(spark, sf):
    seen = log.op_counts(src.raw_commands(spark, sf)).select(F.concat(F.lit("operation "), "op").alias("category"), "n")
    seen = seen.unionByName(spark.sql("SELECT 'fault crash' AS category, 2L AS n UNION ALL SELECT 'fault pause', 0L"))
    return faults.coverage_gaps(seen, faults.required_categories(spark)).select("category")


@query(""", e AS (SELECT idx // 20 AS seed, (idx % 20)::INTEGER AS ordinal, idx % 20 - 1 AS t, key % 12 AS k, client_id % 7 AS node, idx % 6 AS f, key % 6 AS o, key / 50.0 AS rate, key / 30.0 AS m FROM cmd0)
SELECT seed, 'event' AS part, ordinal, unnest(list_filter([CASE WHEN t < 0 THEN 'negative time' END, CASE WHEN k = 0 THEN 'unknown kind' END, CASE WHEN k IN (1, 2) AND rate > 1 THEN 'rate outside [0, 1]' END,
  CASE WHEN k = 9 AND (m < 0.5 OR m > 2) THEN 'multiplier outside bounds' END, CASE WHEN k IN (3, 4) AND f = o THEN 'from equals to' END, CASE WHEN k IN (5, 6) AND node < 5 THEN 'fewer than two groups' END,
  CASE WHEN k IN (5, 6) AND node = 4 THEN 'empty group' END, CASE WHEN k IN (5, 6) AND node = 5 THEN 'node in two groups' END, CASE WHEN node > 5 THEN 'unknown node' END], lambda x: x IS NOT NULL)) AS rule FROM e
UNION ALL SELECT seed, 'schedule', -1, 'unsupported version' FROM (SELECT DISTINCT seed FROM e) WHERE seed % 3 = 1
UNION ALL SELECT seed, 'crash', ordinal, unnest(list_filter([CASE WHEN t <= 0 THEN 'ordinals are 1-based' END, CASE WHEN k % 4 = 0 THEN 'non-schedulable point' END, CASE WHEN o - 3 < -1 THEN 'retention below minimum' END,
  CASE WHEN row_number() OVER (PARTITION BY seed, node, t ORDER BY ordinal) > 1 THEN 'duplicate directive' END], lambda x: x IS NOT NULL)) FROM e""")
def schedule_violations(spark, sf):
    """Twenty events a schedule, written as JSON and decoded; groups by client: none, one, or two that
    share a node, an empty one, or none wrong."""
    c = src.raw_commands(spark, sf)
    node = (c.client_id % 7).alias("Node")
    g = lambda *xs: F.array(*[F.array(*[F.lit(y).cast("long") for y in x]) if x else F.array().cast("array<long>") for x in xs])
    groups = F.when(c.client_id % 7 == 4, g([])).when(c.client_id % 7 == 5, g([1, 2], [2])).when(c.client_id % 7 == 6, g([1], [2]))
    event = F.struct(
        (c.idx % 20 - 1).alias("Time"), (c.key % 12).alias("Kind"), node, (c.idx % 6).alias("From"), (c.key % 6).cast("long").alias("To"), groups.alias("Groups"),
        (c.key / 50).alias("Rate"), (c.key / 30).alias("Multiplier"),
    )
    crash = F.struct(node, (c.idx % 20 - 1).alias("Save"), (c.key % 4).alias("Point"), (c.key % 6 - 3).alias("RetainUnsynced"))
    per = c.groupBy(F.floor(c.idx / 20).alias("seed")).agg(F.sort_array(F.collect_list(F.struct("idx", event.alias("e"), crash.alias("c")))).alias("x"))  # 20 a schedule
    texts = per.select("seed", F.to_json(F.struct(
        F.when(F.col("seed") % 3 == 1, 3).otherwise(5).alias("Version"), F.col("x.e").alias("Events"), F.col("x.c").alias("Crashes"),
    )).alias("text"))
    return faults.schedule_violations(documents.decode_schedules(texts), [1, 2, 3, 4, 5])


@query(""", e AS (SELECT idx AS id, key % 13 AS k, (key % 3) / 4.0 AS rate, 0.5 + (key % 4) / 2.0 AS m FROM cmd0),
n AS (SELECT *, CASE WHEN k BETWEEN 1 AND 11 THEN ['drop-rate', 'duplicate-rate', 'partition', 'heal', 'partition-groups', 'heal-groups', 'pause', 'resume', 'clock-skew', 'crash', 'restart'][k] ELSE printf('faultkind(%d)', k) END AS kind FROM e)
SELECT id, kind, CASE WHEN kind IN ('drop-rate', 'duplicate-rate') THEN rate = 0 WHEN kind = 'clock-skew' THEN m = 1 ELSE false END AS neutral,
  CASE WHEN kind IN ('drop-rate', 'duplicate-rate') THEN rate > 0 WHEN kind = 'clock-skew' THEN m <> 1 ELSE kind IN ('partition', 'partition-groups', 'pause', 'crash') END AS injected FROM n""")
def fault_classes(spark, sf):
    c = src.raw_commands(spark, sf)
    e = c.select(c.idx.alias("id"), faults.kind_name(c.key % 13).alias("kind"), ((c.key % 3) / 4).alias("rate"), (0.5 + (c.key % 4) / 2).alias("multiplier"))
    args = (F.col("kind"), F.col("rate"), F.col("multiplier"))
    return e.select("id", "kind", faults.neutral(*args).alias("neutral"), faults.injected(*args).alias("injected"))


@query("""SELECT idx // 200 AS seed, concat_ws('; ', CASE WHEN count(*) < 150 THEN 'logical operations ' || count(*) || ' < 150' END,
  CASE WHEN count(*) FILTER (idx % 3 <> 0) < 120 THEN 'completed operations ' || count(*) FILTER (idx % 3 <> 0) || ' < 120' END,
  CASE WHEN count(*) FILTER (op = 'DELETE' AND idx // 200 % 2 = 0) = 0 THEN 'no DELETE operation' END,
  CASE WHEN idx // 200 % 3 < 2 THEN 'fewer than two clients overlap' END) AS failures FROM cmd0 GROUP BY idx // 200""")
def vacuity_failures(spark, sf):
    c = src.raw_commands(spark, sf)
    seed = F.floor(c.idx / 200)
    s = c.groupBy(seed.alias("seed")).agg(
        F.count(F.lit(1)).alias("logical"), F.count_if(F.col("idx") % 3 != 0).alias("completed"), F.count(F.lit(1)).alias("attempts"),
        F.lit(1).alias("puts"), F.lit(1).alias("gets"), F.count_if((F.col("op") == "DELETE") & (F.floor(F.col("idx") / 200) % 2 == 0)).alias("deletes"),
        F.lit(1).alias("faults_in_flight"),
    ).withColumn("max_concurrent", F.col("seed") % 3)
    return faults.vacuity_failures(s)


@query("""SELECT count(*) AS seeds, count(*) FILTER (seed % 7 = 3) AS failed, count(*) FILTER (seed % 7 <> 3) AS passed, sum(n)::BIGINT AS operations, min(n) AS min_operations,
 max(n) AS max_operations, max(c) AS max_concurrent, min(CASE WHEN seed % 7 = 3 THEN seed END) AS first_failing_seed
FROM (SELECT idx // 50 AS seed, count(*) AS n, count(DISTINCT client_id) AS c FROM cmd0 GROUP BY 1)""")
def batch_aggregate(spark, sf):
    c = src.raw_commands(spark, sf)
    s = c.groupBy(F.floor(c.idx / 50).alias("seed")).agg(F.count(F.lit(1)).alias("operations"), F.count_distinct("client_id").alias("max_concurrent"))
    return faults.batch_aggregate(s.withColumn("failed", F.col("seed") % 7 == 3))


@query("SELECT count(*) FILTER (idx % 13 = 0) AS drops, count(*) FILTER (idx % 13 <> 0 AND idx % 17 = 0) AS duplicates, count(*) AS lines FROM cmd0")
def trace_classes(spark, sf):
    c = src.raw_commands(spark, sf)
    what = F.when(c.idx % 13 == 0, " drop(fault)").when(c.idx % 17 == 0, " duplicate(fault)").otherwise(" deliver")
    return faults.classify_trace(c.select(F.concat(F.lit("t="), c.us.cast("string"), what).alias("line")))


@query(""", g AS (SELECT client_id % 5 AS node, idx AS ord, CASE WHEN idx % 5 = 0 THEN idx // 100 - 1 ELSE idx // 100 END AS generation FROM cmd0)
SELECT node, ord, generation FROM (SELECT *, max(generation) OVER (PARTITION BY node ORDER BY ord) AS top FROM g) WHERE generation < top""")
def stale_ticks(spark, sf):
    c = src.raw_commands(spark, sf)
    gen = F.floor(c.idx / 100) - F.when(c.idx % 5 == 0, 1).otherwise(0)
    return faults.stale_ticks(c.select((c.client_id % 5).alias("node"), c.idx.alias("ord"), gen.cast("long").alias("generation")))


@query(""", w AS (SELECT client_id AS node, idx AS ord, 10 + idx % 7 AS bytes, idx % 4 = 0 AS synced FROM cmd0),
p AS (SELECT *, sum(CASE WHEN synced THEN 0 ELSE bytes END) OVER (PARTITION BY node ORDER BY ord) AS pending FROM w)
SELECT node, ord FROM p WHERE synced OR node % 3 = 0 OR pending <= node % 3 * 30""")
def crash_survivors(spark, sf):
    c = src.raw_commands(spark, sf)
    w = c.select(c.client_id.alias("node"), c.idx.alias("ord"), (10 + c.idx % 7).alias("bytes"), (c.idx % 4 == 0).alias("synced"))
    keep = F.when(F.col("node") % 3 == 0, -1).otherwise(F.col("node") % 3 * 30)
    return faults.crash_survivors(w, w.select("node").distinct().select("node", keep.alias("keep")))


@query(""", e AS (SELECT client_id % 5 AS node, op, idx AS ord, row_number() OVER (PARTITION BY client_id % 5, op ORDER BY idx) AS occurrence FROM cmd0)
SELECT node, op, occurrence, ord, 'before' AS point FROM e WHERE occurrence = (node + 1) * 3 AND op <> 'GET'""")
def fired_directives(spark, sf):
    c = src.raw_commands(spark, sf)
    e = c.select((c.client_id % 5).alias("node"), "op", c.idx.alias("ord"))
    d = spark.range(5).select(F.col("id").alias("node"), F.explode(F.array(F.lit("PUT"), F.lit("DELETE"))).alias("op"), ((F.col("id") + 1) * 3).alias("occurrence"), F.lit("before").alias("point"))
    return faults.fired_directives(e, d)


@query(""", m AS (SELECT client_id % 5 AS link, idx AS msg_id, us AS at FROM cmd0 WHERE op = 'GET'), k AS (SELECT client_id % 5 AS link, us AS at, op = 'PUT' AS opens FROM cmd0 WHERE op <> 'GET')
SELECT msg_id, NOT coalesce(opens, false) AS delivered FROM m ASOF LEFT JOIN k ON m.link = k.link AND m.at >= k.at""")
def message_delivery(spark, sf):
    c = src.raw_commands(spark, sf).withColumn("link", F.col("client_id") % 5)
    cuts = c.where("op <> 'GET'").select("link", F.col("us").alias("at"), F.col("idx").alias("ord"), (F.col("op") == "PUT").alias("opens"))
    return faults.deliverable(c.where("op = 'GET'").select(F.col("idx").alias("msg_id"), "link", F.col("us").alias("at")), cuts)


@query()
def generated_schedules(spark, sf):
    return faults.generate_schedules(spark, 100)


@query("SELECT 25::BIGINT AS least, 25::BIGINT AS most, 100::BIGINT AS seeds, 6::BIGINT AS pairs_least", raw=True)
def generated_schedule_shape(spark, sf):
    """25 events a schedule besides its two crashes' restarts, and six opened pairs."""
    s = faults.generate_schedules(spark, 100)
    per = s.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind").isin("partition", "partition-groups", "pause")).alias("pairs"))
    return per.agg((F.min("n") - 2).alias("least"), (F.max("n") - 2).alias("most"), F.count(F.lit(1)).alias("seeds"), F.min("pairs").alias("pairs_least"))


@query(""", m AS (SELECT idx, 1 + key % 2 AS a, 4 + key % 2 AS g, idx % 3 = 0 OR key = 0 AS s, client_id % 5 = 0 AS p, CASE WHEN key % 7 = 0 THEN upper(op) || '.json' ELSE lower(op) || '.json' END AS n FROM cmd0)
SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN a <> 1 THEN 'artifact version' END, CASE WHEN g <> 5 THEN 'generator version' END, CASE WHEN s THEN 'scripted seed' END,
  CASE WHEN p THEN 'pinned seed' END, CASE WHEN NOT regexp_full_match(n, '[a-z0-9-]+[.]json') THEN 'schedule name' END], lambda x: x IS NOT NULL)) AS rule FROM m) GROUP BY rule""")
def corpus_violations(spark, sf):
    """A corpus manifest a command; how often each rule is broken."""
    c = src.raw_commands(spark, sf)
    entry = lambda seed, name: F.struct(F.lit("x").alias("name"), seed.cast("long").alias("seed"), name.alias("schedule"))
    name = F.concat(F.when(c.key % 7 == 0, c.op).otherwise(F.lower(c.op)), F.lit(".json"))
    m = c.select(
        (1 + c.key % 2).alias("artifact_version"), (4 + c.key % 2).alias("generator_version"),
        F.array(entry(c.idx % 3, name), entry(c.key, name)).alias("scripted"), entry(c.client_id % 5, name).alias("pinned"),
    )
    return documents.corpus_violations(m).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# Benchmarks.


@query("""SELECT event_type, quantile_disc(k, 0.5) AS p50, quantile_disc(k, 0.95) AS p95, quantile_disc(k, 0.99) AS p99, max(k) AS max
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000 + event_id % 1000 AS k FROM events) GROUP BY event_type""", raw=True)
def latency_quantiles_nearest_rank(spark, sf):
    e = src.table(spark, sf, "events").withColumn("k", src.key_of().cast("long") * 1000 + F.col("event_id") % 1000)
    return benchmarks.nearest_rank(e, ["event_type"], "k")


@query("SELECT event_type, median(k) AS median, min(k) AS min, max(k) AS max FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type", raw=True)
def trial_median_min_max(spark, sf):
    return benchmarks.median_min_max(src.table(spark, sf, "events").withColumn("k", src.key_of().cast("long")), ["event_type"], "k")


WRITE_ROWS = "(1, 1, 65536, 2000, 59000000), (1, 1, 4194304, 2000, 4300000), (2, 1, 65536, 2000, 61000000), (1, 1, 65536, 2000, 0), (1, 9, 128, 1999, 5)"
AMP_ROWS = "(1, 1, 5000, 4500, 500, 656000, 2600000, 9000, 1000, 2290, 9187000, 57600, 146650, 175), (2, 2, 5000, 4000, 1000, 1, 0, 9000, 999, 2290, 9187000, 57601, 146650, -1)"
BLOOM_ROWS = "(1, 1, 1000, 100000, 10000, 7, 853, 0), (2, 2, 1000, 100000, 10000, 7, 790, 0), (1, 1, 10000, 100000, 100000, 7, 825, 0)"


def _rows(spark, values: str, schema: str) -> DataFrame:
    names = [p.split()[0] for p in schema.split(", ")]
    raw = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return raw.select(*[F.col(n).cast(p.split()[1]).alias(n) for n, p in zip(names, schema.split(", "))])


@query("""SELECT f AS flush_threshold_bytes, median(o) AS median, min(o) AS min, max(o) AS max
FROM (SELECT (65536 << ((o_custkey % 4) * 2)::INTEGER)::INTEGER AS f, (o_orderkey % 100000 + 1) * 1e9 / (round(o_totalprice * 100)::BIGINT + 1) AS o FROM orders) GROUP BY f""", raw=True)
def write_throughput(spark, sf):
    """Every order as a measured trial of one of four thresholds."""
    o = src.table(spark, sf, "orders")
    rows = o.select(
        F.element_at(F.array(*[F.lit(65536 << 2 * i) for i in range(4)]), (o.o_custkey % 4 + 1).cast("int")).alias("flush_threshold_bytes"),
        (o.o_orderkey % 100000 + 1).alias("operations"), (F.round(o.o_totalprice * 100).cast("long") + 1).alias("elapsed_ns"),
    )
    return benchmarks.throughput(rows)


@query("""SELECT l_suppkey AS trial, (sum(l_partkey) + sum(l_linenumber)) / sum(l_orderkey) AS write_amp, sum(l_partkey) / count(*) AS bytes_per_read, sum(l_linenumber) / count(*) AS calls_per_read,
 max(l_partkey) / (min(l_partkey) + 1) AS space_amp FROM lineitem GROUP BY l_suppkey""", raw=True)
def amplification(spark, sf):
    """A trial a supplier, with sums over its line items as counters."""
    li = src.table(spark, sf, "lineitem")
    rows = li.groupBy(li.l_suppkey.alias("trial")).agg(
        F.sum("l_partkey").alias("sstable_write_bytes"), F.sum("l_linenumber").alias("manifest_write_bytes"), F.sum("l_orderkey").alias("logical_user_write_bytes"),
        F.sum("l_partkey").alias("sstable_read_bytes"), F.sum("l_linenumber").alias("sstable_read_calls"), F.count(F.lit(1)).alias("read_operations"),
        F.max("l_partkey").alias("referenced_sstable_bytes"), (F.min("l_partkey") + 1).alias("logical_live_bytes"),
    )
    return benchmarks.amplification(rows)


@query(f"""SELECT c2 AS inserted_keys, sum(c6) / sum(c3) AS measured, round(pow(1 - exp(-7.0 * c2 / max(c4)), 7), 12) AS theory FROM (VALUES {BLOOM_ROWS}) t(c0, c1, c2, c3, c4, c5, c6, c7) GROUP BY c2""", raw=True)
def bloom_theory(spark, sf):
    return benchmarks.bloom_rates(_rows(spark, BLOOM_ROWS, schemas.BLOOM_ROW)).withColumn("theory", F.round("theory", 12))


@query("""SELECT h::INTEGER AS height, round(count(*) / (SELECT count(*) FROM orders), 12) AS measured, round(0.75 * pow(0.25, h - 1), 12) AS theory
FROM (SELECT 1 + o_orderkey % 4 AS h FROM orders) GROUP BY h""", raw=True)
def height_histogram(spark, sf):
    o = src.table(spark, sf, "orders")
    counts = F.array(*[F.count_if(F.col("o_orderkey") % 4 == i) for i in range(4)])
    h = benchmarks.heights(o.agg(F.count(F.lit(1)).alias("samples"), counts.alias("height_counts"))).where("measured > 0")
    return h.select("height", F.round("measured", 12).alias("measured"), F.round("theory", 12).alias("theory"))


@query("""WITH w AS (SELECT (o_custkey % 2 + 1)::INTEGER AS trial, (o_custkey % 3)::INTEGER AS seed, (65536 << (o_orderkey % 5 * 3)::INTEGER)::INTEGER AS f, 1998 + o_custkey % 4 AS n, o_orderkey % 9 AS ns, trial || '/' || f AS cell FROM orders),
want AS (SELECT unnest(['1/65536', '1/4194304']) AS cell)
SELECT rule, cell, count(*) AS n FROM (
  SELECT cell, unnest(list_filter([CASE WHEN trial <> 1 OR seed <> 1 THEN 'seed' END, CASE WHEN n <> 2000 THEN 'operations' END, CASE WHEN ns <= 0 THEN 'elapsed' END], lambda x: x IS NOT NULL)) AS rule FROM w
  UNION ALL SELECT cell, CASE WHEN want.cell IS NULL THEN 'unexpected cell' ELSE 'duplicate cell' END FROM (SELECT cell, count(*) AS n FROM w GROUP BY cell) h LEFT JOIN want USING (cell) WHERE want.cell IS NULL OR n > 1
  UNION ALL SELECT cell, 'missing cell' FROM want WHERE cell NOT IN (SELECT cell FROM w)) GROUP BY ALL""", raw=True)
def bench_matrix_violations(spark, sf):
    """Orders as rows of the write family, held to the smoke profile; how often each cell breaks each
    rule."""
    o = src.table(spark, sf, "orders")
    rows = o.select(
        (o.o_custkey % 2 + 1).cast("int").alias("trial"), (o.o_custkey % 3).cast("int").alias("seed"),
        F.element_at(F.array(*[F.lit(65536 << 3 * i) for i in range(5)]), (o.o_orderkey % 5 + 1).cast("int")).alias("flush_threshold_bytes"),
        (1998 + o.o_custkey % 4).cast("int").alias("operations"), (o.o_orderkey % 9).alias("elapsed_ns"),
    )
    return benchmarks.write_violations(rows, benchmarks.SMOKE).groupBy("rule", "cell").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT family, n FROM (VALUES ('write_throughput', 20), ('point_read', 80), ('bloom', 15), ('amplification', 5), ('compaction_pause', 5), ('skiplist', 5)) t(family, n)", raw=True)
def expected_bench_rows(spark, sf):
    return spark.createDataFrame(list(benchmarks.REPORT.expected_rows().items()), "family string, n int")


@query("SELECT event_id AS ord, user_id AS trial, (event_id // 10) > coalesce(lag(event_id // 10) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS compaction FROM events", raw=True)
def compaction_pause_classes(spark, sf):
    e = src.table(spark, sf, "events")
    rows = e.select(e.user_id.alias("trial"), e.event_id.alias("ord"), F.floor(e.event_id / 10).alias("compactions"))
    return benchmarks.pause_classes(rows).select("ord", "trial", "compaction")


@query("SELECT least(0.0, min(value)) AS lo, max(value) AS hi FROM events", raw=True)
def chart_bounds(spark, sf):
    return benchmarks.chart_bounds(src.table(spark, sf, "events"), "value")


@query("SELECT table_no, count(*) AS n, min(key) AS lo, max(key) AS hi FROM (SELECT i * 2 AS key, (i % 4)::INTEGER AS table_no FROM range(0, 4096) t(i)) GROUP BY table_no", raw=True)
def point_read_fixture(spark, sf):
    f = benchmarks.point_read_fixture(spark, 4, 1024)
    return f.groupBy("table_no").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))


@query("SELECT hit, n::BIGINT AS n FROM (VALUES (true, 500), (false, 500)) t(hit, n)", raw=True)
def amplification_read_split(spark, sf):
    live = src.table(spark, sf, "events").select((F.col("event_id") * 2 % 500).alias("key")).distinct()
    return benchmarks.sampled_reads(spark, 1000, 500, 50, live).groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rule FROM (VALUES ('profile'), ('collection time'), ('row counts')) t(rule)", raw=True)
def bench_document_violations(spark, sf):
    d = spark.sql("""SELECT 1 AS schema_version, 'other' AS profile, '2026-07-31 10:00' AS collected_at_utc, 'linux' AS os, 'arm64' AS arch, 8 AS cpus,
      map('bloom', 3) AS rows""")
    return benchmarks.document_violations(d)


@query("SELECT 3::BIGINT AS ops, 40::BIGINT AS per_client, 8::BIGINT AS keys, 4000::BIGINT AS n", raw=True)
def workload_shape(spark, sf):
    from . import campaign

    w = campaign.workload(spark, 20)
    return w.agg(F.count_distinct("op").alias("ops"), F.max("seq").alias("per_client"), F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("n"))


@query("SELECT 20::BIGINT AS seeds, 0::BIGINT AS failed, 4000::BIGINT AS operations", raw=True)
def seed_campaign(spark, sf):
    """Twenty seeds: every history has a linearization, and every run is evidence."""
    from . import campaign

    return campaign.aggregate(campaign.summaries(spark, 20)).select("seeds", "failed", "operations")


@query(""", h AS (SELECT id // 500 AS seed, * FROM oper),
pt AS (SELECT seed, invoke AS at, 1 AS d FROM h UNION ALL SELECT seed, ret, -1 FROM h WHERE ret IS NOT NULL),
lvl AS (SELECT seed, sum(d) OVER (PARTITION BY seed ORDER BY at, d DESC ROWS UNBOUNDED PRECEDING) AS l FROM pt),
hit AS (SELECT f.id // 500 AS seed, count(*) AS n FROM oper f WHERE op = 'DELETE' AND EXISTS (SELECT 1 FROM h WHERE h.seed = f.id // 500 AND h.invoke < f.invoke + 1 AND (h.ret IS NULL OR h.ret >= f.invoke + 1)) GROUP BY 1)
SELECT h.seed, count(*) AS logical, count(ret) AS completed, count(*) - count(ret) AS open, count(*) FILTER (op = 'PUT') AS puts, count(*) FILTER (op = 'GET') AS gets, count(*) FILTER (op = 'DELETE') AS deletes,
  sum(CASE WHEN ret IS NULL THEN 2 ELSE greatest(ret - 1 - invoke, 0) // 60000000 + 1 END)::BIGINT AS attempts, (SELECT max(l)::BIGINT FROM lvl WHERE lvl.seed = h.seed) AS max_concurrent,
  coalesce((SELECT n FROM hit WHERE hit.seed = h.seed), 0) AS faults_in_flight FROM h GROUP BY h.seed""")
def run_summaries(spark, sf):
    """The counters of a run, for histories of 500 operations: overlap, attempts (one a minute until
    the return), open operations, and errors as faults."""
    from . import campaign

    seed = F.floor(F.col("id") / 500).alias("seed")
    h = src.operations(spark, sf).select(seed, "id", "client_id", "op", "invoke", "ret")
    fired = h.where("op = 'DELETE'").select("seed", F.col("id").alias("ordinal"), (F.col("invoke") + 1).alias("at"))
    return campaign.summarise(h, campaign.attempts(h, 60_000_000), fired)


@query("""SELECT node, idx, term, CASE WHEN term IS NULL THEN 'beyond the log' ELSE 'held' END AS state FROM (SELECT unnest(range(0, 5)) AS node, idx FROM (SELECT idx + 100 AS idx FROM cmd0)) LEFT JOIN node_log USING (node, idx)""")
def log_term_at_index(spark, sf):
    """The term that each node's log has at an index, for as many indexes as there are entries."""
    c = src.raw_commands(spark, sf)
    asked = c.select(F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")).alias("node"), (c.idx + 100).alias("idx"))
    return consensus.term_at(asked, src.node_logs(spark, sf))


@query("SELECT node, max(idx) AS last_index, arg_max(term, idx) AS last_term FROM node_log GROUP BY node")
def log_last_term(spark, sf):
    return consensus.last_terms(src.node_logs(spark, sf))


# Functions.


@query("""SELECT event_id AS id, lower(lpad(hex(event_id), 32, '0')) AS k, repeat(lower(lpad(hex((event_id + user_id + 13) % 256), 2, '0')), 128) AS v,
  round(0.5 + 1.5 * (event_id % 100) / 100, 6) AS m, greatest(1, round(1000 / (0.5 + 1.5 * (event_id % 100) / 100)))::BIGINT AS delay,
  least(16, 1 + floor(ln((event_id % 997 + 0.5) / 1000) / ln(0.25)))::INTEGER AS height FROM events""", raw=True)
def fixed_keys_and_draws(spark, sf):
    """Fixed-width keys and values, skewed clocks and tower heights."""
    e = src.table(spark, sf, "events")
    m = scalars.clock_multiplier((e.event_id % 100) / 100)
    return e.select(
        e.event_id.alias("id"), F.lower(F.hex(scalars.fixed_key(e.event_id))).alias("k"), F.lower(F.hex(scalars.fixed_value(e.event_id, e.user_id))).alias("v"),
        F.round(m, 6).alias("m"), scalars.tick_delay(F.lit(1000), m).alias("delay"), scalars.tower_height((e.event_id % 997 + 0.5) / 1000).alias("height"),
    )


@query("SELECT count(*) AS n, 0::BIGINT AS repeated FROM (SELECT DISTINCT user_id, event_id % 5 FROM events)", raw=True)
def mixed_seeds(spark, sf):
    """Seeds of (seed, node) pairs: as many as pairs."""
    e = src.table(spark, sf, "events").select("user_id", (F.col("event_id") % 5).alias("node")).distinct()
    return e.select(scalars.mixed_seed(F.col("user_id"), F.col("node")).alias("s")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("s")).alias("repeated"))


@query("""SELECT event_id AS id, string_agg(lower(lpad(hex(CASE WHEN (n >> (7 * i)) > 127 THEN (n >> (7 * i)) % 128 + 128 ELSE n >> (7 * i) END), 2, '0')), '' ORDER BY i) AS b
FROM (SELECT event_id, event_id * 7919 AS n FROM events), range(0, 6) t(i) WHERE i = 0 OR (n >> (7 * i)) > 0 GROUP BY event_id""", raw=True)
def uvarint_rows(spark, sf):
    e = src.table(spark, sf, "events")
    return e.select(e.event_id.alias("id"), F.lower(F.hex(hashing.uvarint(e.event_id * 7919))).alias("b"))


@query("SELECT idx // 100 AS segment, idx % 100 AS ord, op || ' ' || key AS payload FROM cmd0")
def framed_log_round_trip(spark, sf):
    """The command log appended as framed segments of 100 records, and read back."""
    from ..sources import binary_log

    c = src.raw_commands(spark, sf)
    path = _work_dir(spark, "framed")
    binary_log.append_segments(c.select(F.floor(c.idx / 100).alias("segment"), c.idx.alias("ord"), F.concat_ws(" ", "op", "key").cast("binary").alias("payload")), path)
    return binary_log.read_appended(spark, path).select(F.col("segment").cast("long").alias("segment"), "ord", F.col("payload").cast("string").alias("payload"))


@query("""SELECT l_suppkey AS trial, 1::INTEGER AS seed, count(*)::INTEGER AS inserted_keys, sum(l_linenumber)::INTEGER AS probe_keys, sum(l_partkey) AS m_bits, 7::BIGINT AS k, 0::BIGINT AS false_positives, 0::BIGINT AS false_negatives
FROM lineitem GROUP BY l_suppkey""", raw=True)
def bench_document_round_trip(spark, sf):
    """Rows of a benchmark family written as JSON lines and read strictly."""
    li = src.table(spark, sf, "lineitem")
    rows = li.groupBy(li.l_suppkey.cast("int").alias("trial")).agg(
        F.lit(1).alias("seed"), F.count(F.lit(1)).cast("int").alias("inserted_keys"), F.sum("l_linenumber").cast("int").alias("probe_keys"), F.sum("l_partkey").alias("m_bits"),
        F.lit(7).cast("long").alias("k"), F.lit(0).cast("long").alias("false_positives"), F.lit(0).cast("long").alias("false_negatives"),
    )
    path = _work_dir(spark, "bench")
    documents.write_bench(rows, path)
    return documents.read_bench(spark, path, "bloom").withColumn("trial", F.col("trial").cast("long"))


@query(""", e AS (SELECT idx, client_id, op, CASE op WHEN 'PUT' THEN 'start' WHEN 'GET' THEN 'applied' ELSE 'deadline' END AS kind, row_number() OVER (PARTITION BY client_id ORDER BY idx) AS r FROM cmd0),
walk AS (SELECT client_id, idx, r, CASE WHEN kind = 'start' THEN 'waiting' ELSE 'idle' END AS phase, CASE WHEN kind = 'start' THEN 'submit' ELSE 'ignored' END AS action FROM e WHERE r = 1 UNION ALL
  SELECT e.client_id, e.idx, e.r,
    CASE WHEN w.phase = 'idle' AND e.kind = 'start' THEN 'waiting' WHEN w.phase = 'waiting' AND e.kind = 'applied' THEN 'idle' WHEN w.phase = 'waiting' AND e.kind = 'deadline' THEN 'retrying'
      WHEN w.phase = 'retrying' AND e.kind = 'start' THEN 'waiting' ELSE w.phase END,
    CASE WHEN w.phase = 'idle' AND e.kind = 'start' THEN 'submit' WHEN w.phase = 'waiting' AND e.kind = 'applied' THEN 'complete' WHEN w.phase = 'waiting' AND e.kind = 'deadline' THEN 'schedule-retry'
      WHEN w.phase = 'retrying' AND e.kind = 'start' THEN 'submit' ELSE 'ignored' END
  FROM walk w JOIN e ON e.client_id = w.client_id AND e.r = w.r + 1)
SELECT client_id, idx AS ord, action FROM walk""")
def stream_sessions(spark, sf):
    """The session automaton over a stream: PUTs start an operation (or retry one that waits for it),
    GETs apply what is in flight, errors are its deadline."""
    from ..streaming import sessions

    path = _work_dir(spark, "session-input")
    c = src.raw_commands(spark, sf)
    kind = F.when(c.op == "PUT", "start").when(c.op == "GET", "applied").otherwise("deadline")
    events = c.select("client_id", c.idx.alias("ord"), kind.alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("generation"))
    events.write.parquet(path)
    stream = spark.readStream.schema(sessions.SESSION_EVENT).parquet(path)
    return sessions.run_to_files(spark, sessions.session_automaton(stream), _work_dir(spark, "stream"), "append", _work_dir(spark, "checkpoint"))


@query("""SELECT event_id AS id, printf('%06d.sst', event_id) AS name, lower(hex(event_id)) AS k, lower(to_base(event_id, 36)) AS b36, greatest(1, event_id - 50) AS pos,
 replace(replace(event_type || '&<', '&', '&amp;'), '<', '&lt;') AS esc FROM events""", raw=True)
def scalar_functions(spark, sf):
    e = src.table(spark, sf, "events")
    i = e.event_id
    return e.select(
        i.alias("id"), scalars.file_name(i).alias("name"), F.lower(F.hex(i)).alias("k"), scalars.base36(i).alias("b36"),
        scalars.positive(i - 50).alias("pos"), scalars.xml_escape(F.concat("event_type", F.lit("&<"))).alias("esc"),
    )


@query("SELECT id, n::BIGINT AS n, ok FROM (VALUES (1, 12, true), (2, NULL, false), (3, NULL, false)) t(id, n, ok)", raw=True)
def file_name_checks(spark, sf):
    f = spark.sql("SELECT * FROM VALUES (1, '000012.sst'), (2, '12.sst'), (3, '../000012.sst') AS t(id, name)")
    return f.select("id", scalars.file_number(F.col("name")).alias("n"), scalars.valid_file_name(F.col("name")).alias("ok"))


@query("SELECT id, n, first FROM (VALUES (1, 2, 'a:1'), (2, NULL, NULL), (3, NULL, NULL), (4, NULL, NULL)) t(id, n, first)", raw=True)
def peer_lists(spark, sf):
    p = spark.sql("SELECT * FROM VALUES (1, '1=a:1,2=b:2'), (2, '1=a:1,1=b:2'), (3, '0=a:1'), (4, 'x') AS t(id, s)").withColumn("m", scalars.peers(F.col("s")))
    return p.select("id", F.when(F.col("m").isNotNull(), F.size("m")).alias("n"), F.try_element_at("m", F.lit(1).cast("long")).alias("first"))


@query("SELECT event_id AS id, props AS back FROM events", raw=True)
def nibble_round_trip(spark, sf):
    e = src.table(spark, sf, "events")
    return e.select(e.event_id.alias("id"), scalars.nibble_decode(scalars.nibble_encode(e.props.cast("binary"))).cast("string").alias("back"))


@query("SELECT id, s::BIGINT AS s, p::BIGINT AS p FROM (VALUES (1, 3, 2), (2, NULL, NULL)) t(id, s, p)", raw=True)
def checked_arithmetic(spark, sf):
    a = spark.sql("SELECT * FROM VALUES (1, 1L, 2L), (2, 9223372036854775807L, 2L) AS t(id, a, b)")
    return a.select("id", scalars.checked_add(F.col("a"), F.col("b")).alias("s"), scalars.checked_multiply(F.col("a"), F.col("b")).alias("p"))


@query("SELECT id, ok FROM (VALUES (1, true), (2, false), (3, false)) t(id, ok)", raw=True)
def utc_timestamps(spark, sf):
    t = spark.sql("SELECT * FROM VALUES (1, '2026-07-31T10:00:00Z'), (2, '2026-07-31T10:00:00+02:00'), (3, 'nowZ') AS t(id, x)")
    return t.select("id", scalars.is_utc_timestamp(F.col("x")).alias("ok"))


@query("""SELECT event_id, crc FROM (SELECT event_id, list_reduce(flatten(list_transform(range(1, length(props) + 1), lambda i: [ascii(props[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 2197175160) END, 4294967295::BIGINT) AS c, xor(c, 4294967295) AS crc FROM events)""", raw=True)
def crc32c_rows(spark, sf):
    return src.table(spark, sf, "events").select("event_id", hashing.crc32c(F.col("props").cast("binary")).alias("crc"))


@query("""SELECT event_id, printf('%016x', h::UBIGINT) AS h FROM (SELECT event_id, list_reduce(list_transform(range(1, length(props) + 1), lambda i: ascii(props[i])::HUGEINT),
  lambda a, x: (xor(a, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS h FROM events)""", raw=True)
def fnv1a_rows(spark, sf):
    return src.table(spark, sf, "events").select("event_id", hashing.fnv1a64(F.col("props").cast("binary")).alias("h"))


@query("SELECT count(*) AS keys, count(*) AS hits FROM (SELECT DISTINCT day || '.sst' AS file, key FROM cmd0 WHERE op <> 'GET')")
def bloom_membership(spark, sf):
    """Each run's filter holds each of the run's keys: no false negatives."""
    v = src.versions(spark, sf).select("file", F.col("key").cast("string").cast("binary").alias("k")).distinct()
    found = hashing.may_contain(v, hashing.bloom_filters(v, "file", "k"), "file", "k")
    return found.agg(F.count(F.lit(1)).alias("keys"), F.count_if("hit").alias("hits"))


# Store and streams.


@query(LATEST + "SELECT key::VARCHAR AS key, seq, value FROM w WHERE r = 1 AND NOT tombstone")
def store_flush_compact_read(spark, sf):
    """Eight flushes into a run store, compaction to the end, and a read: the latest state."""
    from .store import RunStore

    v = src.versions(spark, sf).select(F.col("key").cast("string").alias("key"), "seq", "value", "tombstone")
    store = RunStore(spark, _work_dir(spark, "store"))
    top = v.agg(F.max("seq")).first()[0] or 0
    store.flush(v, *[top * i // 8 for i in range(1, 9)])
    store.compact()
    return store.read().select("key", "seq", "value")


def _work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a temporary one in local mode only."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stratalog-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Files that each part of a stream's input is written in, and that one micro-batch takes: one, as
#: only whole parts arrive in log order.
STREAM_FILES = 1


def _stream_input(spark, sf, files: int = 4) -> str:
    path = _work_dir(spark, "stream-input")
    c = src.commands(spark, sf).select("idx", "client_id", "seq", "op", "key", "value")
    n = c.agg(F.max("idx")).first()[0] + 1
    for i in range(files):  # parts arrive in log order
        c.where((F.col("idx") >= n * i // files) & (F.col("idx") < n * (i + 1) // files)).repartition(STREAM_FILES).write.mode("append").parquet(path)
    return path


@query(LATEST + "SELECT key, seq, value, tombstone FROM w WHERE r = 1")
def stream_latest_state(spark, sf):
    from ..streaming import sessions

    stream = sessions.command_stream(spark, _stream_input(spark, sf), per_trigger=STREAM_FILES)
    return sessions.run_to_files(spark, sessions.live_state(stream), _work_dir(spark, "stream"), "complete", _work_dir(spark, "checkpoint"))


@query(DEDUP + "SELECT idx, client_id, seq, duplicate FROM flag")
def stream_exactly_once(spark, sf):
    from ..streaming import sessions

    stream = sessions.command_stream(spark, _stream_input(spark, sf), per_trigger=STREAM_FILES)
    return sessions.run_to_files(spark, sessions.exactly_once(stream), _work_dir(spark, "stream"), "append", _work_dir(spark, "checkpoint"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
