"""Commands, runs, manifests, write-ahead logs and histories derived from the event table.

Each derivation has a DuckDB twin, so that a query and its SQL see the same input.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def key_of() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, client_id, op, key, value, day: without the client sequence, which needs a window."""
    op = (
        F.when(F.col("event_type").isin("purchase", "signup"), "PUT")
        .when(F.col("event_type") == "error", "DELETE")
        .otherwise("GET")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"),
        F.col("user_id").alias("client_id"),
        op.alias("op"),
        key_of().alias("key"),
        "value",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_commands with seq: 1, 2, ... per client, every fourth falling back by two."""
    rn = F.row_number().over(Window.partitionBy("client_id").orderBy("idx"))
    return raw_commands(spark, sf_dir).withColumn("rn", rn).withColumn(
        "seq", (F.col("rn") - F.when(F.col("rn") % 4 == 0, 2).otherwise(0)).cast("long")
    ).drop("rn")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seq, value, tombstone, file (a day is a run): the mutations."""
    return raw_commands(spark, sf_dir).where("op <> 'GET'").select(
        "key", F.col("idx").alias("seq"),
        F.when(F.col("op") == "PUT", F.col("value")).alias("value"),
        (F.col("op") == "DELETE").alias("tombstone"),
        F.concat("day", F.lit(".sst")).alias("file"),
    )


def item_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as versions: (order, line) is (key, seq), and it repeats with other payloads."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("seq"),
        F.col("l_partkey").alias("value"), (F.col("l_returnflag") == "R").alias("tombstone"),
        F.col("l_linestatus").alias("file"),
    )


def manifest_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, action (add or remove), file, flushed_index, in long form: each day adds its run; every
    fourth day removes the last four and adds their merge."""
    days = versions(spark, sf_dir).groupBy("file").agg(F.max("seq").alias("top"), F.count(F.lit(1)).alias("n"))
    days = days.withColumn("d", F.row_number().over(Window.orderBy("file")).cast("long"))  # a row a day
    group = F.floor((F.col("d") - 1) / 4).cast("long")
    full = F.max("d").over(Window.partitionBy(group)) % 4 == 0
    days = days.withColumn("g", group).withColumn("full", full)
    added = days.select((F.col("d") * 2).alias("ord"), F.lit("add").alias("action"), "file", F.col("top").alias("flushed_index"))
    removed = days.where("full").select(
        (F.col("g") * 8 + 9).alias("ord"), F.lit("remove").alias("action"), "file", F.lit(None).cast("long").alias("flushed_index")
    )
    merged = days.where("full").groupBy("g").agg(F.lit("add").alias("action")).select(
        (F.col("g") * 8 + 9).alias("ord"), "action", F.format_string("merged-%06d.sst", F.col("g")).alias("file"),
        F.lit(None).cast("long").alias("flushed_index"),
    )
    return added.unionByName(removed).unionByName(merged)


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment, ord, kind (entries or truncate), from_index, entries: a record holds one to three
    entries; every 50th cuts the log back by five."""
    e = raw_commands(spark, sf_dir).select("idx", "client_id")
    cut = F.col("idx") % 50 == 49
    kind = F.when(cut, "truncate").otherwise("entries")
    count = F.col("idx") % 3 + 1
    entries = F.transform(
        F.sequence(F.col("idx"), F.col("idx") + count - 1),
        lambda i: F.struct(i.alias("index"), F.floor(F.col("idx") / 500).cast("long").alias("term")),
    )
    return e.select(
        F.floor(F.col("idx") / 100).cast("int").alias("segment"), F.col("idx").alias("ord"), kind.alias("kind"),
        F.when(cut, F.col("idx") - 5).otherwise(F.col("idx")).alias("from_index"), F.when(~cut, entries).alias("entries"),
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, client_id, op, key, value, invoke, ret: a client's operation lasts until just before its
    next; the last is open (null)."""
    w = Window.partitionBy("client_id").orderBy("idx")
    return raw_commands(spark, sf_dir).select(
        F.col("idx").alias("id"), "client_id", "op", "key", "value", F.col("us").alias("invoke"),
        (F.lead("us").over(w) - 1).alias("ret"),
    )


def node_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, idx, term, data: five nodes' copies of the event log; node 4 lacks the last tenth,
    node 3 has another term at every thousandth index from the middle on."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("event_type").alias("data"))
    n = e.select(F.count(F.lit(1)).alias("n"))
    term = F.floor(F.col("idx") / 250).cast("long")
    return (
        e.join(F.broadcast(n))  # one row
        .select(F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")).alias("node"), "idx", "data", "n")
        .where("NOT (node = 4 AND idx * 10 >= n * 9)")
        .select("node", "idx", F.when((F.col("node") == 3) & (F.col("idx") % 1000 == 999) & (F.col("idx") * 2 >= F.col("n")), term + 1).otherwise(term).alias("term"), "data")
    )


CTE = """
cmd0 AS (
  SELECT event_id AS idx, user_id AS client_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'PUT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'GET' END AS op,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS key, value, strftime(ts, '%Y-%m-%d') AS day,
         epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
  FROM events),
cmd AS (SELECT idx, client_id, op, key, value, day, us, rn - CASE WHEN rn % 4 = 0 THEN 2 ELSE 0 END AS seq FROM cmd0),
ver AS (
  SELECT key, idx AS seq, CASE WHEN op = 'PUT' THEN value END AS value, op = 'DELETE' AS tombstone, day || '.sst' AS file
  FROM cmd WHERE op <> 'GET'),
item AS (
  SELECT l_orderkey AS key, l_linenumber::BIGINT AS seq, l_partkey AS value, l_returnflag = 'R' AS tombstone,
         l_linestatus AS file FROM lineitem),
days0 AS (SELECT file, max(seq) AS top, count(*) AS n FROM ver GROUP BY file),
days1 AS (SELECT *, row_number() OVER (ORDER BY file) AS d FROM days0),
days AS (SELECT *, (d - 1) // 4 AS g, max(d) OVER (PARTITION BY (d - 1) // 4) % 4 = 0 AS f FROM days1),
edit AS (
  SELECT d * 2 AS ord, 'add' AS action, file, top AS flushed_index FROM days
  UNION ALL SELECT g * 8 + 9, 'remove', file, NULL FROM days WHERE f
  UNION ALL SELECT g * 8 + 9, 'add', printf('merged-%06d.sst', g), NULL FROM (SELECT DISTINCT g FROM days WHERE f)),
wal AS (
  SELECT (idx // 100)::INTEGER AS segment, idx AS ord, CASE WHEN idx % 50 = 49 THEN 'truncate' ELSE 'entries' END AS kind,
         CASE WHEN idx % 50 = 49 THEN idx - 5 ELSE idx END AS from_index, idx % 3 + 1 AS n, idx // 500 AS term FROM cmd0),
oper AS (
  SELECT idx AS id, client_id, op, key, value, us AS invoke, lead(us) OVER (PARTITION BY client_id ORDER BY idx) - 1 AS ret FROM cmd0),
node_log AS (
  SELECT node, idx, CASE WHEN node = 3 AND idx % 1000 = 999 AND idx * 2 >= n THEN idx // 250 + 1 ELSE idx // 250 END AS term, data
  FROM (SELECT event_id AS idx, event_type AS data, count(*) OVER () AS n FROM events),
       (SELECT unnest(range(0, 5)) AS node)
  WHERE NOT (node = 4 AND idx * 10 >= n * 9))
"""


def with_cte(sql: str) -> str:
    """A query over the derived tables. ``at`` is a keyword of DuckDB and is quoted."""
    return "WITH " + CTE.strip() + "\n" + re.sub(r"\bat\b", '"at"', sql)
