"""A seed campaign: workload and faults per seed, a simulated history, its check, one summary.

Every seed is independent and every draw is a hash of (seed, client, number), so any partitioning
gives the same history. Consensus itself is not simulated: commands take effect at one point
between their call and their return, as replication promises, and the check must confirm that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import base36
from ..operators import faults, history

OPS = ("PUT", "GET", "DELETE")


def draw(n: int, *of) -> Column:
    """A number below n, a function of its arguments only."""
    return F.pmod(F.xxhash64(*of), F.lit(n))


def workload(spark: SparkSession, seeds: int, clients: int = 5, operations: int = 40, keys: int = 8) -> DataFrame:
    """seed, client_id, seq, op, key, value of every operation of every seed."""
    rows = spark.range(seeds * clients * operations)
    per = clients * operations
    rows = rows.select(
        F.floor(F.col("id") / per).alias("seed"), (F.floor(F.col("id") / operations) % clients + 1).alias("client_id"),
        (F.col("id") % operations + 1).alias("seq"),
    )
    names = F.array(*[F.lit(o) for o in OPS])
    return rows.select(
        "*", F.element_at(names, (draw(3, "seed", "client_id", "seq", F.lit("op")) + 1).cast("int")).alias("op"),
        draw(keys, "seed", "client_id", "seq", F.lit("key")).alias("key"),
        base36(draw(1 << 40, "seed", "client_id", "seq", F.lit("value"))).alias("value"),
    )


def histories(spark: SparkSession, seeds: int, break_reads: bool = False) -> DataFrame:
    """seed, id, client_id, seq, op, key, in_value, out_value, found, ok, unknown, invoke, ret. Each
    operation takes effect at a random point of its interval; reads see the last effect before
    their own. One operation in fifty never returns. break_reads: reads miss the last write, for
    negative controls."""
    w = workload(spark, seeds)
    lasts = draw(90, "seed", "client_id", "seq", F.lit("lasts")) + 3
    by_client = Window.partitionBy("seed", "client_id").orderBy("seq")
    w = w.withColumn("lasts", lasts).withColumn("ends", F.sum(F.col("lasts") + 7).over(by_client))
    w = w.withColumn("invoke", F.col("ends") - F.col("lasts")).withColumn("effect", F.col("invoke") + draw(1 << 30, "seed", "client_id", "seq", F.lit("at")) % F.col("lasts"))
    by_key = Window.partitionBy("seed", "key").orderBy("effect", "client_id").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("op") != "GET", F.struct("op", "value")), ignorenulls=True).over(by_key)
    if break_reads:
        state = F.first(F.when(F.col("op") != "GET", F.struct("op", "value")), ignorenulls=True).over(by_key)
    found = (F.col("op") == "GET") & F.coalesce(F.col("state.op") == "PUT", F.lit(False))
    open_ = draw(50, "seed", "client_id", "seq", F.lit("open")) == 0
    return w.withColumn("state", state).select(
        "seed", F.xxhash64("seed", "client_id", "seq").alias("id"), "client_id", "seq", "op", "key",
        F.when(F.col("op") == "PUT", F.col("value")).alias("in_value"), F.when(found, F.col("state.value")).alias("out_value"), found.alias("found"),
        (~open_).alias("ok"), open_.alias("unknown"), "invoke", F.when(~open_, F.col("ends")).alias("ret"),
    )


def attempts(h: DataFrame, every: int = 40) -> DataFrame:
    """seed, id, at of each physical attempt: the first at the call, one more for each ``every`` until
    the return; an operation that never returns is tried once more."""
    last = F.coalesce(F.when(F.col("ret").isNotNull(), F.greatest(F.col("ret") - 1, F.col("invoke"))), F.col("invoke") + every)
    return h.select("seed", "id", F.explode(F.sequence("invoke", last, F.lit(every).cast("long"))).alias("at"))


def summarise(h: DataFrame, tried: DataFrame, fired: DataFrame) -> DataFrame:
    """One row a seed: counters of a run. h: seed, client_id, op, invoke, ret (null: open); tried: seed,
    a row an attempt; fired: seed, ordinal, at of the faults that degrade the system. A fault is in
    flight if it catches an operation that began before it and has not returned before it;
    max_concurrent is the most clients in flight at once, closed intervals. Seeds are independent
    and each is small, so windows and joins are by seed."""
    hit = fired.join(h.select("seed", "invoke", "ret"), "seed").where("invoke < at AND (ret IS NULL OR ret >= at)")
    hits = hit.groupBy("seed").agg(F.count_distinct("ordinal").alias("faults_in_flight"))
    points = h.select("seed", F.inline(F.array(
        F.struct(F.col("invoke").alias("at"), F.lit(1).alias("d")), F.struct(F.col("ret").alias("at"), F.lit(-1).alias("d"))
    ))).where("at IS NOT NULL")
    level = F.sum("d").over(Window.partitionBy("seed").orderBy("at", F.desc("d")).rowsBetween(Window.unboundedPreceding, 0))
    most = points.withColumn("level", level).groupBy("seed").agg(F.max("level").alias("max_concurrent"))
    counts = h.groupBy("seed").agg(
        F.count(F.lit(1)).alias("logical"), F.count("ret").alias("completed"), F.count_if(F.col("ret").isNull()).alias("open"),
        *[F.count_if(F.col("op") == o).alias(f"{o.lower()}s") for o in OPS],
    )
    rows = counts.join(tried.groupBy("seed").agg(F.count(F.lit(1)).alias("attempts")), "seed", "left").join(most, "seed", "left").join(hits, "seed", "left")
    return rows.fillna(0, ["attempts", "max_concurrent", "faults_in_flight"])


def summaries(spark: SparkSession, seeds: int, break_reads: bool = False) -> DataFrame:
    """One row a seed: counters, verdict and what keeps the run from being evidence."""
    h = histories(spark, seeds, break_reads)
    verdicts = history.linearizable_per_key(h.withColumn("key", F.concat_ws("/", "seed", "key")))
    bad = verdicts.groupBy(F.split("key", "/")[0].cast("long").alias("seed")).agg(F.count_if(F.col("verdict") != "ok").alias("bad_keys"))
    events = faults.generate_schedules(spark, seeds)
    kind = (F.col("kind"), F.col("rate"), F.col("multiplier"))
    fired = events.where(faults.injected(*kind)).select(F.col("seed"), "ordinal", F.col("time").alias("at"))
    rows = summarise(h, attempts(h), fired).join(bad, "seed", "left").fillna(0, ["bad_keys"])
    rows = rows.join(faults.vacuity_failures(rows), "seed")
    return rows.withColumn("failed", (F.col("bad_keys") > 0) | (F.col("failures") != ""))


def aggregate(rows: DataFrame) -> DataFrame:
    return faults.batch_aggregate(rows.withColumn("operations", F.col("logical")))
