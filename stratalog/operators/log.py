"""Replicated-log operators: exactly-once sessions, as-of reads, write-ahead-log replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import least_later

OPS = ("PUT", "DELETE", "GET")


def invalid_commands(rows: DataFrame) -> DataFrame:
    """Commands with no client, no sequence or an operation that is none."""
    reason = (
        F.when(F.coalesce("client_id", F.lit(0)) == 0, "client_id is zero")
        .when(F.coalesce("seq", F.lit(0)) <= 0, "seq is not positive")
        .when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), "unknown op")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL")


def _client() -> Window:
    return Window.partitionBy("client_id").orderBy("idx")


def dedup_flags(rows: DataFrame) -> DataFrame:
    """``duplicate``: the sequence is not above all earlier ones of the client, in log order. No-ops
    are left out. Equivalent to keeping the last accepted sequence, since accepted ones rise."""
    before = F.max("seq").over(_client().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("duplicate", F.coalesce(F.col("seq") <= before, F.lit(False)))


def accepted(rows: DataFrame) -> DataFrame:
    return dedup_flags(rows).where("NOT duplicate").drop("duplicate")


def asof_reads(rows: DataFrame) -> DataFrame:
    """idx, key, found, value of each GET: the last mutation of its key at a lower index."""
    last = F.last(F.when(F.col("op") != "GET", F.struct("op", "value")), ignorenulls=True).over(
        Window.partitionBy("key").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    )
    found = F.coalesce(F.col("m.op") == "PUT", F.lit(False))
    return rows.withColumn("m", last).where("op = 'GET'").select(
        "idx", "client_id", "key", found.alias("found"), F.when(found, F.col("m.value")).alias("result")
    )


def results(rows: DataFrame) -> DataFrame:
    """idx, client_id, duplicate, found, result of every command: a duplicate is answered with its
    client's latest cached result, whatever sequence it retries."""
    flags = dedup_flags(rows)
    live = flags.where("NOT duplicate")
    reads = asof_reads(live).select("idx", F.struct("found", "result").alias("r"))
    blank = F.struct(F.lit(False).alias("found"), F.lit(None).cast("double").alias("result"))
    answered = flags.join(reads, "idx", "left").withColumn("own", F.when(~F.col("duplicate"), F.coalesce("r", blank)))
    cached = F.last("own", ignorenulls=True).over(_client().rowsBetween(Window.unboundedPreceding, 0))
    return answered.withColumn("c", cached).select("idx", "client_id", "duplicate", F.col("c.found").alias("found"), F.col("c.result").alias("result"))


def session_table(rows: DataFrame) -> DataFrame:
    """The last accepted sequence of each client and the index it came with."""
    return accepted(rows).groupBy("client_id").agg(F.max("seq").alias("last_seq"), F.max_by("idx", "seq").alias("at_index"))


def replay_mode(rows: DataFrame, ceiling: int) -> DataFrame:
    return rows.withColumn("replayed", F.col("idx") <= ceiling)


def gaps(rows: DataFrame, order: str = "idx", by: str | None = None) -> DataFrame:
    """Places where an index does not follow its predecessor. With ``by``, per group; without it
    the check is an aggregate over index pairs, not a global window."""
    if by:
        before = F.lag(order).over(Window.partitionBy(by).orderBy(order))
        return rows.withColumn("before", before).where(F.col(order) - F.col("before") != 1)
    follows = rows.select((F.col(order) + 1).alias(order))
    lowest = rows.agg(F.min(order).alias("lowest"))
    return rows.join(follows, order, "left_anti").join(F.broadcast(lowest)).where(F.col(order) > F.col("lowest")).drop("lowest")


def first_last(rows: DataFrame, idx: str = "idx") -> DataFrame:
    """(1, 0) for an empty log."""
    return rows.agg(F.coalesce(F.min(idx), F.lit(1)).cast("long").alias("first_index"), F.coalesce(F.max(idx), F.lit(0)).cast("long").alias("last_index"))


def entries_between(rows: DataFrame, lo: int, hi: int, idx: str = "idx") -> DataFrame:
    return rows.where((F.col(idx) >= lo) & (F.col(idx) < hi))


def wal_survivors(wal: DataFrame) -> DataFrame:
    """Entries that later records don't cut off. A truncation cuts from its index; so does a record
    of entries from its first. Decided per record, before entries are exploded, with the least cut
    of all later records; a task has one segment."""
    return (
        least_later(wal, [], F.col("segment"), ["ord"], "from_index", "cut")
        .where("kind = 'entries'")
        .select("ord", "cut", F.inline("entries"))
        .where("cut IS NULL OR cut > index")
        .drop("cut")
    )


def torn_tail(frames: DataFrame) -> DataFrame:
    """segment, ord, verdict of frames that don't end: the last of the last segment is dropped, any
    other is corruption."""
    last = frames.agg(F.max(F.struct("segment", "ord")).alias("last"))
    verdict = F.when(F.struct("segment", "ord") == F.col("last"), "drop").otherwise("corrupt")
    return frames.where("NOT terminated").join(F.broadcast(last)).select("segment", "ord", verdict.alias("verdict"))


def segment_gaps(segments: DataFrame) -> DataFrame:
    """Segment numbers that are not 1, 2, 3, ...: each must follow one that exists."""
    s = segments.select("segment").distinct()
    return s.where("segment > 1").join(s.select((F.col("segment") + 1).alias("segment")), "segment", "left_anti")


def conflict_append(local: DataFrame, leader: DataFrame) -> DataFrame:
    """The log after the leader's entries: local below the first index that differs or is missing,
    the leader's from there on. Entries: idx, term."""
    first = (
        leader.join(local.select("idx", F.col("term").alias("own")), "idx", "left")
        .where("own IS NULL OR own <> term")
        .agg(F.min("idx").alias("c"))
    )
    kept = local.join(F.broadcast(first)).where("c IS NULL OR idx < c").select("idx", "term", F.lit("local").alias("origin"))
    taken = leader.join(F.broadcast(first)).where("idx >= c").select("idx", "term", F.lit("leader").alias("origin"))
    return kept.unionByName(taken)


def ready_batch(log: DataFrame, stable: int, applied: int, commit: int) -> DataFrame:
    """What the next batch persists and applies."""
    return log.where((F.col("idx") > stable) | ((F.col("idx") > applied) & (F.col("idx") <= commit))).select(
        "idx", (F.col("idx") > stable).alias("unstable"), ((F.col("idx") > applied) & (F.col("idx") <= commit)).alias("newly_committed")
    )


def op_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def effective_term(envelope: Column, body: Column) -> Column:
    return F.greatest(envelope, body)
