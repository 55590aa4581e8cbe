"""Replication checks as relations: votes, commit rule, leaders, log agreement, waiters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(n: int) -> int:
    return n // 2 + 1


def elected(votes: DataFrame, n: int) -> DataFrame:
    """(term, candidate) with votes of a majority of distinct voters."""
    return votes.groupBy("term", "candidate").agg(F.count_distinct("voter").alias("votes")).where(F.col("votes") >= majority(n))


def double_votes(votes: DataFrame) -> DataFrame:
    """Voters with more than one candidate in a term."""
    return votes.groupBy("term", "voter").agg(F.count_distinct("candidate").alias("candidates")).where("candidates > 1")


def commit_index(log: DataFrame, match: DataFrame, n: int, current_term: int, any_term: bool = False) -> DataFrame:
    """The greatest index that a majority holds *and* that is of the current term. The index a
    majority holds is one order statistic of the match table (a row a node), so the log is only
    filtered and reduced. any_term: the wrong rule, for negative controls."""
    held = match.orderBy(F.desc("match_index")).limit(majority(n)).agg(  # a row a node
        F.when(F.count(F.lit(1)) >= majority(n), F.min("match_index")).alias("held")
    )
    own = log if any_term else log.where(F.col("term") == current_term)
    return own.join(F.broadcast(held)).where("idx <= held").agg(F.coalesce(F.max("idx"), F.lit(0)).cast("long").alias("commit_index"))


def leaders_per_term(messages: DataFrame) -> DataFrame:
    """Terms with more than one leader. Leaders are the senders of append messages."""
    return messages.groupBy("term").agg(F.count_distinct("node").alias("leaders")).where("leaders > 1")


def leaderships(messages: DataFrame) -> DataFrame:
    return messages.groupBy("term").agg(F.array_sort(F.collect_set("node")).alias("nodes"))  # at most the cluster's nodes


def highest_term(messages: DataFrame) -> DataFrame:
    return messages.agg(F.coalesce(F.max("term"), F.lit(0)).alias("highest_term"))


def log_up_to_date(last_term: Column, last_index: Column, own_term: Column, own_index: Column) -> Column:
    """Whether a candidate's log is at least as up to date."""
    return (last_term > own_term) | ((last_term == own_term) & (last_index >= own_index))


def term_at(asked: DataFrame, logs: DataFrame) -> DataFrame:
    """node, idx, term (null beyond the log) and state of each index asked for. asked: node, idx;
    logs: node, idx, term."""
    state = F.when(F.col("term").isNull(), "beyond the log").otherwise("held")
    return asked.join(logs.select("node", "idx", "term"), ["node", "idx"], "left").select("node", "idx", "term", state.alias("state"))


def last_terms(logs: DataFrame) -> DataFrame:
    return logs.groupBy("node").agg(F.max("idx").alias("last_index"), F.max_by("term", "idx").alias("last_term"))


def log_matching(logs: DataFrame) -> DataFrame:
    """(left, right, first_difference, last_agreement) of pairs of nodes whose logs agree in term at
    or above an index at which they differ: a violation of log matching. logs: node, idx, term, data.

    Entries are aggregated by index first. Indexes at which all that have one have the same entry
    (nearly all) only tell where pairs agree, and are combined by the set of nodes; entries are
    joined with one another only at the others."""
    at = logs.select("idx", "node", "term", F.xxhash64("term", "data").alias("h"))
    per = at.groupBy("idx").agg(F.sort_array(F.collect_set("node")).alias("nodes"), (F.min("h") != F.max("h")).alias("mixed"))  # at most the cluster's nodes
    same = per.where("NOT mixed").groupBy("nodes").agg(F.max("idx").alias("idx"))
    same = same.select("idx", "nodes", F.explode("nodes").alias("left")).select("idx", "left", F.explode("nodes").alias("right")).where("left < right")
    some = at.join(per.where("mixed").select("idx"), "idx", "left_semi")
    pairs = some.alias("l").join(some.alias("r"), (F.col("l.idx") == F.col("r.idx")) & (F.col("l.node") < F.col("r.node")))
    pairs = pairs.select(
        F.col("l.idx").alias("idx"), F.col("l.node").alias("left"), F.col("r.node").alias("right"),
        (F.col("l.term") == F.col("r.term")).alias("same_term"), (F.col("l.h") != F.col("r.h")).alias("differs"),
    ).unionByName(same.select("idx", "left", "right", F.lit(True).alias("same_term"), F.lit(False).alias("differs")))
    return pairs.groupBy("left", "right").agg(
        F.min(F.when(F.col("differs"), F.col("idx"))).alias("first_difference"), F.max(F.when(F.col("same_term"), F.col("idx"))).alias("last_agreement")
    ).where("last_agreement >= first_difference")


def leader_hints(messages: DataFrame) -> DataFrame:
    """The last leader that each node has heard of, per message."""
    w = Window.partitionBy("node").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("hint", F.last("leader", ignorenulls=True).over(w))


def fulfilled(waiters: DataFrame, applied: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """Outcome of each waiter (idx, term): applied if its index was applied with its term, stale if
    with another, pending otherwise. Cancelled waiters are left out."""
    if cancelled is not None:
        waiters = waiters.join(cancelled.select("idx", "term"), ["idx", "term"], "left_anti")
    outcome = F.when(F.col("own").isNull(), "pending").when(F.col("own") == F.col("term"), "applied").otherwise("stale")
    return waiters.join(applied.select("idx", F.col("term").alias("own")), "idx", "left").select("idx", "term", outcome.alias("outcome"))


def attempts(attempted: DataFrame, applied: DataFrame) -> DataFrame:
    """As fulfilled, per node: an attempt whose index was applied with another term has lost its
    leader."""
    outcome = F.when(F.col("own").isNull(), "pending").when(F.col("own") == F.col("term"), "applied").otherwise("leadership-lost")
    own = applied.select("node", "idx", F.col("term").alias("own"))
    return attempted.join(own, ["node", "idx"], "left").select("node", "idx", "term", outcome.alias("outcome"))


def terms_without_noop(log: DataFrame) -> DataFrame:
    """Terms that don't start with a no-op of their leader."""
    first = log.groupBy("term").agg(F.min_by("type", "idx").alias("type"), F.min("idx").alias("idx"))
    return first.where("type <> 'NOOP'").select("term", "idx")
