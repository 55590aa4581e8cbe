"""Fault schedules: validation, state in force, coverage, crash survivors, generation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .order import least_later

#: Fault kinds and crash points of a schedule, numbered from 1.
FAULT_KINDS = (
    "drop-rate", "duplicate-rate", "partition", "heal", "partition-groups", "heal-groups",
    "pause", "resume", "clock-skew", "crash", "restart",
)
CRASH_POINTS = ("before-sync", "after-sync-before-send", "after-send")
VERSIONS = (0, 5)
MIN_MULTIPLIER, MAX_MULTIPLIER = 0.5, 2.0
RETAIN_ALL = -1
#: Fixed floors below which a run proves nothing.
MIN_LOGICAL, MIN_COMPLETED = 150, 120


def kind_name(kind: Column) -> Column:
    names = F.array(*[F.lit(k) for k in FAULT_KINDS])
    return F.coalesce(F.try_element_at(names, F.when(kind > 0, kind)), F.format_string("faultkind(%d)", kind))


def events(schedules: DataFrame) -> DataFrame:
    """seed, ordinal and fields of every event. schedules: seed, s (a parsed schedule)."""
    return schedules.select("seed", F.posexplode("s.Events").alias("ordinal", "e")).select("seed", "ordinal", "e.*")


def schedule_violations(schedules: DataFrame, nodes: list[int] | None = None) -> DataFrame:
    """seed, part, ordinal, rule of everything a schedule must not hold."""
    e = events(schedules)
    members = F.flatten("Groups")
    finite = lambda c: ~(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")))
    named = F.filter(F.concat(F.array("Node", "From", "To"), F.coalesce(members, F.array().cast("array<bigint>"))), lambda x: x > 0)
    rules = [
        ("negative time", F.col("Time") < 0),
        ("unknown kind", ~F.col("Kind").between(1, len(FAULT_KINDS))),
        ("rate outside [0, 1]", F.col("Kind").isin(1, 2) & ~(finite("Rate") & F.col("Rate").between(0, 1))),
        ("multiplier outside bounds", (F.col("Kind") == 9) & ~(finite("Multiplier") & F.col("Multiplier").between(MIN_MULTIPLIER, MAX_MULTIPLIER))),
        ("from equals to", F.col("Kind").isin(3, 4) & (F.col("From") == F.col("To"))),
        ("fewer than two groups", F.col("Kind").isin(5, 6) & (F.coalesce(F.size("Groups"), F.lit(0)) < 2)),
        ("empty group", F.col("Kind").isin(5, 6) & F.exists("Groups", lambda g: F.size(g) == 0)),
        ("node in two groups", F.col("Kind").isin(5, 6) & (F.size(members) != F.size(F.array_distinct(members)))),
    ]
    if nodes is not None:
        rules.append(("unknown node", F.size(F.array_except(named, F.array(*[F.lit(n).cast("long") for n in nodes]))) > 0))
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    out = e.select("seed", F.lit("event").alias("part"), "ordinal", F.explode(found).alias("rule"))
    version = schedules.where(~F.coalesce(F.col("s.Version"), F.lit(0)).isin(*VERSIONS)).select(
        "seed", F.lit("schedule").alias("part"), F.lit(-1).alias("ordinal"), F.lit("unsupported version").alias("rule")
    )
    c = schedules.select("seed", F.posexplode("s.Crashes").alias("ordinal", "c")).select("seed", "ordinal", "c.*")
    twice = F.row_number().over(Window.partitionBy("seed", "Node", "Save").orderBy("ordinal")) > 1
    crash_rules = [
        ("ordinals are 1-based", F.col("Save") <= 0),
        ("non-schedulable point", ~F.col("Point").between(1, len(CRASH_POINTS))),
        ("retention below minimum", F.col("RetainUnsynced") < RETAIN_ALL),
        ("duplicate directive", F.col("twice")),
    ]
    found = F.filter(F.array(*[F.when(x, F.lit(n)) for n, x in crash_rules]), lambda x: x.isNotNull())
    crash = c.withColumn("twice", twice).select("seed", F.lit("crash").alias("part"), "ordinal", F.explode(found).alias("rule"))
    l = schedules.select("seed", F.posexplode("s.LSMCrashes").alias("ordinal", "c")).select("seed", "ordinal", "c.*")
    twice = F.row_number().over(Window.partitionBy("seed", "Node", "Op", "Occurrence").orderBy("ordinal")) > 1
    fs_rules = [
        ("empty operation", F.coalesce(F.col("Op"), F.lit("")) == ""),
        ("ordinals are 1-based", F.col("Occurrence") <= 0),
        ("retention below minimum", F.col("RetainUnsynced") < RETAIN_ALL),
        ("duplicate directive", F.col("twice")),
    ]
    found = F.filter(F.array(*[F.when(x, F.lit(n)) for n, x in fs_rules]), lambda x: x.isNotNull())
    fs = l.withColumn("twice", twice).select("seed", F.lit("fs-crash").alias("part"), "ordinal", F.explode(found).alias("rule"))
    return out.unionByName(version).unionByName(crash).unionByName(fs)


def neutral(kind: Column, rate: Column, multiplier: Column) -> Column:
    """Events that restore the baseline."""
    return F.when(kind.isin("drop-rate", "duplicate-rate"), rate == 0).when(kind == "clock-skew", multiplier == 1).otherwise(False)


def injected(kind: Column, rate: Column, multiplier: Column) -> Column:
    """Events that degrade the system."""
    return (
        F.when(kind.isin("drop-rate", "duplicate-rate"), rate > 0)
        .when(kind == "clock-skew", multiplier != 1)
        .otherwise(kind.isin("partition", "partition-groups", "pause", "crash"))
    )


def directives_for(crashes: DataFrame, node: int) -> DataFrame:
    return crashes.where(F.col("Node") == node).orderBy("ordinal")


def in_force(probes: DataFrame, settings: DataFrame, by: str = "target") -> DataFrame:
    """The value in force at each probe: the last setting of its target at or before its time, by
    one window per target. probes: by, probe_id, at; settings: by, ord, at, v."""
    marks = settings.select(by, "at", F.lit(0).alias("o"), "ord", "v", F.lit(None).cast("long").alias("probe_id")).unionByName(
        probes.select(by, "at", F.lit(1).alias("o"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("double").alias("v"), "probe_id")
    )
    w = Window.partitionBy(by).orderBy("at", "o", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("in_force", F.last("v", ignorenulls=True).over(w)).where("o = 1").select("probe_id", "in_force")


def open_intervals(rows: DataFrame, width: int = 600_000_000) -> DataFrame:
    """target, opened, closed of each opening event: until the next closing one of its target, null
    if there is none. A task has one target's events of one time bucket; an event without a time
    comes last. rows: target, at, ord, opens."""
    closes = rows.withColumn("closes", F.when(~F.col("opens"), F.col("at")))
    closed = least_later(closes, ["target"], F.floor(F.col("at") / width), ["at", "ord"], "closes", "closed")
    return closed.where("opens").select("target", F.col("at").alias("opened"), "closed")


def normalized_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with their endpoints dealt anew, so that no two overlap: the i-th pair of a seed gets
    the endpoints 2i and 2i + 1 in order of time. pairs: seed, i (from 0), a, b."""
    points = pairs.select("seed", F.explode(F.array("a", "b")).alias("t"))
    points = points.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("t")) - 1)
    dealt = points.groupBy("seed", F.floor(F.col("r") / 2).alias("i")).agg(F.min("t").alias("opens"), F.max("t").alias("closes"))
    return pairs.select("seed", "i").join(dealt, ["seed", "i"])


def stale_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks of a generation below the node's highest so far."""
    w = Window.partitionBy("node").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return ticks.withColumn("top", F.max("generation").over(w)).where("generation < top").drop("top")


def coverage_gaps(observed: DataFrame, required: DataFrame) -> DataFrame:
    """Required categories with no observation. observed: category, n."""
    return required.join(observed.where("n > 0"), "category", "left_anti")


def required_categories(spark: SparkSession) -> DataFrame:
    names = [f"operation {o}" for o in ("PUT", "GET", "DELETE")] + [f"fault {k}" for k in FAULT_KINDS]
    names += [f"crash point {p}" for p in CRASH_POINTS] + ["actual network drop", "actual network duplicate"]
    return spark.createDataFrame([(n,) for n in names], "category string")


def vacuity_failures(summaries: DataFrame) -> DataFrame:
    """seed, failures: what keeps a run from being evidence. summaries: seed, logical, completed,
    attempts, puts, gets, deletes, max_concurrent, faults_in_flight."""
    text = lambda name, c, n: F.concat(F.lit(f"{name} operations "), F.col(c).cast("string"), F.lit(f" < {n}"))
    rules = [
        (F.col("logical") < MIN_LOGICAL, text("logical", "logical", MIN_LOGICAL)),
        (F.col("completed") < MIN_COMPLETED, text("completed", "completed", MIN_COMPLETED)),
        (F.col("attempts") < F.col("logical"), F.lit("physical attempts fewer than logical operations")),
        (F.col("puts") == 0, F.lit("no PUT operation")),
        (F.col("gets") == 0, F.lit("no GET operation")),
        (F.col("deletes") == 0, F.lit("no DELETE operation")),
        (F.col("max_concurrent") < 2, F.lit("fewer than two clients overlap")),
        (F.col("faults_in_flight") == 0, F.lit("no fault fired during an in-flight operation")),
    ]
    return summaries.select("seed", F.concat_ws("; ", *[F.when(c, t) for c, t in rules]).alias("failures"))


def batch_aggregate(summaries: DataFrame) -> DataFrame:
    """One row over all seeds. summaries: seed, failed, operations, max_concurrent."""
    return summaries.agg(
        F.count(F.lit(1)).alias("seeds"), F.count_if("failed").alias("failed"), F.count_if(~F.col("failed")).alias("passed"),
        F.sum("operations").alias("operations"), F.min("operations").alias("min_operations"), F.max("operations").alias("max_operations"),
        F.max("max_concurrent").alias("max_concurrent"), F.min(F.when(F.col("failed"), F.col("seed"))).alias("first_failing_seed"),
    )


def classify_trace(lines: DataFrame) -> DataFrame:
    """Counts of what a trace says happened to messages."""
    return lines.agg(
        F.count_if(F.contains("line", F.lit(" drop(fault)"))).alias("drops"),
        F.count_if(F.contains("line", F.lit(" duplicate(fault)"))).alias("duplicates"),
        F.count(F.lit(1)).alias("lines"),
    )


def crash_survivors(writes: DataFrame, retained: DataFrame) -> DataFrame:
    """Records that survive a crash: unsynced ones are kept in order while their bytes fit what is
    retained (-1: all), complete records only. writes: node, ord, bytes, synced; retained: node,
    keep."""
    pending = F.sum(F.when(F.col("synced"), 0).otherwise(F.col("bytes"))).over(
        Window.partitionBy("node").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    )
    return writes.withColumn("pending", pending).join(retained, "node").where("synced OR keep = -1 OR pending <= keep").select("node", "ord")


def fired_directives(events_: DataFrame, directives: DataFrame) -> DataFrame:
    """Directives met by the n-th occurrence of their operation. events_: node, op, ord;
    directives: node, op, occurrence, point."""
    nth = F.row_number().over(Window.partitionBy("node", "op").orderBy("ord")).cast("long")
    return events_.withColumn("occurrence", nth).join(directives, ["node", "op", "occurrence"]).select("node", "op", "occurrence", "ord", "point")


def deliverable(messages: DataFrame, cuts: DataFrame) -> DataFrame:
    """Messages with whether a cut of their link was open when they were sent: per link, the last
    opening or closing event at or before the message. messages: msg_id, link, at; cuts: link, at,
    ord, opens."""
    state = in_force(
        messages.select(F.col("link").alias("target"), F.col("msg_id").alias("probe_id"), "at"),
        cuts.select(F.col("link").alias("target"), "at", "ord", F.when(F.col("opens"), 1.0).otherwise(0.0).alias("v")),
    )
    return state.select(F.col("probe_id").alias("msg_id"), (F.coalesce("in_force", F.lit(0.0)) == 0).alias("delivered"))


SCHEDULE_EVENT = "seed long, ordinal int, time long, kind string, node long, `from` long, `to` long, `groups` array<array<long>>, rate double, multiplier double"


def generate_schedules(spark: SparkSession, seeds: int, nodes: int = 5, horizon: int = 6_000, tasks: int = 8) -> DataFrame:
    """Random schedules, a seed a row group: six open-close pairs that don't overlap, six single
    events, two crash directives (kind crash with a rate of what is retained) and a tail that
    restores the baseline. Reproducible per seed, whatever the partitioning."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for s in pdf["id"] for r in _schedule(int(s), nodes, horizon)]
            yield pd.DataFrame(rows, columns=["seed", "ordinal", "time", "kind", "node", "from", "to", "groups", "rate", "multiplier"])

    return spark.range(0, seeds, 1, tasks).mapInPandas(run, SCHEDULE_EVENT)


def _schedule(seed: int, nodes: int, horizon: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    out: list[tuple] = []

    def event(t, kind, node=0, frm=0, to=0, groups=None, rate=0.0, multiplier=0.0):
        out.append([int(t), kind, int(node), int(frm), int(to), groups, float(rate), float(multiplier)])

    ends = np.sort(rng.choice(np.arange(1, horizon), 12, replace=False)).reshape(6, 2)
    for a, b in ends:
        kind = rng.integers(3)
        if kind == 0:
            x, y = rng.choice(np.arange(1, nodes + 1), 2, replace=False)
            event(a, "partition", frm=x, to=y)
            event(b, "heal", frm=x, to=y)
        elif kind == 1:
            order = rng.permutation(np.arange(1, nodes + 1))
            cut = int(rng.integers(1, nodes))
            groups = [sorted(order[:cut].tolist()), sorted(order[cut:].tolist())]
            event(a, "partition-groups", groups=groups)
            event(b, "heal-groups", groups=groups)
        else:
            node = rng.integers(1, nodes + 1)
            event(a, "pause", node)
            event(b, "resume", node)
    for _ in range(6):
        t, kind = rng.integers(1, horizon), rng.integers(3)
        if kind < 2:
            event(t, ("drop-rate", "duplicate-rate")[kind], rate=rng.uniform(0, 0.3))
        else:
            event(t, "clock-skew", rng.integers(1, nodes + 1), multiplier=rng.uniform(MIN_MULTIPLIER, MAX_MULTIPLIER))
    for node in rng.choice(np.arange(1, nodes + 1), 2, replace=False):
        event(rng.integers(1, horizon), "crash", node, rate=rng.choice([0.0, 0.5, 1.0]))
    event(horizon, "drop-rate")
    event(horizon, "duplicate-rate")
    for node in range(1, nodes + 1):
        event(horizon, "clock-skew", node, multiplier=1.0)
    out.sort(key=lambda e: e[0])
    return [(seed, i, *e) for i, e in enumerate(out)]
