"""Analytics over operation histories: client sessions, overlap, faults in flight, linearizability."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.linearizability import BoundedSearch, Search
from .order import least_later

FAR = (1 << 62) - 1


def call_return_events(ops: DataFrame) -> DataFrame:
    """Two rows an operation, with the total order (at, is_return, id): calls before returns at a
    tie, and returns of open operations after all else."""
    ret = F.coalesce("ret", F.lit(FAR))
    return ops.select(
        "id", "client_id",
        F.inline(F.array(
            F.struct(F.col("invoke").alias("at"), F.lit(False).alias("is_return")),
            F.struct(ret.alias("at"), F.lit(True).alias("is_return")),
        )),
    )


def sums_before(per: DataFrame, at: str, value: str, wide: int = 4096) -> DataFrame:
    """at, before: the sum of ``value`` over all rows of a lower (whole) number ``at``, a row each.
    In two levels, so that the one window without a partition has a row for ``wide`` numbers."""
    top = F.floor(F.col(at) / wide)
    rows = per.withColumn("top", top)
    tops = rows.groupBy("top").agg(F.sum(value).alias("t"))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select("top", earlier("t", Window.orderBy("top")).alias("far"))
    near = earlier(value, Window.partitionBy("top").orderBy(at))
    return rows.withColumn("near", near).join(tops, "top").select(at, (F.col("near") + F.col("far")).alias("before"))


def placed(rows: DataFrame, order: list[str], width: int) -> DataFrame:
    """rows with ``place``, their number in the total order (the first of ``order`` is a time). Rows
    are numbered within time buckets, and the sizes of earlier buckets are added; no task sorts all
    rows."""
    b = rows.withColumn("bucket", F.floor(F.col(order[0]) / width))
    sizes = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return b.withColumn("inside", inside).join(sums_before(sizes, "bucket", "n"), "bucket").withColumn(
        "place", F.col("inside") + F.col("before")
    ).drop("bucket", "inside", "before")


def running_total(points: DataFrame, at: str, up: str, width: int) -> DataFrame:
    """at, and ``below``: the sum of ``up`` over all points with a lower time. By buckets, as placed."""
    sums = points.groupBy(at).agg(F.sum(up).alias("s")).withColumn("bucket", F.floor(F.col(at) / width))
    per = sums.groupBy("bucket").agg(F.sum("s").alias("t"))
    inside = F.coalesce(F.sum("s").over(Window.partitionBy("bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("inside", inside).join(sums_before(per, "bucket", "t"), "bucket").select(
        at, (F.col("inside") + F.col("before")).alias("below")
    )


def max_concurrency(ops: DataFrame, bucket_us: int = 60_000_000) -> DataFrame:
    """The most operations in flight at once, closed intervals, for clients whose own intervals
    don't touch. A sweep in two steps: sums of starts and ends per time bucket carry over to the
    next bucket, and within a bucket the running sum is a window partitioned by bucket, so no task
    sorts the whole history."""
    points = ops.select(F.col("invoke").alias("at"), F.lit(1).alias("d")).unionByName(
        ops.where("ret IS NOT NULL").select(F.col("ret").alias("at"), F.lit(-1).alias("d"))
    )
    sums = points.groupBy("at").agg(
        F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("down")
    ).withColumn("bucket", F.floor(F.col("at") / bucket_us))
    carried = sums.groupBy("bucket").agg(F.sum(F.col("up") - F.col("down")).alias("net"))
    carried = sums_before(carried, "bucket", "net")
    inside = Window.partitionBy("bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    level = F.sum(F.col("up") - F.col("down")).over(inside) + F.col("down")
    return sums.withColumn("level", level).join(carried, "bucket").agg(
        F.coalesce(F.max(F.col("level") + F.col("before")), F.lit(0)).cast("long").alias("max_concurrent")
    )


def faults_in_flight(faults: DataFrame, ops: DataFrame, strict_start: bool = True, width: int = 600_000_000) -> DataFrame:
    """fault_id and clients: how many clients have an operation that the fault catches, i.e. that
    started before (or, unless strict_start, at) its time and has not returned before it.

    A client's operations don't overlap, so it has one in flight or none, and the clients caught
    are the operations started less those returned: running totals, without a join of intervals.
    An open operation never returns."""
    # Times are doubled, so that a fault's time can lie just before or after what has the same.
    after = 0 if strict_start else 1
    at = (F.col("at") * 2 + after).alias("t")
    points = (
        ops.select((F.col("invoke") * 2).alias("t"), F.lit(1).alias("up"))
        .unionByName(ops.where("ret IS NOT NULL").select((F.col("ret") * 2 + 1).alias("t"), F.lit(-1).alias("up")))
        .unionByName(faults.select(at, F.lit(0).alias("up")))
    )
    below = running_total(points, "t", "up", 2 * width)
    return faults.select("fault_id", at).join(below, "t").select("fault_id", F.col("below").cast("long").alias("clients"))


def session_violations(ops: DataFrame) -> DataFrame:
    """id, rule: an operation invoked while its client has one outstanding, or whose sequence does
    not rise. ops: id, client_id, seq, invoke, ret."""
    w = Window.partitionBy("client_id").orderBy("invoke", "id")
    rows = ops.withColumns({"prev": F.lag("id").over(w), "prev_ret": F.lag("ret").over(w), "prev_seq": F.lag("seq").over(w)}).where("prev IS NOT NULL")
    outstanding = rows.where("prev_ret IS NULL OR prev_ret > invoke").select("id", F.lit("outstanding").alias("rule"))
    return outstanding.unionByName(rows.where("seq <= prev_seq").select("id", F.lit("sequence").alias("rule")))


def outstanding(ops: DataFrame) -> DataFrame:
    return ops.where("ret IS NULL").select("client_id").distinct()


def stale_read_candidates(ops: DataFrame) -> DataFrame:
    """Reads that return what a finished write had already replaced: some write of the key began
    after the writer of the read's value had returned, and itself returned before the read began.
    A necessary condition that plain SQL can check. ops: id, op, key, value, invoke, ret."""
    writes = ops.where("op <> 'GET' AND ret IS NOT NULL").select("key", "invoke", "ret", F.when(F.col("op") == "PUT", F.col("value")).alias("value"))
    reads = ops.where("op = 'GET'").select("id", "key", "invoke", F.col("value").alias("read"))
    # The latest start among writes that returned before the read began, by an as-of window.
    marks = reads.select("key", F.col("invoke").alias("at"), "id", "read", F.lit(1).alias("o"), F.lit(None).cast("long").alias("w_invoke")).unionByName(
        writes.select("key", F.col("ret").alias("at"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("read"), F.lit(2).alias("o"), F.col("invoke").alias("w_invoke"))
    )
    w = Window.partitionBy("key").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, -1)
    asof = marks.withColumn("latest", F.max("w_invoke").over(w)).where("o = 1 AND latest IS NOT NULL")
    source = writes.groupBy("key", "value").agg(F.max("ret").alias("w_ret"))
    return asof.join(source, (asof["key"] == source["key"]) & (asof["read"] == source["value"])).where("w_ret < latest").select("id")


def _reach(ops: DataFrame, width: int = 600_000_000) -> DataFrame:
    """ops with ``until``, of a write: the last call of a read that asks for its state and can see it,
    i.e. not after the first return of a write called after its own return; and ``again``, of a read:
    a write of the state it asks for is called from its call to its return. Null until for none."""
    write = F.coalesce(F.col("op").isin("PUT", "DELETE"), F.lit(False))
    present = F.when(write, F.col("op") == "PUT").otherwise(F.coalesce("found", F.lit(False)))
    value = F.when(present, F.when(write, F.col("in_value")).otherwise(F.col("out_value")))
    if dict(ops.dtypes)["in_value"] in ("float", "double"):
        value = F.nanvl(value, F.lit(None).cast("double"))  # as the search takes it
    # States that share a hash only count as seen for longer, or as written again.
    ops = ops.withColumns({"write": write, "state": F.xxhash64("key", present, value)})
    done = ops.where("write AND NOT unknown")
    marks = done.select("key", F.col("invoke").alias("at"), F.lit(0).alias("o"), F.col("ret").alias("back"))
    ended = done.withColumns({"at": F.col("ret"), "o": F.lit(1), "back": F.lit(None).cast("long")})
    ended = least_later(ended.unionByName(marks, allowMissingColumns=True), ["key"], F.floor(F.col("at") / width), ["at", "o"], "back", "end")
    ended = ended.where("o = 1").withColumn("at", F.col("end")).drop("end", "back")
    # Per state, in this order at a tie: reads, calls of writes, and the last moments writes can be seen.
    none = F.lit(None).cast("long")
    rows = (
        ops.where("NOT write").withColumns({"at": F.col("invoke"), "o": F.lit(0), "asked": F.when(~F.col("unknown"), F.col("invoke")), "called": none})
        .unionByName(ops.where("write").select("state", F.col("invoke").alias("at"), F.lit(1).alias("o"), none.alias("asked"), F.col("invoke").alias("called")), allowMissingColumns=True)
        .unionByName(
            ended.unionByName(ops.where("write AND unknown").withColumns({"at": none, "o": F.lit(2)}))
            .withColumns({"at": F.coalesce("at", F.lit(FAR)), "o": F.lit(2), "asked": none, "called": none})
        )
    )
    on = Window.partitionBy("state").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("state").orderBy(F.col("at").desc(), F.col("o").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reach = rows.withColumns({"until": F.max("asked").over(on), "next": F.min("called").over(back)}).where("o <> 1")
    return reach.withColumns({"until": F.when(F.col("write"), F.col("until")), "again": F.coalesce(F.col("next") <= F.col("ret"), F.lit(False))})


def linearizable_per_key(ops: DataFrame, max_steps: int | None = None) -> DataFrame:
    """key, operations, verdict (ok, illegal; unchecked only beyond max_steps, if given): the calls
    and returns of each key are streamed in order through one task, which holds a batch and what is
    in flight. ops: id, op, key, in_value, out_value, found, ok, unknown, invoke, ret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, current, n, of = None, None, 0, None
        for batch in batches:
            of, out = batch.schema.field(0).type, []
            for key, at, is_return, i, *call in zip(*(c.to_pylist() for c in batch.columns)):
                if search is None or key != current:
                    if search is not None:
                        out.append((current, n, search.verdict))
                    search, current, n = Search(None) if max_steps is None else BoundedSearch(max_steps), key, 0
                if is_return:
                    search.ret(at, i)
                else:
                    n += 1
                    search.call(at, i, *call)
            if out:
                yield verdicts(out, of)
        if search is not None:
            yield verdicts([(current, n, search.verdict)], of)

    def verdicts(rows: list, of: pa.DataType) -> pa.RecordBatch:
        key, n, verdict = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(key, of), pa.array(n, pa.int64()), pa.array(verdict, pa.string())], ["key", "operations", "verdict"])

    unknown = F.coalesce("unknown", F.lit(False)) | F.col("ret").isNull()
    moments = F.array(
        F.struct(F.col("invoke").alias("at"), F.lit(False).alias("is_return")),
        F.struct(F.when(~F.col("unknown"), F.col("ret")).alias("at"), F.lit(True).alias("is_return")),
    )
    ops = _reach(ops.withColumn("unknown", unknown))
    events = ops.select("key", F.inline(moments), "id", "op", "in_value", "out_value", "found", "ok", "unknown", "ret", "until", "again").where("at IS NOT NULL")
    key_type = dict(ops.dtypes)["key"]
    return events.repartition("key").sortWithinPartitions("key", "at", "is_return", "id").mapInArrow(run, f"key {key_type}, operations long, verdict string")
