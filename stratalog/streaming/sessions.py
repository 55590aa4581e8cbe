"""Structured Streaming forms: live state, exactly-once apply, session automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COMMAND = "idx long, client_id long, seq long, op string, key int, value double"


def command_stream(spark: SparkSession, path: str, schema: str = COMMAND, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def live_state(stream: DataFrame) -> DataFrame:
    """The latest version per key as it changes (update or complete mode). The state kept is one
    struct a key, whatever the length of the stream."""
    return (
        stream.where("op <> 'GET'")
        .groupBy("key")
        .agg(F.max("idx").alias("seq"), F.max_by(F.struct("op", "value"), "idx").alias("m"))
        .select("key", "seq", F.when(F.col("m.op") == "PUT", F.col("m.value")).alias("value"), (F.col("m.op") == "DELETE").alias("tombstone"))
    )


def exactly_once(stream: DataFrame) -> DataFrame:
    """idx, client_id, seq, duplicate of each command: a client's state is the last accepted
    sequence and the last index seen; rows at or below that index are replays and give nothing."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_seq, last_idx = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).sort_values("idx")
        out = []
        for idx, seq in zip(rows["idx"].tolist(), rows["seq"].tolist()):
            if idx <= last_idx:
                continue
            duplicate = last_idx >= 0 and seq <= last_seq
            out.append((idx, key[0], seq, duplicate))
            last_idx = idx
            if not duplicate:
                last_seq = seq
        state.update((last_seq, last_idx))
        yield pd.DataFrame(out, columns=["idx", "client_id", "seq", "duplicate"])

    return stream.groupBy("client_id").applyInPandasWithState(
        run, "idx long, client_id long, seq long, duplicate boolean", "last_seq long, last_idx long", "append", GroupStateTimeout.NoTimeout
    )


SESSION_EVENT = "client_id long, ord long, kind string, seq long, generation long"


def session_automaton(stream: DataFrame) -> DataFrame:
    """client_id, ord, action of each session event: start (when idle, or when a retry is due) and
    retry start an attempt, applied completes it, a deadline of the current generation or a lost
    leader asks for a retry, and events of an older generation or sequence are ignored. An event
    without a sequence or a generation concerns the current one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, seq, generation = state.get if state.exists else ("idle", 0, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("ord").itertuples():
            action = "ignored"
            if row.kind == "start" and phase == "idle":
                phase, seq, generation, action = "waiting", seq + 1, generation + 1, "submit"
            elif row.kind == "applied" and phase == "waiting" and (pd.isna(row.seq) or row.seq == seq):
                phase, action = "idle", "complete"
            elif phase == "waiting" and row.kind in ("deadline", "leadership-lost") and (pd.isna(row.generation) or row.generation == generation):
                phase, action = "retrying", "schedule-retry"
            elif row.kind in ("retry", "start") and phase == "retrying":
                phase, generation, action = "waiting", generation + 1, "submit"
            out.append((key[0], row.ord, action))
        state.update((phase, seq, generation))
        yield pd.DataFrame(out, columns=["client_id", "ord", "action"])

    return stream.groupBy("client_id").applyInPandasWithState(
        run, "client_id long, ord long, action string", "phase string, seq long, generation long", "append", GroupStateTimeout.NoTimeout
    )


def apply_batches(stream: DataFrame, store, checkpoint: str):
    """Flush each micro-batch to a run store and compact it: the batch is the unit of durability,
    and a replayed batch, whose versions are at or below the flushed index, changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        rows = batch.where("op <> 'GET'").select(
            F.col("key").cast("string").alias("key"), F.col("idx").alias("seq"), F.when(F.col("op") == "PUT", F.col("value")).alias("value"),
            (F.col("op") == "DELETE").alias("tombstone"),
        )
        top = batch.agg(F.max("idx")).first()[0]
        if top is not None and top > store.flushed_index():
            store.flush(rows, top)
            store.compact()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_files(spark: SparkSession, frame: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a finite stream to its end into Parquet files, and read them: all rows in append mode, the
    last result in complete mode."""
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last[:] = [number]

    out = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").start(path).awaitTermination()
        return spark.read.schema(frame.schema).parquet(path)
    out.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/{last[0]}")
