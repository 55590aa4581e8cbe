"""Sorted runs and their manifest: metadata, pruning, merging, tiers, replay, orphans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import latest_versions

#: Fixed values of the storage format.
SIZE_CLASS_BASE = 4096
FAN_IN = 4
BLOCK_TARGET = 4096


def run_metadata(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n"),
        F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
    )


def prune_candidates(metadata: DataFrame, key) -> DataFrame:
    """Runs that may hold a key: all of them must be read, since no run outranks another."""
    return metadata.where((F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key)))


def merge_runs(rows: DataFrame) -> DataFrame:
    """The merge of all runs: one version a key, tombstones kept."""
    return latest_versions(rows)


def order_violations(rows: DataFrame) -> DataFrame:
    """Rows of a run (file, pos, key, seq) that don't follow their predecessor: keys rise, and
    sequences fall within a key."""
    w = Window.partitionBy("file").orderBy("pos")
    k, s = F.lag("key").over(w), F.lag("seq").over(w)
    return rows.select("file", "pos", "key", "seq", k.alias("pk"), s.alias("ps")).where("pk > key OR (pk = key AND ps <= seq)").select("file", "pos", "key", "seq")


def metadata_violations(rows: DataFrame, stated: DataFrame) -> DataFrame:
    """Files whose rows disagree with the stated min_key, max_key or n, or that are on one side only."""
    found = run_metadata(rows).select("file", F.col("min_key").alias("a"), F.col("max_key").alias("b"), F.col("n").alias("c"))
    both = found.join(stated.select("file", "min_key", "max_key", "n"), "file", "full_outer")
    return both.where("NOT (a <=> min_key AND b <=> max_key AND c <=> n)").select("file", F.col("c").alias("found"), F.col("n").alias("stated"))


def size_class(size: Column) -> Column:
    """0 below the base of 2^12, then one more for each factor of four; integer arithmetic only."""
    return F.when(size < SIZE_CLASS_BASE, 0).otherwise(1 + F.floor((F.length(F.bin(F.shiftright(size, 12))) - 1) / 2)).cast("int")


def pick_compaction(files: DataFrame) -> DataFrame:
    """The FAN_IN lexically smallest files of the lowest tier that has as many; no row if none has.
    files: file, tier."""
    tier = files.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FAN_IN).agg(F.min("tier").alias("tier"))
    return files.join(F.broadcast(tier), "tier").orderBy("file").limit(FAN_IN)


def live_files(edits: DataFrame) -> DataFrame:
    """Files whose last action is an addition. Within an edit removals come first."""
    return edits.groupBy("file").agg(F.max_by("action", F.struct("ord", F.col("action") == "add")).alias("action")).where("action = 'add'").select("file")


def flushed_index(edits: DataFrame) -> DataFrame:
    return edits.agg(F.coalesce(F.max("flushed_index"), F.lit(0)).alias("flushed_index"))


def edit_violations(edits: DataFrame) -> DataFrame:
    """ord, rule, file of edits that a manifest must reject. edits: ord, action, file, n, min_key,
    max_key, flushed_index; an edit without files is a row without an action."""
    files = edits.where("file IS NOT NULL")
    history = Window.partitionBy("file").orderBy("ord", (F.col("action") == "add"))
    seen = files.withColumn("before", F.lag("action").over(history))
    both = files.groupBy("ord", "file").agg(F.count_distinct("action").alias("k"), F.count(F.lit(1)).alias("n"))
    rules = [
        seen.where("action = 'remove' AND NOT (before <=> 'add')").select("ord", F.lit("removes a file that is not live").alias("rule"), "file"),
        seen.where("action = 'add' AND before = 'add'").select("ord", F.lit("adds a live file").alias("rule"), "file"),
        both.where("k > 1").select("ord", F.lit("adds and removes a file").alias("rule"), "file"),
        both.where("k = 1 AND n > 1").select("ord", F.lit("repeats a file").alias("rule"), "file"),
        edits.where("action = 'add' AND n <= 0").select("ord", F.lit("count is not positive").alias("rule"), "file"),
        edits.where("action = 'add' AND min_key > max_key").select("ord", F.lit("bounds are reversed").alias("rule"), "file"),
        edits.where("action = 'add' AND NOT file rlike '^[0-9]{6,}\\\\.sst$'").select("ord", F.lit("invalid file name").alias("rule"), "file"),
    ]
    marks = edits.groupBy("ord").agg(F.max("flushed_index").alias("f"), F.count("file").alias("k"))
    # The highest index before each edit, by blocks of edits, so that the window without a
    # partition has a row a block.
    marks = marks.withColumn("block", F.floor(F.col("ord") / 4096))
    blocks = marks.groupBy("block").agg(F.max("f").alias("m"))
    before = F.max("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.max("f").over(Window.partitionBy("block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.withColumn("in_b", inside).join(blocks.select("block", before.alias("out_b")), "block")
    marks = marks.withColumn("b", F.greatest("in_b", "out_b"))
    none = F.lit(None).cast("string").alias("file")
    rules.append(marks.where("f < b").select("ord", F.lit("flushed index regresses").alias("rule"), none))
    rules.append(marks.where("k = 0 AND coalesce(f, b, 0) = coalesce(b, 0)").select("ord", F.lit("empty edit").alias("rule"), none))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def orphans(listing: DataFrame, referenced: DataFrame) -> DataFrame:
    return listing.join(referenced, "file", "left_anti")


def flush_generations(rows: DataFrame, threshold: int, shard: str = "shard") -> DataFrame:
    """The memtable generation of each row (shard, ord, key, bytes): a generation is cut when its
    bytes reach the threshold, and the count starts anew. The reset can't be a window, so each
    shard is one pass; shards bound what a task sees."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        held: dict = {}
        total, generation, out = 0, 0, []
        for key, size in zip(pdf["key"], pdf["bytes"]):
            out.append(generation)
            total += size - held.get(key, 0)
            held[key] = size
            if total >= threshold:
                held.clear()
                total, generation = 0, generation + 1
        return pdf.assign(generation=out)[[shard, "ord", "generation"]]

    return rows.groupBy(shard).applyInPandas(run, f"{shard} long, ord long, generation long")


def data_blocks(rows: DataFrame, target: int = BLOCK_TARGET) -> DataFrame:
    """The data block of each row (file, pos, key, bytes): blocks are filled up to the target, all
    versions of a key share one, and a block may be larger than the target for that."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        block, filled, before, out = 0, 0, object(), []
        for key, size in zip(pdf["key"], pdf["bytes"]):
            if filled and filled + size > target and key != before:
                block, filled = block + 1, 0
            filled += size
            before = key
            out.append(block)
        return pdf.assign(block=out)[["file", "pos", "block"]]

    return rows.groupBy("file").applyInPandas(run, "file string, pos long, block long")


def block_violations(rows: DataFrame) -> DataFrame:
    """Keys that span blocks. rows: file, key, block."""
    return rows.groupBy("file", "key").agg(F.count_distinct("block").alias("blocks")).where("blocks > 1")


def reference_flush(rows: list[tuple], threshold: int) -> Iterator[int]:
    """flush_generations of one shard in plain Python, for tests: (key, bytes) rows."""
    held: dict = {}
    generation = 0
    for key, size in rows:
        yield generation
        held[key] = size
        if sum(held.values()) >= threshold:
            held, generation = {}, generation + 1
