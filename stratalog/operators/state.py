"""Key-value state from ordered versions: the highest sequence wins, deletes are tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the storage format: bytes per entry besides key and value.
ENTRY_OVERHEAD = 9


#: Types whose aggregation buffers can be updated in place.
FIXED_WIDTH = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def latest_versions(rows: DataFrame, key: str = "key", seq: str = "seq", payload: tuple = ("value", "tombstone")) -> DataFrame:
    """One row per key: the version with the highest sequence, tombstones included; a null value
    can win. A map-side combinable aggregate. Payloads of fixed width are picked column by column,
    which hash-aggregates (all picks follow the same comparisons, so they come from one row);
    others are picked as one struct, which Spark sort-aggregates."""
    types = dict(rows.dtypes)
    if all(types[c] in FIXED_WIDTH for c in (seq, *payload)):
        return rows.groupBy(key).agg(F.max(seq).alias(seq), *[F.max_by(p, seq).alias(p) for p in payload])
    best = F.max_by(F.struct(*payload), seq).alias("best")
    return rows.groupBy(key).agg(F.max(seq).alias(seq), best).select(key, seq, *[F.col(f"best.{p}").alias(p) for p in payload])


def read_view(rows: DataFrame, **names) -> DataFrame:
    """The visible state: keys whose winner is not a tombstone."""
    return latest_versions(rows, **names).where("NOT tombstone")


def conflicts(rows: DataFrame) -> DataFrame:
    """(key, seq) with different payloads: corruption. Values of tombstones don't count."""
    payload = F.struct("tombstone", F.when(~F.col("tombstone"), F.col("value")))
    return rows.groupBy("key", "seq").agg(F.count_distinct(payload).alias("payloads")).where("payloads > 1")


def multi_get(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, found, value for each distinct wanted key. ``found`` is separate from a null value;
    rows are reduced to wanted keys before they are shuffled if those fit a broadcast."""
    live = read_view(rows.join(wanted, "key", "left_semi")).withColumn("found", F.lit(True))
    return wanted.distinct().join(live, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), "value")


def point_read(rows: DataFrame, key) -> DataFrame:
    """The winner of one key: the filter reaches the scan."""
    return latest_versions(rows.where(F.col("key") == F.lit(key)))


def tombstones(keys: DataFrame) -> DataFrame:
    """Deletes: (key, seq) as versions without a value."""
    return keys.select("key", "seq", F.lit(None).cast("double").alias("value"), F.lit(True).alias("tombstone"))


def entry_bytes(key_bytes: Column, value_bytes: Column, tombstone: Column) -> Column:
    return key_bytes + ENTRY_OVERHEAD + F.when(tombstone, 0).otherwise(F.coalesce(value_bytes, F.lit(0)))


def memtable_bytes(rows: DataFrame, group: str) -> DataFrame:
    """Bytes of each generation's memtable: its winners only, eight bytes a key and value."""
    winners = rows.groupBy(group, "key").agg(F.max_by("tombstone", "seq").alias("tombstone"))
    return winners.groupBy(group).agg(
        F.sum(entry_bytes(F.lit(8), F.lit(8), F.col("tombstone"))).cast("long").alias("bytes"),
        F.count(F.lit(1)).cast("long").alias("entries"),
    )


def unflushed(rows: DataFrame, flushed_index: int) -> DataFrame:
    """The active memtable: versions above the flushed index, tombstones included, in key order."""
    return latest_versions(rows.where(F.col("seq") > flushed_index)).orderBy("key")


def applied_index(log: DataFrame, idx: str = "idx") -> DataFrame:
    """Every entry advances it, reads and no-ops too; zero if there is none."""
    return log.agg(F.coalesce(F.max(idx), F.lit(0)).cast("long").alias("applied_index"))


def flush_target(applied: Column, flushed: Column) -> Column:
    return F.greatest(applied, flushed)


def applied_regressions(log: DataFrame, arrival: str, idx: str) -> DataFrame:
    """Entries that would set the applied index back. The order of arrival is the log's own, so the
    running maximum is per stream."""
    from pyspark.sql import Window

    before = F.max(idx).over(Window.partitionBy("stream").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("before", before).where(F.col(idx) < F.col("before"))


def state_digest(state: DataFrame) -> DataFrame:
    """A digest that depends on the logical state only, not on files, order or partitions."""
    h = F.xxhash64(*sorted(state.columns))
    return state.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("digest"))
