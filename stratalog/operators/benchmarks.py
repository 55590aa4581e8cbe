"""Benchmark analytics: quantiles, medians, amplification, Bloom theory, validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value of the format.
BLOOM_PROBES = 7


@dataclass(frozen=True)
class Profile:
    """The frozen matrix of a benchmark document."""

    name: str
    trials: tuple = (1,)
    seeds: tuple = (1,)
    key_size: int = 16
    value_size: int = 128
    flush_thresholds: tuple = (65536, 4194304)
    write_operations: int = 2000
    table_counts: tuple = (1, 4)
    bloom_modes: tuple = (True, False)
    lookup_kinds: tuple = ("hit", "miss")
    read_operations: int = 1000
    inserted_keys: tuple = (1000,)
    probe_keys: int = 5000
    amplification_operations: int = 5000
    keyspace: int = 500
    puts_percent: int = 90
    amplification_reads: int = 1000
    pause_operations: int = 5000
    samples: int = 10000
    cells: dict = field(default_factory=dict, compare=False)

    def seed_for(self, trial: Column) -> Column:
        pairs = [x for t, s in zip(self.trials, self.seeds) for x in (F.lit(t), F.lit(s))]
        return F.try_element_at(F.create_map(*pairs), trial)

    def expected_rows(self) -> dict[str, int]:
        t = len(self.trials)
        return {
            "write_throughput": t * len(self.flush_thresholds),
            "point_read": t * len(self.table_counts) * len(self.bloom_modes) * len(self.lookup_kinds),
            "bloom": t * len(self.inserted_keys), "amplification": t, "compaction_pause": t, "skiplist": t,
        }


SMOKE = Profile("smoke-v1")
REPORT = Profile(
    "report-v1", (1, 2, 3, 4, 5), (1, 2, 3, 4, 5), flush_thresholds=(65536, 262144, 1048576, 4194304),
    write_operations=100000, table_counts=(1, 4, 16, 64), read_operations=25000, inserted_keys=(1000, 10000, 100000),
    probe_keys=100000, amplification_operations=250000, keyspace=25000, amplification_reads=50000,
    pause_operations=100000, samples=1000000,
)
PROFILES = {p.name: p for p in (SMOKE, REPORT)}


def nearest_rank(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p95, p99 and maximum by nearest rank."""
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast(dict(rows.dtypes)[value])
    return rows.groupBy(*by).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max(value).alias("max"))


def median_min_max(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def throughput(rows: DataFrame) -> DataFrame:
    """Operations a second per threshold."""
    return median_min_max(rows.withColumn("ops_s", F.col("operations") * 1e9 / F.col("elapsed_ns")), ["flush_threshold_bytes"], "ops_s")


def amplification(rows: DataFrame) -> DataFrame:
    d = lambda a, b: F.col(a) / F.col(b)
    return rows.select(
        "trial",
        ((F.col("sstable_write_bytes") + F.col("manifest_write_bytes")) / F.col("logical_user_write_bytes")).alias("write_amp"),
        d("sstable_read_bytes", "read_operations").alias("bytes_per_read"), d("sstable_read_calls", "read_operations").alias("calls_per_read"),
        d("referenced_sstable_bytes", "logical_live_bytes").alias("space_amp"),
    )


def bloom_rates(rows: DataFrame) -> DataFrame:
    """Measured and theoretical false-positive rate by number of keys."""
    theory = F.pow(1 - F.exp(-F.col("k") * F.col("inserted_keys") / F.col("m_bits")), F.col("k"))
    return rows.groupBy("inserted_keys").agg(
        (F.sum("false_positives") / F.sum("probe_keys")).alias("measured"), F.max(theory).alias("theory")
    )


def heights(rows: DataFrame) -> DataFrame:
    """Probability of each tower height, measured and (3/4)(1/4)^(h-1) in theory."""
    h = rows.select("samples", F.posexplode("height_counts").alias("i", "n"))
    return h.groupBy((F.col("i") + 1).alias("height")).agg((F.sum("n") / F.sum("samples")).alias("measured")).withColumn(
        "theory", 0.75 * F.pow(F.lit(0.25), F.col("height") - 1)
    )


def pause_classes(rows: DataFrame) -> DataFrame:
    """Operations during which the compaction counter rose. rows: trial, ord, ns, compactions."""
    before = F.lag("compactions", 1, 0).over(Window.partitionBy("trial").orderBy("ord"))
    return rows.withColumn("compaction", F.col("compactions") > before)


def io_accounting(calls: DataFrame) -> DataFrame:
    """Calls and bytes by file class. calls: path, op, bytes."""
    kind = F.when(F.col("path").endswith(".sst"), "sstable").when(F.col("path").rlike("(^|/)MANIFEST$"), "manifest").otherwise("other")
    return calls.groupBy(kind.alias("class"), "op").agg(F.count(F.lit(1)).alias("calls"), F.sum("bytes").alias("bytes"))


def chart_bounds(rows: DataFrame, value: str) -> DataFrame:
    """Axis bounds: the minimum is clipped to zero, a degenerate range is widened by one, and
    without finite values the bounds are (0, 1)."""
    v = F.when(~(F.isnan(value) | F.col(value).isin(float("inf"), float("-inf"))), F.col(value))
    lo, hi = F.least(F.lit(0.0), F.min(v)), F.max(v)
    bad = F.count(v) != F.count(value)
    return rows.agg(
        F.when(bad | hi.isNull(), 0.0).otherwise(lo).alias("lo"),
        F.when(bad | hi.isNull(), 1.0).when(hi <= lo, lo + 1).otherwise(hi).alias("hi"),
    )


def _rules(rows: DataFrame, family: str, cell: Column, rules: list) -> DataFrame:
    found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules]), lambda x: x.isNotNull())
    return rows.select(F.lit(family).alias("family"), cell.alias("cell"), F.explode(found).alias("rule"))


def _matrix(rows: DataFrame, family: str, cell: Column, expected: list[str]) -> DataFrame:
    """Missing, unexpected and duplicate cells."""
    spark = rows.sparkSession
    want = spark.createDataFrame([(c,) for c in expected], "cell string")
    have = rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.when(F.col("n").isNull(), "missing cell").when(F.col("w").isNull(), "unexpected cell").when(F.col("n") > 1, "duplicate cell")
    both = have.join(want.withColumn("w", F.lit(1)), "cell", "full_outer").select(F.lit(family).alias("family"), "cell", rule.alias("rule"))
    return both.where("rule IS NOT NULL")


def write_violations(rows: DataFrame, p: Profile) -> DataFrame:
    cell = F.concat_ws("/", "trial", "flush_threshold_bytes")
    rules = [("seed", F.col("seed") == p.seed_for(F.col("trial"))), ("operations", F.col("operations") == p.write_operations), ("elapsed", F.col("elapsed_ns") > 0)]
    return _rules(rows, "write_throughput", cell, rules).unionByName(
        _matrix(rows, "write_throughput", cell, [f"{t}/{x}" for t in p.trials for x in p.flush_thresholds])
    )


def point_read_violations(rows: DataFrame, p: Profile) -> DataFrame:
    c = F.col
    cell = F.concat_ws("/", "trial", "sstable_count", c("bloom_enabled").cast("string"), "lookup_kind")
    hit, miss = c("lookup_kind") == "hit", c("lookup_kind") == "miss"
    io = (c("sstable_read_calls") > 0) & (c("sstable_read_bytes") > 0)
    rules = [
        ("seed", c("seed") == p.seed_for(c("trial"))), ("operations", c("operations") == p.read_operations), ("elapsed", c("elapsed_ns") > 0),
        ("counts", (c("found") >= 0) & (c("not_found") >= 0) & (c("found") + c("not_found") == c("operations"))),
        ("quantiles", (c("p50_ns") > 0) & (c("p50_ns") <= c("p95_ns")) & (c("p95_ns") <= c("p99_ns")) & (c("p99_ns") <= c("max_ns"))),
        ("elapsed below max", c("elapsed_ns") >= c("max_ns")),
        ("hits", ~hit | (c("found") == c("operations"))), ("misses", ~miss | (c("not_found") == c("operations"))),
        ("reads", ~(hit | (miss & ~c("bloom_enabled"))) | io),
    ]
    want = [f"{t}/{n}/{str(b).lower()}/{k}" for t in p.trials for n in p.table_counts for b in p.bloom_modes for k in p.lookup_kinds]
    return _rules(rows, "point_read", cell, rules).unionByName(_matrix(rows, "point_read", cell, want))


def bloom_violations(rows: DataFrame, p: Profile) -> DataFrame:
    c = F.col
    cell = F.concat_ws("/", "trial", "inserted_keys")
    rules = [
        ("seed", c("seed") == p.seed_for(c("trial"))), ("probe keys", c("probe_keys") == p.probe_keys), ("bits", c("m_bits") > 0), ("probes", c("k") > 0),
        ("false negatives", c("false_negatives") == 0), ("false positives", c("false_positives") <= c("probe_keys")),
    ]
    return _rules(rows, "bloom", cell, rules).unionByName(_matrix(rows, "bloom", cell, [f"{t}/{n}" for t in p.trials for n in p.inserted_keys]))


def amplification_violations(rows: DataFrame, p: Profile) -> DataFrame:
    c = F.col
    unit = p.key_size + p.value_size
    positive = ["sstable_read_calls", "sstable_read_bytes", "sstable_write_bytes", "manifest_write_bytes", "logical_live_bytes", "referenced_sstable_bytes"]
    rules = [
        ("seed", c("seed") == p.seed_for(c("trial"))), ("operations", c("operations") == p.amplification_operations),
        ("split", (c("puts") == F.floor(c("operations") * p.puts_percent / 100)) & (c("puts") + c("deletes") == c("operations"))),
        ("logical bytes", c("logical_user_write_bytes") == c("puts").cast("long") * unit + c("deletes").cast("long") * p.key_size),
        ("reads", c("read_operations") == p.amplification_reads),
        ("live bytes", (c("logical_live_bytes") % unit == 0) & (c("logical_live_bytes") <= p.keyspace * unit)),
        ("compactions", c("compactions") >= 0),
        *[(f"{x} is zero", c(x) > 0) for x in positive],
    ]
    cell = c("trial").cast("string")
    return _rules(rows, "amplification", cell, rules).unionByName(_matrix(rows, "amplification", cell, [str(t) for t in p.trials]))


def pause_violations(rows: DataFrame, p: Profile) -> DataFrame:
    c = F.col
    ordered = lambda k: (c(f"{k}_p50_ns") > 0) & (c(f"{k}_p50_ns") <= c(f"{k}_p95_ns")) & (c(f"{k}_p95_ns") <= c(f"{k}_p99_ns")) & (c(f"{k}_p99_ns") <= c(f"{k}_max_ns"))
    rules = [
        ("seed", c("seed") == p.seed_for(c("trial"))), ("operations", c("operations") == p.pause_operations),
        ("split", (c("compaction_operations") > 0) & (c("ordinary_operations") > 0) & (c("compaction_operations") + c("ordinary_operations") == c("operations"))),
        ("compaction quantiles", ordered("compaction")), ("ordinary quantiles", ordered("ordinary")),
    ]
    cell = c("trial").cast("string")
    return _rules(rows, "compaction_pause", cell, rules).unionByName(_matrix(rows, "compaction_pause", cell, [str(t) for t in p.trials]))


def skiplist_violations(rows: DataFrame, p: Profile) -> DataFrame:
    c = F.col
    total = F.aggregate("height_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    rules = [
        ("seed", c("seed") == p.seed_for(c("trial"))), ("samples", c("samples") == p.samples), ("histogram", total == c("samples")),
        ("buckets", F.size("height_counts") == 16),
    ]
    cell = c("trial").cast("string")
    return _rules(rows, "skiplist", cell, rules).unionByName(_matrix(rows, "skiplist", cell, [str(t) for t in p.trials]))


def point_read_fixture(spark: SparkSession, tables: int, entries: int) -> DataFrame:
    """Overlapping tables that hold the even keys; odd keys are misses within their ranges."""
    return spark.range(tables * entries).select(
        (F.col("id") * 2).alias("key"), (F.col("id") + 1).alias("seq"), (F.col("id") % tables).cast("int").alias("table_no")
    )


def sampled_reads(spark: SparkSession, operations: int, keyspace: int, hit_percent: int, live: DataFrame) -> DataFrame:
    """Reads with replacement, the stated share from live keys and the rest from the others. live:
    key. Draws are hashes of the read's number, so they don't depend on partitions."""
    ranked = lambda df: df.select("key", (F.row_number().over(Window.orderBy("key")) - 1).alias("r"))  # noqa: E731  bounded by the keyspace
    dead = spark.range(keyspace).select(F.col("id").alias("key")).join(live, "key", "left_anti")
    hits = operations * hit_percent // 100
    out = None
    for pool, lo, hi, hit in ((ranked(live), 0, hits, True), (ranked(dead), hits, operations, False)):
        n = pool.count()
        if not n:
            continue
        reads = spark.range(lo, hi).select(F.col("id").alias("read"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("r"))
        part = reads.join(pool, "r").select("read", "key", F.lit(hit).alias("hit"))
        out = part if out is None else out.unionByName(part)
    return out


def document_violations(documents: DataFrame, schema_version: int = 1) -> DataFrame:
    """rule of what a benchmark document's head must not be. documents: schema_version, profile,
    collected_at_utc, os, arch, cpus, and rows, a map of family to number of rows."""
    from ..functions.scalars import is_utc_timestamp

    expected = {name: p.expected_rows() for name, p in PROFILES.items()}
    counts = F.lit(False)
    for name, per in expected.items():
        same = F.lit(True)
        for family, n in per.items():
            same = same & (F.coalesce(F.try_element_at("rows", F.lit(family)), F.lit(0)) == n)
        counts = counts | ((F.col("profile") == name) & same)
    rules = [
        ("schema version", F.col("schema_version") == schema_version),
        ("profile", F.col("profile").isin(*PROFILES)),
        ("collection time", is_utc_timestamp(F.col("collected_at_utc"))),
        ("environment", (F.col("os") != "") & (F.col("arch") != "") & (F.col("cpus") > 0)),
        ("row counts", counts),
    ]
    found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules]), lambda x: x.isNotNull())
    return documents.select(F.explode(found).alias("rule"))
