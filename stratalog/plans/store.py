"""A store of sorted runs on any Hadoop file system: flush, read, compact, vacuum.

Data files are Parquet, sorted by key with falling sequences, with a Bloom filter on the key and
row-group bounds; the manifest is a table of edits, one file a commit, written after the data it
names. Readers take the live files of the manifest, so an unfinished write is never seen. A store
holds a snapshot of the manifest (a row a live file) and updates it with its own commits, so it is
the only writer; other readers open a store of their own. Data stays distributed, and what the
manifest says of a file (bounds, count) is aggregated from what was written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import FAN_IN, live_files
from ..operators.state import latest_versions

EDIT = "ord long, action string, file string, tier int, min_key string, max_key string, n long, flushed_index long"
VERSION = "key string, seq long, value double, tombstone boolean"


class RunStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.refresh()

    # Manifest.

    def edits(self) -> DataFrame:
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], EDIT)
        return self.spark.read.schema(EDIT).parquet(f"{self.path}/manifest")

    def refresh(self) -> None:
        """Replay the manifest."""
        self._files: dict[str, tuple] = {}
        self._flushed, self._ord = -1, 0
        if not self._exists("manifest"):
            return
        edits = self.edits()
        rows = live_files(edits.where("file IS NOT NULL")).join(edits.where("action = 'add'"), "file").select(*edits.columns)
        self._files = {r["file"]: tuple(r) for r in rows.collect()}  # a row a live file
        self._flushed, self._ord = edits.agg(F.coalesce(F.max("flushed_index"), F.lit(-1)), F.coalesce(F.max("ord"), F.lit(0))).first()

    def live(self) -> DataFrame:
        """file, tier, bounds and count of the live files."""
        return self.spark.createDataFrame(list(self._files.values()), EDIT)

    def flushed_index(self) -> int:
        return self._flushed

    def _commit(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, EDIT).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        for row in rows:
            if row[1] == "remove":
                del self._files[row[2]]
        for row in rows:
            if row[1] == "add":
                self._files[row[2]] = row
            if row[7] is not None:
                self._flushed = max(self._flushed, row[7])
        self._ord = max(r[0] for r in rows)

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    # Data.

    def _write(self, rows: DataFrame, number: int) -> list[tuple]:
        """(part, name, min_key, max_key, n) of the files written, one a value of ``part`` (a whole
        number), all by one job. Rows are dealt by part and key range, and sorted."""
        name = f"{number:06d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.path}/data/{name}"
        (
            rows.repartitionByRange("part", "key").sortWithinPartitions("part", "key", F.desc("seq"))
            .write.option("parquet.bloom.filter.enabled#key", "true").partitionBy("part").parquet(path)
        )
        written = self.spark.read.schema(f"{VERSION}, part long").parquet(path)
        bounds = written.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"))
        return [(r["part"], f"{name}/part={r['part']}", r["lo"], r["hi"], r["n"]) for r in bounds.orderBy("part").collect()]  # a row a file

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], VERSION)
        return self.spark.read.schema(VERSION).parquet(*[f"{self.path}/data/{f}" for f in files])

    def flush(self, log: DataFrame, *through: int, tier: int = 0) -> None:
        """Write the winners of the versions above the flushed index, up to ``through``; of several
        bounds, each ends a generation with a file of its own, and all are written by one job. An
        empty generation still moves the index; one that would set it back is an error."""
        if min(through) < self._flushed or list(through) != sorted(through):
            raise ValueError(f"flush through {through} is below the flushed index {self._flushed}")
        new = log.where((F.col("seq") > self._flushed) & (F.col("seq") <= through[-1]))
        part = sum((F.col("seq") > t).cast("long") for t in through[:-1]) if len(through) > 1 else F.lit(0).cast("long")
        rows = latest_versions(new.withColumn("part", part), ["part", "key"]).select("part", "key", "seq", "value", "tombstone")
        number = self._ord + 1
        found = {r[0]: r for r in self._write(rows, number)}
        edits = []
        for i, top in enumerate(through):
            if i in found:
                _, name, lo, hi, n = found[i]
                edits.append((number + i, "add", name, tier, lo, hi, n, top))
            else:
                edits.append((number + i, "advance", None, None, None, None, None, top))
        self._commit(edits)

    def compact(self) -> int:
        """Merge FAN_IN files of the lowest tier that has as many into one of the next tier, until
        no tier has; the merges of a tier are one job. Tombstones are kept: an older version may
        lie in a run outside the merge."""
        merges = 0
        while True:
            tiers: dict[int, list[str]] = {}
            for row in self._files.values():
                tiers.setdefault(row[3], []).append(row[2])
            full = [t for t, names in tiers.items() if len(names) >= FAN_IN]
            if not full:
                return merges
            tier = min(full)
            names = sorted(tiers[tier])
            groups = [names[i : i + FAN_IN] for i in range(0, len(names) - FAN_IN + 1, FAN_IN)]
            rows = None
            for i, group in enumerate(groups):
                part = self._read(group).withColumn("part", F.lit(i).cast("long"))
                rows = part if rows is None else rows.unionByName(part)
            number = self._ord + 1
            edits = []
            for i, name, lo, hi, n in self._write(latest_versions(rows, ["part", "key"]).select("part", "key", "seq", "value", "tombstone"), number):
                edits += [(number + i, "remove", f, None, None, None, None, None) for f in groups[i]]
                edits.append((number + i, "add", name, tier + 1, lo, hi, n, None))
            self._commit(edits)
            merges += len(groups)

    def versions(self, key: str | None = None) -> DataFrame:
        """All live versions; with a key, of the runs whose bounds hold it, by a pushed-down filter."""
        files = [r[2] for r in self._files.values() if key is None or r[4] <= key <= r[5]]
        rows = self._read(files)
        return rows if key is None else rows.where(F.col("key") == key)

    def read(self, key: str | None = None) -> DataFrame:
        return latest_versions(self.versions(key)).where("NOT tombstone").select("key", "value", "seq")

    def vacuum(self) -> list[str]:
        """Delete data that no live edit names. Safe to repeat."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = root.getFileSystem(conf)
        gone = []
        for folder in fs.listStatus(root) if fs.exists(root) else []:
            name, held = folder.getPath().getName(), 0
            for part in fs.listStatus(folder.getPath()):
                file = f"{name}/{part.getPath().getName()}"
                if file in self._files:
                    held += 1
                elif part.isDirectory():
                    gone.append(file)
                    fs.delete(part.getPath(), True)
            if not held:
                fs.delete(folder.getPath(), True)
        return sorted(gone)
