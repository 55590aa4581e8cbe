"""JSON documents: benchmark results (strict), fault schedules, corpus manifests, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

FAMILIES = {
    "write_throughput": schemas.WRITE_ROW, "point_read": schemas.POINT_READ_ROW, "bloom": schemas.BLOOM_ROW,
    "amplification": schemas.AMPLIFICATION_ROW, "compaction_pause": schemas.PAUSE_ROW, "skiplist": schemas.SKIPLIST_ROW,
}


def unknown_fields(text: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that a strict reader must refuse; from_json drops them silently."""
    return F.array_except(F.json_object_keys(text), F.array(*[F.lit(a) for a in allowed]))


def strict_rows(texts: DataFrame, family: str) -> DataFrame:
    """Rows of a benchmark family from a column ``text`` of JSON objects; unknown fields and
    malformed text stop the query."""
    schema = FAMILIES[family]
    names = [part.split()[0] for part in schema.split(", ")]
    extra = unknown_fields(F.col("text"), names)
    checked = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ",")))).otherwise(F.col("text"))
    return texts.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_bench(spark: SparkSession, path: str, family: str) -> DataFrame:
    return strict_rows(spark.read.text(path).withColumnRenamed("value", "text"), family)


def write_bench(rows: DataFrame, path: str) -> None:
    """JSON lines; the commit protocol makes the result appear whole or not at all."""
    rows.write.json(path)


def decode_schedules(texts: DataFrame) -> DataFrame:
    """seed, s from seed, text. Unknown fields are ignored, arrays may be null."""
    return texts.select("seed", F.from_json("text", schemas.FAULT_SCHEDULE).alias("s"))


def encode_schedules(schedules: DataFrame) -> DataFrame:
    return schedules.select("seed", F.to_json("s").alias("text"))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """seed, s of every schedule file of a corpus; the seed is in the file's name."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(
        F.regexp_extract("_metadata.file_name", r"seed-(\d+)\.json$", 1).alias("n"), F.col("value").alias("text")
    )
    return decode_schedules(files.where("n <> ''").select(F.col("n").cast("long").alias("seed"), "text"))


def corpus_violations(manifests: DataFrame, artifact: int = 1, generator: int = 5) -> DataFrame:
    """rule of whatever a corpus manifest must not hold. manifests: columns of CORPUS_MANIFEST."""
    rules = [
        ("artifact version", F.col("artifact_version") != artifact),
        ("generator version", F.col("generator_version") != generator),
        ("scripted seed", F.exists(F.coalesce("scripted", F.array().cast("array<struct<name:string,seed:bigint,schedule:string>>")), lambda s: s["seed"] == 0)),
        ("pinned seed", F.coalesce(F.col("pinned.seed") == 0, F.lit(False))),
        ("schedule name", F.coalesce(~F.col("pinned.schedule").rlike(r"^[a-z0-9-]+\.json$"), F.lit(False))),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return manifests.select(F.explode(found).alias("rule"))


def write_artifacts(schedules: DataFrame, history: DataFrame, trace: DataFrame, path: str) -> None:
    """The evidence of a run: schedule, history and trace, each in a folder of its own."""
    encode_schedules(schedules).write.json(f"{path}/schedule")
    history.write.json(f"{path}/history")
    trace.select("line").write.text(f"{path}/trace")
