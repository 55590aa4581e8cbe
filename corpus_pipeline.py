"""The corpus pipeline: raw documents to packed training sequences, one operator per stage.

Each stage works on what its predecessor kept, written as Parquet in the shared folder and read
again, so a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import exact_dedup, language_id, near_dedup, packing, substring_dedup
from stratalog.llm.common import documents, materialize, release


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that are not text in a known language go."""
    return language_id.language_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts, the document with the smallest id stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, with the stage's own parameters: of each group of texts linked by five-word
    shingles of similarity 0.8 or more, the document with the smallest id stays. The contract of
    the query op5 (three words, three bits) is its own."""
    return near_dedup.near_dedup(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: words covered by windows that start in a smaller document go."""
    kept = substring_dedup.substring_dedup(docs)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one row per piece of a packed sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("substring_dedup", substring),
    ("best_fit_packing", pack),
]

#: Language identification and packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark)
    return docs
