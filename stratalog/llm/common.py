"""What the training-data operators share: white space, shared storage, worker-side caches.

Functions sent to executors are pickled by value, so a cluster needs no copy of this package;
``process_cache`` then keeps models and vocabularies once per Python worker rather than per task.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: The white space of all contracts: space, and tab to carriage return.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only local mode, where one machine
    is the cluster, falls back on a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stratalog-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, a lost
    executor costs no recomputation, and a table used twice is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Texts in one Arrow batch, at most: what a task holds at a time, on either side.
BATCH_ROWS = 2_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``BATCH_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def process_cache(key: tuple, make: Callable[[], Any]) -> Any:
    """One object per key and Python process."""
    store = sys.__dict__.setdefault("_stratalog_process_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more. Between the
    written steps of a long job this keeps the disk it needs at what one step needs. The listener
    bus holds the plan of the last query until another event comes, hence the trivial query."""
    import gc
    import time

    gc.collect()
    spark.range(1).count()
    time.sleep(0.2)
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)
