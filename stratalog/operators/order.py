"""Running values against the order of rows, without a task that has all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def least_later(rows: DataFrame, by: list[str], bucket: Column, order: list[str], value: str, later: str, wide: int = 4096, levels: int = 2) -> DataFrame:
    """rows with ``later``: the least ``value`` of all later rows of the same ``by``, nulls last.
    ``bucket`` must not fall along ``order``; a task has one bucket. The least value of later
    buckets, found the same way over ``wide`` buckets at a time, is a row at the end of each.

    Windows run from the last row back: a frame that ends at the last row is computed anew for
    every row by Spark, which is quadratic; one that begins at the first is not."""
    b = rows.withColumn("_bucket", bucket)
    if levels:
        per = b.groupBy(*by, "_bucket").agg(F.min(value).alias(value))
        carried = least_later(per.withColumnRenamed("_bucket", "_b"), by, F.floor(F.col("_b") / wide), ["_b"], value, "_later", wide, levels - 1)
        carried = carried.select(*by, F.col("_b").alias("_bucket"), F.col("_later").alias(value), F.lit(True).alias("_end"))
        b = b.withColumn("_end", F.lit(False)).unionByName(carried.where(F.col(value).isNotNull()), allowMissingColumns=True)
        order, within = ["_end", *order], [*by, "_bucket"]
    else:
        within = by
    w = Window.partitionBy(*within).orderBy(*[F.col(c).desc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = b.withColumn(later, F.min(value).over(w))
    return out.where("NOT _end").drop("_end", "_bucket") if levels else out.drop("_bucket")
