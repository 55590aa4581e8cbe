"""Connected components of an edge table, distributed.

Small-star and large-star rounds over (a, b) edges: every vertex's neighbours are pointed at the
smallest of them, until the edges are stars. Each round is two aggregations with map-side minima;
edges never outnumber the input, a hub's edges are rewritten row by row, not gathered, and nothing
but a count and a checksum reaches the driver. Each round is written to the shared folder, so a
lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link each neighbour above v to v's least neighbour (or v). Small star: link v
    and its neighbours below v to the least of them."""
    if large:
        links = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        links = edges
    least = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = links.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the least vertex reachable from v, for each vertex that has an edge and is
    not that vertex itself. edges: long columns a, b; loops and repeats are allowed."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e = materialize(e, "components")
    sign = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))]
    seen = e.agg(*sign).first()
    while seen[0]:
        e = materialize(_star(_star(e, True), False), "components")
        now = e.agg(*sign).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("v"), F.col("b").alias("component"))
