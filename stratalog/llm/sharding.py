"""Sharding by extendible hashing, native DataFrame operations only.

A document's hash is the first 60 bits of the MD5 of its key. A bucket is a hash prefix; the
directory holds one row per bucket. A bucket is split on one more bit only while its bytes exceed
the limit, so a document's bucket is the shortest prefix of its hash whose documents fit. Bytes
can only fall as a prefix grows, hence that length is found from the sums at each length, without
splitting one bit at a time: a round sums a histogram at ``bits_per_round`` more bits, rolls it up
to every shorter length, and only documents of buckets that are still too large enter the next
round. No window runs over a bucket and no list is collected, so hot prefixes cost nothing extra.

A bucket of which all documents have the same hash can't be split on hash bits (a key with many
rows, or one document above the limit). Its rows go to overflow pages: rows are dealt by a second
hash over (id, text length, digest), doubling the pages until each fits; identical rows, which no
hash tells apart, share a page, and a document above the limit has a page of its own, flagged by
``shard_bytes`` above the limit.

Cases: null text has 0 bytes, a null key hashes as the empty string, an empty table gives an empty
result, other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

HASH_BITS = 60
#: Limit of a shard: a few hundred documents, what a reader shuffles in memory.
LIMIT_BYTES = 1 << 18


def _directory(rows: DataFrame, limit: int, base: int, bits: int) -> DataFrame:
    """The directory at base + bits bits, a row for each prefix of that length that has documents:
    fine, and depth, prefix, shard_bytes, shard_docs, final of the bucket it points to. final is
    false where even the longest prefix doesn't fit and can be split further."""
    top = min(HASH_BITS, base + bits)
    fine = rows.groupBy(F.shiftright("h", HASH_BITS - top).alias("fine")).agg(
        F.sum("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("docs"),
        F.min("h").alias("lo"),
        F.max("h").alias("hi"),
    )
    levels = fine.select(
        "*", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")
    ).withColumn("prefix", F.expr(f"shiftright(fine, {top} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(
        F.sum("bytes").alias("shard_bytes"),
        F.sum("docs").alias("shard_docs"),
        ((F.sum("bytes") <= limit) | (F.min("lo") == F.max("hi"))).alias("final"),
    )
    pointed = F.min_by(
        F.struct("depth", "prefix", "shard_bytes", "shard_docs", "final"),
        F.when(F.col("final"), F.col("depth")).otherwise(top + 1 - F.col("depth") / (HASH_BITS + 1)),
    )
    return (
        levels.select("fine", "depth", "prefix")
        .join(sums, ["depth", "prefix"])
        .groupBy("fine")
        .agg(pointed.alias("b"))
        .select("fine", "b.*")
    )


def assign_shards(
    docs: DataFrame,
    limit_bytes: int = LIMIT_BYTES,
    key_col: str = "doc_id",
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_round: int = 12,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, bytes, shard (prefix bits, then ``.page`` for overflow
    pages), depth, shard_bytes, shard_docs."""
    text = text_or_empty(text_col)
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    rest = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.octet_length(text).cast("long").alias("bytes"),
            F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
            F.xxhash64(F.col(id_col), text).alias("h2"),
        ),
        "shard-rows",
    )
    base, placed = 0, None
    while True:
        top = min(HASH_BITS, base + bits_per_round)
        directory = materialize(_directory(rest, limit_bytes, base, bits_per_round), "shard-directory")
        found = rest.withColumn("fine", F.shiftright("h", HASH_BITS - top)).join(directory, "fine")
        ready = found.where("final")
        placed = ready if placed is None else placed.unionByName(ready)
        if directory.where("not final").isEmpty():
            break
        rest = materialize(found.where("not final").select(*rest.columns), "shard-rows")
        base = top
    placed = placed.withColumn("shard", F.expr("if(depth = 0, '', lpad(bin(prefix), depth, '0'))"))
    out = ["doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_docs"]
    fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("shard_docs") == 1)
    hot = placed.where(~fits)
    if hot.isEmpty():
        return placed.select(*out)
    return placed.where(fits).select(*out).unionByName(_overflow(hot, limit_bytes).select(*out))


def _overflow(hot: DataFrame, limit: int) -> DataFrame:
    """Pages of buckets that hash bits can't split."""
    rows = materialize(hot.select("doc_id", "bytes", "shard", "depth", "h2"), "shard-overflow")
    pages, out = 1, []
    while True:
        paged = rows.withColumn("page", F.pmod("h2", F.lit(pages)))
        sums = paged.groupBy("shard", "page").agg(
            F.sum("bytes").alias("shard_bytes"),
            F.count(F.lit(1)).alias("shard_docs"),
            (F.min("h2") < F.max("h2")).alias("splittable"),
        )
        sums = materialize(
            sums.groupBy("shard").agg(
                F.max((F.col("shard_bytes") > limit) & F.col("splittable")).alias("again")
            ).join(sums, "shard"),
            "shard-pages",
        )
        final = paged.join(sums.where("not again"), ["shard", "page"])
        out.append(final.withColumn("shard", F.concat_ws(".", "shard", F.col("page").cast("string"))))
        again = sums.where("again").select("shard").distinct()
        if again.isEmpty():
            break
        rows = materialize(rows.join(again, "shard", "left_semi"), "shard-overflow")
        pages *= 2
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES, id_col: str = "doc_id") -> None:
    """Write ``docs`` as one folder per shard."""
    shards = assign_shards(docs, limit_bytes, id_col, id_col).select(F.col("doc_id").alias(id_col), "shard")
    docs.join(shards.distinct(), id_col).repartition("shard").write.partitionBy("shard").parquet(path)


SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
         ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h
  FROM documents),
d AS (SELECT unnest(range(0, 41))::INT AS depth),
sums AS (
  SELECT depth, h >> ({HASH_BITS} - depth) AS prefix, sum(bytes)::BIGINT AS shard_bytes,
         count(*) AS shard_docs
  FROM rows, d GROUP BY ALL),
picked AS (
  SELECT r.doc_id, r.bytes, min(s.depth) AS depth
  FROM rows r JOIN sums s ON s.prefix = r.h >> ({HASH_BITS} - s.depth)
  WHERE s.shard_bytes <= {LIMIT_BYTES} OR s.shard_docs = 1 GROUP BY r.doc_id, r.bytes)
SELECT p.doc_id, p.bytes, CASE WHEN p.depth = 0 THEN '' ELSE
         lpad(bin(r.h >> ({HASH_BITS} - p.depth)), p.depth, '0') END AS shard,
       p.depth, s.shard_bytes, s.shard_docs
FROM picked p JOIN rows r USING (doc_id)
JOIN sums s ON s.depth = p.depth AND s.prefix = r.h >> ({HASH_BITS} - p.depth)
"""
