"""Exact deduplication by content hash, native DataFrame operations only.

Texts are grouped by the 128-bit MD5 of their normalised form *and* by the normalised bytes: the
hash routes rows, the grouping itself compares bytes, so two texts that share a hash stay apart.
``min`` and ``count`` combine on the map side, so of a text with a billion copies each map task
shuffles one row. What goes back to the documents is narrow (hash, digest, two numbers) and holds
only texts that occur twice or more; that join has no window and no collected list, so the
adaptive skew join can split a hot group.

Cases: null text counts as empty, and all empty texts are equal; rows that repeat an id and its
text count in ``group_size`` and are all kept if that id is the smallest; a null id never is the
id that stays unless the whole group has null ids. ``exact_dedup`` drops rows, not ids: a row goes
by its id, its hash and its digest, so of an id that has several texts only the copies go. An
empty table gives an empty result; other columns, of whatever name, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_RUN, text_or_empty


def _hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _norm(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), WS_RUN, " ")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("doc_id"), _norm(text_col).alias("norm")).withColumn("h", _hash(F.col("norm")))
    digest = F.sha2("norm", 256).alias("text_sha256")
    copies = (
        texts.groupBy("h", "norm")
        .agg(F.min("doc_id").alias("group_min"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h", digest, "group_min", "n")
    )
    return texts.select("doc_id", "h", digest).join(copies, ["h", "text_sha256"], "left")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return _groups(docs, id_col, text_col).select(
        "doc_id",
        F.coalesce("group_min", "doc_id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | F.col("group_min").eqNullSafe(F.col("doc_id"))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``. The rows judged as copies are
    anti-joined on id, hash and digest; the id spreads a hot group over all tasks."""
    gone = _groups(docs, id_col, text_col).where("n IS NOT NULL AND NOT (group_min <=> doc_id)").select("doc_id", "h", "text_sha256")
    norm = _norm(text_col)
    same = (F.col("row." + id_col).eqNullSafe(F.col("doc_id"))) & (F.col("row_h") == F.col("h")) & (F.col("row_sha256") == F.col("text_sha256"))
    rows = docs.select(F.struct("*").alias("row"), _hash(norm).alias("row_h"), F.sha2(norm, 256).alias("row_sha256"))
    return rows.join(gone.hint("shuffle_hash"), same, "left_anti").select("row.*")


#: DuckDB.
SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
  FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept,
       sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
