"""Exact duplicates with a heavy-hitter split.

A Misra-Gries pass (``freqItems``) finds digests that may be frequent; their exact counts and
winners are verified by one small aggregation and broadcast, so that rows of the hottest groups are
decided where they are read. All other digests, each below the support, go through one shuffle of
(digest, id) rows. Texts never move.

Defined results: a null text is an empty text; an empty table gives an empty result; a null id wins
only over nothing (ids order with null last); of rows that repeat id and text, one stays. Other
columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.common import SPACE, broadcast_if_small, checkpointed

#: A digest held by this share of rows or more is a heavy hitter; there are at most 1 / SUPPORT.
SUPPORT = 0.001


def digest(text: Column) -> Column:
    """SHA-256 of the text after every run of ASCII white space became one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ").cast("binary"), 256)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    base = checkpointed(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")).withColumn("row", F.monotonically_increasing_id()))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    least = base.count() * support

    frequent = base.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    verified = base.join(F.broadcast(frequent), "digest").groupBy("digest").agg(F.min(rank).alias("winner"), F.count("*").alias("group_size")).where(F.col("group_size") >= least)
    verified = F.broadcast(checkpointed(verified))  # at most 1 / support rows

    hot = base.join(verified, "digest")
    group = Window.partitionBy("digest")
    rest = base.join(verified, "digest", "left_anti").select("digest", "id", "row", F.min(rank).over(group).alias("winner"), F.count("*").over(group).alias("group_size"))
    return hot.unionByName(rest).select(
        F.col("id").alias(id_col),
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the smallest id."""
    found = checkpointed(duplicate_groups(docs, id_col, text_col, support).where("not kept"))
    again = F.col(id_col).eqNullSafe(F.col("keep_id"))  # the row that stays, repeated
    lost = found.where(~again).select(F.col(id_col).alias("lost_id"), F.col("text_sha256").alias("lost_digest"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("digest") == F.col("lost_digest"))
    left = rows.join(broadcast_if_small(lost, lost.count(), 128), same, "left_anti")
    if not found.where(again).isEmpty():
        left = left.dropDuplicates(["id", "digest"])
    return left.select("row.*")


def op7_exact_dedup(spark, sf_dir):
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
"""
