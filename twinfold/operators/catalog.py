"""Catalog of books and alignments kept as Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_first(table: DataFrame, at: str, key: str) -> DataFrame:
    return table.orderBy(F.desc(at), F.desc(key))


def page(table: DataFrame, at: str, key: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit``, newest first; ties by key."""
    return newest_first(table, at, key).offset(offset).limit(limit)


def of_book(table: DataFrame, book, source: str, target: str, at: str, key: str) -> DataFrame:
    """Alignments with the book on either side, oldest first."""
    return table.where((F.col(source) == book) | (F.col(target) == book)).orderBy(at, key)


def with_books(jobs: DataFrame, books: DataFrame, key: str = "book_id") -> DataFrame:
    """Jobs (src_book_id, tgt_book_id) with both books' columns; a book is not aligned with itself."""
    side = lambda p: books.select(*[F.col(c).alias(f"{p}_{c}") for c in books.columns])
    return jobs.where("src_book_id <> tgt_book_id").join(side("src"), f"src_{key}").join(side("tgt"), f"tgt_{key}")


def labelled(table: DataFrame, labels: DataFrame, model: Column) -> DataFrame:
    """``table`` with ``label`` of its model from (model_id, model_label), else the model id itself."""
    return table.withColumn("model_id", model).join(labels, "model_id", "left").withColumn("label", F.coalesce("model_label", "model_id")).drop("model_label")


def add(rows: DataFrame, path: str) -> None:
    """Append rows with new ids and the time."""
    rows.withColumn("id", F.expr("uuid()")).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def remove(table: DataFrame, gone: DataFrame, key: str, path: str) -> None:
    """Write what remains after deletion to a new path; ``table`` is not touched."""
    table.join(gone.select(key), key, "left_anti").write.parquet(path)


def import_totals(pairs: DataFrame) -> DataFrame:
    """(pair_id, matched, src_total, tgt_total) of imported pairs."""
    kind = lambda k: F.count_if(F.col("alignment_type") == k)
    return pairs.groupBy("pair_id").agg(kind("1:1").alias("matched"), (kind("1:1") + kind("1:0")).alias("src_total"), (kind("1:1") + kind("0:1")).alias("tgt_total"))
