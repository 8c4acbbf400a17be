"""Alignment records as JSON: reading, with guards, and the tables inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPORTER, VERSION = "twinfold", 1
PAIR = "struct<pair_seq:int,src_text:string,tgt_text:string,src_sent_idx:int,src_para_idx:int,src_global_idx:int,tgt_sent_idx:int,tgt_para_idx:int,tgt_global_idx:int,alignment_type:string,confidence:double>"
PARAGRAPH = "struct<para_idx:int,text:string,image_ids:array<string>>"
SCHEMA = f"exported_by string, version int, pair_id string, src_lang string, tgt_lang string, pairs array<{PAIR}>, source_paragraphs array<{PARAGRAPH}>, target_paragraphs array<{PARAGRAPH}>, images array<struct<id:string,mime_type:string>>"


def read(records: DataFrame, json: str = "json") -> DataFrame:
    """``records`` with ``record``, null for broken or foreign input."""
    made = F.from_json(F.col(json), SCHEMA, {"mode": "PERMISSIVE"})
    return records.withColumn("record", made).withColumn("record", F.when((F.col("record.exported_by") == EXPORTER) & (F.col("record.version") == VERSION), F.col("record")))


def pairs(read_: DataFrame, key: str) -> DataFrame:
    return read_.where("record is not null").select(key, F.explode("record.pairs").alias("p")).select(key, "p.*")


def source_paragraphs(read_: DataFrame, key: str) -> DataFrame:
    """Source paragraphs only; records without them have no rows."""
    return read_.select(key, F.explode("record.source_paragraphs").alias("p")).select(key, "p.*")


def target_paragraphs(read_: DataFrame, key: str) -> DataFrame:
    return read_.select(key, F.explode("record.target_paragraphs").alias("p")).select(key, "p.*")


def images(read_: DataFrame, key: str) -> DataFrame:
    """(key, id, mime_type): the image list; payloads are not in records."""
    return read_.select(key, F.explode("record.images").alias("p")).select(key, "p.*")


def without_record(books: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Books that still need extraction: those that no record gave paragraphs for."""
    return books.join(found.select(key).distinct(), key, "left_anti")


def with_payload(refs: DataFrame, assets: DataFrame, own: Column, keys: tuple = ("book_id", "asset_id")) -> DataFrame:
    """``refs`` with ``payload`` from the assets (keys, data), or its own when none matches."""
    return refs.join(assets.select(*keys, "data"), list(keys), "left").withColumn("payload", F.coalesce("data", own)).drop("data")
