"""Books and alignments in a store: a folder of Parquet writes, dealt to buckets by id.

Each write is a folder of its own, so writers don't disturb one another, and deletion writes only
the ids that go: no stored row is rewritten. ``compacted`` copies what is left to a new store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators.shared import checkpointed

BUCKETS = 64


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: int) -> None:
    dealt = rows.withColumn("bucket", bucket_of(F.col("id"), buckets)).repartition("bucket")
    dealt.write.partitionBy("bucket").parquet(f"{path}/write={uuid.uuid4().hex}")


def add(rows: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Store ``rows`` with the time as ``created_at``; returns them as stored. Rows without a column ``id`` get new ids.

    An id that is stored twice has two rows; one that was deleted stays deleted.
    """
    made = rows if "id" in rows.columns else rows.withColumn("id", F.expr("uuid()"))
    # new ids are fixed before they are written, so that a repeated task gives the same ones
    made = checkpointed(made.withColumn("created_at", F.current_timestamp()).withColumn("gone", F.lit(False)))
    _write(made, path, buckets)
    return made.drop("gone")


def remove(ids: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Delete the rows of ``ids`` (id); ids that are not stored do no harm."""
    _write(ids.where("id is not null").select("id", F.lit(None).cast("timestamp").alias("created_at"), F.lit(True).alias("gone")).distinct(), path, buckets)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a store that are not deleted. ``schema`` names the columns besides created_at, in DDL."""
    log = spark.read.schema(f"{schema}, created_at timestamp, gone boolean, bucket int").parquet(path).drop("write")
    kept = log.where("not gone")
    return kept.join(log.where("gone").select("bucket", "id"), ["bucket", "id"], "left_anti").drop("gone")


def get(store: DataFrame, key, buckets: int = BUCKETS) -> DataFrame:
    """The row of an id: reads the files of its bucket only."""
    return store.where((F.col("bucket") == bucket_of(F.lit(key), buckets)) & (F.col("id") == key)).drop("bucket")


def listed(store: DataFrame) -> DataFrame:
    """All rows, newest first; ties by id."""
    return store.drop("bucket").orderBy(F.desc("created_at"), F.desc("id"))


def counted(store: DataFrame) -> DataFrame:
    """(n): how many rows are stored."""
    return store.agg(F.count("*").alias("n"))


def compacted(store: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write what is stored to a new store at ``path``, with its times; the old one is not touched."""
    _write(store.drop("bucket").withColumn("gone", F.lit(False)), path, buckets)
