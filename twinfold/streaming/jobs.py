"""Streaming jobs: latest reading positions, and alignment of pairs as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators.progress import latest


def merge_positions(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Stored positions with a batch of events merged in; a greater time wins, so late events do no harm."""
    new = latest(batch)
    if stored is None:
        return new
    both = new.unionByName(stored.select(*new.columns))
    return both.groupBy("key").agg(F.max_by(F.struct("char_count", "total_chars", "ts"), F.struct("ts", "char_count")).alias("p")).select("key", "p.*")


def follow_positions(events: DataFrame, folder: str, checkpoint: str, watermark: str = "1 hour"):
    """Start a query that keeps the latest position per key under ``folder``, one version per batch.

    ``events`` is a stream of (event_id, key, ts, char_count, total_chars); replays within the
    watermark are dropped. The state is the newest version of the table, not the stream's own.
    """
    unique = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = read_version(spark, folder, number - 1)
        merge_positions(batch, stored).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_version(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    if number < 0:
        return None
    return spark.read.parquet(f"{folder}/version={number}")


def follow_latest(events: DataFrame, folder: str, checkpoint: str):
    """Start a query that keeps the latest position per key in Spark's state store.

    Each batch writes the keys that it touched to a folder of its own, so its cost follows the batch
    and not the table; a batch that is repeated overwrites its folder. Replayed and late events do
    no harm, as the greatest time wins. The state holds one row per key.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return latest(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """(key, char_count, total_chars, ts): the newest of what the batches of ``follow_latest`` wrote."""
    return latest(spark.read.parquet(folder).drop("batch"))


def follow_jobs(jobs: DataFrame, run: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, key: str = "pair_id"):
    """Start a query that runs new jobs and stores their rows under ``table``, a folder per batch.

    The keys of earlier jobs are in Spark's state store, so each pair is run once and no earlier
    batch is read. A batch that is repeated overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        run(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return jobs.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
