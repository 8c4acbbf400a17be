"""Helpers of operators over whole tables: cut lineage, bounded Arrow batches, numbers, components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20


#: Bounds of an Arrow batch of whole texts; one text may be larger.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, named in spark.checkpoint.dir. Only a local master may do without: it gets a temporary one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage, in the folder that the cluster shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast when ``rows`` (counted by the caller) prove that it is small."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session set to send whole texts to Python in batches of bounded rows and bytes.

    Spark reads the two limits when a plan is run, not when it is written, so they stay lowered.
    """
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        now = conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))
    return df


def numbered(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with a gapless number from 0 in the given order, without one task seeing all rows.

    Rows are range-partitioned and kept; each partition numbers its own rows and adds the row count
    of the partitions before it (a table of one row per partition).
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + here - 1).drop("_part", "_start")


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with a gapless number from 0 within each key, without one task seeing all rows of a key."""
    rows = checkpointed(numbered(df, [F.col(c) for c in [*keys, *order]], "_number"))
    first = checkpointed(rows.groupBy(*keys).agg(F.min("_number").alias("_first")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    found = rows.join(broadcast_if_small(first, first.count(), 64), same)
    return found.withColumn(name, (F.col("_number") - F.col("_first")).cast("int")).select(*df.columns, name)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): the smallest node that it is connected with.

    Alternates large-star and small-star rounds until the edges no longer change; each round is two
    aggregations and joins by key, with the edges kept in the shared folder in between.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        both = edges.select(ways.alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        # each node goes to its smallest neighbour, and so do its other neighbours
        pair = F.when(F.col("v") == F.col("m"), F.struct(F.col("u"), F.col("m").alias("v"))).otherwise(F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(least, F.col("u") == F.col("w")).select(pair.alias("e")).select("e.u", "e.v")
        edges = checkpointed(small.where("u <> v").distinct())
