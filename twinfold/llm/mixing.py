"""Mixing sources to target weights by hash-threshold histograms.

Every document has a stable 60-bit hash. Words are summed by source and hash bucket; the bucket in
which a source's running sum crosses its budget is refined, 12 bits at a time, until it holds one
hash value. A document is then taken by comparing its hash with its source's cut: no sort, and a
larger budget always takes a superset.

Defined results: a null text has size 0, a null source is a source of its own (last in order), a
null id hashes like the empty string; rows that repeat an id are taken together; a source without
words has target 0; an empty table gives an empty result. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.common import broadcast_if_small, checkpointed, numbered, words

WEIGHTS = (1, 2, 3)
CAP = 3
BITS, LEVEL_BITS = 60, 12


def order_hash(id_col: Column, seed: int = 0) -> Column:
    """60 bits of the md5 of the id, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), id_col.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source_size, target, repeats and remainder for each row (key, source, source_size) of ``sizes``.

    Sources by code point, null last, take the weights in turn. A target above ``cap`` times its
    source is cut to that and the excess shared out by weight again, until none is above.
    """
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = checkpointed(ranked.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("most")
        n, held, free = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("most")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = float(total - held) / float(free), n
    target = F.least(F.col("weight") * F.lit(level or 0.0), F.col("most").cast("double"))
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("long")
    return ranked.select("key", "source_size", target.alias("target"), whole.alias("repeats"), (target - whole * F.col("source_size")).alias("remainder"))


def mixing_plan(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """(rows, plan, number of sources): rows has id, key, size, hash; plan has key, source_size, target, repeats, cut.

    A document is taken ``repeats`` times, and once more if its hash is below ``cut``.
    """
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("key"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), order_hash(F.col(id_col), seed).alias("hash")))
    plan = checkpointed(targets(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size")), weights, cap))
    n = plan.count()
    open_ = plan.where("remainder > 0").select("key", F.col("remainder").alias("left"), F.lit(0).cast("long").alias("prefix"))
    cuts, used = None, 0
    while True:
        used += LEVEL_BITS
        step = rows.join(broadcast_if_small(open_, n, 64), "key").where(F.shiftright("hash", BITS - used + LEVEL_BITS) == F.col("prefix")) if used > LEVEL_BITS else rows.join(broadcast_if_small(open_, n, 64), "key")
        bucket = step.groupBy("key", "left", F.shiftright("hash", BITS - used).alias("bucket")).agg(F.sum("size").alias("sum"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        by_bucket = Window.partitionBy("key").orderBy("bucket")
        run = bucket.withColumn("upto", F.sum("sum").over(by_bucket)).where("upto > left")
        edge = run.groupBy("key").agg(F.min_by(F.struct("left", "bucket", "sum", "upto", "low", "high"), "bucket").alias("e")).select("key", "e.*")
        edge = checkpointed(edge.withColumn("left", F.col("left") - (F.col("upto") - F.col("sum"))))
        # the last hash value is taken when that comes nearer to the budget than leaving it
        done = edge.where("low = high").select("key", F.when(F.col("sum") - F.col("left") < F.col("left"), F.col("low") + 1).otherwise(F.col("low")).alias("cut"))
        cuts = done if cuts is None else cuts.unionByName(done)
        open_ = edge.where("low < high").select("key", "left", F.col("bucket").alias("prefix"))
        if used >= BITS or open_.isEmpty():
            break
    return rows, checkpointed(plan.join(cuts, "key", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))), n


def times(hash_: Column) -> Column:
    return F.col("repeats") + (hash_ < F.col("cut")).cast("long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` in the mix: each row as often as it is taken; texts are not shuffled."""
    _, plan, n = mixing_plan(docs, weights, cap, seed, id_col, text_col, source_col)
    rows = docs.select(F.struct("*").alias("row"), source_key(F.col(source_col)).alias("key"), order_hash(F.col(id_col), seed).alias("hash"))
    joined = rows.join(broadcast_if_small(plan.select("key", "repeats", "cut"), n, 64), "key").withColumn("n", times(F.col("hash"))).where("n > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op8_mixing(spark, sf_dir):
    rows, plan, n = mixing_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.join(broadcast_if_small(plan, n, 64), "key").select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * times(F.col("hash"))).alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('0|' || doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT k, source, sum(size)::BIGINT AS source_size FROM d GROUP BY k, source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
q AS (SELECT *, 3 * source_size AS most, (3.0::DOUBLE * source_size) / w AS ratio FROM r),
f AS (SELECT *, (SELECT sum(source_size) FROM s) AS total,
        coalesce(sum(most) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        sum(w) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM q),
l AS (SELECT (total - held)::DOUBLE / free::DOUBLE AS lam FROM f WHERE (total - held)::DOUBLE / free <= ratio ORDER BY ratio, k LIMIT 1),
t AS (SELECT k, source_size, least(w * lam, most::DOUBLE) AS target FROM f, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS repeats FROM t),
c AS (SELECT d.doc_id, d.size, d.h, p.*, p.target - p.repeats * p.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.k ORDER BY d.h) AS upto,
        sum(d.size) OVER (PARTITION BY d.k, d.h) AS same FROM d JOIN p ON d.k = p.k)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (repeats + CASE WHEN rest > 0 AND (upto <= rest OR (upto - same <= rest AND same - (rest - (upto - same)) < rest - (upto - same))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
