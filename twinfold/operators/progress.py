"""Reading positions and view preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions.text import utf16_length


def char_starts(paragraphs: DataFrame, key: str = "book_id", text: str = "text") -> DataFrame:
    """(key, para_idx, start, n_chars): UTF-16 units before each paragraph; a last row has the total."""
    before = Window.partitionBy(key).orderBy("para_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = paragraphs.select(key, "para_idx", utf16_length(F.coalesce(F.col(text), F.lit(""))).alias("n_chars"))
    total = rows.groupBy(key).agg((F.max("para_idx") + 1).alias("para_idx"), F.lit(0).cast("long").alias("n_chars"))
    return rows.unionByName(total).select(key, "para_idx", F.coalesce(F.sum("n_chars").over(before), F.lit(0)).alias("start"), "n_chars")


def paragraph_at(positions: DataFrame, starts: DataFrame, key: str = "book_id") -> DataFrame:
    """``positions`` (key, char) with the paragraph that a character is in: the last start at or before it.

    Both are put in one order, so that the join is a window by book instead of a range join.
    """
    real = starts.where("n_chars > 0 or start = 0").select(key, F.col("start").alias("at"), F.lit(0).alias("side"), "para_idx", *[F.lit(None).cast(t).alias(c) for c, t in positions.dtypes if c != key])
    asked = positions.select(key, F.greatest(F.col("char"), F.lit(0)).cast("long").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("para_idx"), *[c for c in positions.columns if c != key])
    upto = Window.partitionBy(key).orderBy("at", "side", F.col("para_idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return real.unionByName(asked).withColumn("para_idx", F.last("para_idx", ignorenulls=True).over(upto)).where("side = 1").select(*positions.columns, "para_idx")


def page_start(pages: DataFrame, layout: DataFrame, key: str = "book_id") -> DataFrame:
    """``pages`` (key, page, width, gap) with char: the first paragraph at or after the page's left edge, else the total.

    ``layout`` is (key, start, offset_left); the total is the row with the largest start.
    """
    total = layout.groupBy(key).agg(F.max("start").alias("total"))
    real = layout.where("offset_left is not null").select(key, F.col("offset_left").cast("double").alias("at"), F.lit(1).alias("side"), "start", *[F.lit(None).cast(t).alias(c) for c, t in pages.dtypes if c != key])
    asked = pages.select(key, (F.col("page") * (F.col("width") + F.col("gap"))).cast("double").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("start"), *[c for c in pages.columns if c != key])
    # from the end backwards: a frame that only grows takes linear time
    onward = Window.partitionBy(key).orderBy(F.desc("at"), F.desc("side"), F.desc("start")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return real.unionByName(asked).withColumn("start", F.last("start", ignorenulls=True).over(onward)).where("side = 0").join(total, key).select(*pages.columns, F.coalesce("start", "total").alias("char"))


def latest(events: DataFrame, key: str = "key") -> DataFrame:
    """(key, char_count, total_chars, ts): the newest valid position of each key."""
    valid = events.where("char_count >= 0 and total_chars > 0 and not isnan(char_count) and not isnan(total_chars)")
    return valid.groupBy(key).agg(F.max_by(F.struct("char_count", "total_chars", "ts"), F.struct("ts", "char_count")).alias("p")).select(key, "p.*")


def merged_preferences(events: DataFrame, fields: dict[str, Column], key: str = "key") -> DataFrame:
    """(key, fields): the newest valid value of each field; a field's column is null where it is absent or invalid."""
    marked = events.select(key, "ts", *[c.alias(n) for n, c in fields.items()])
    return marked.groupBy(key).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.struct("ts", n))).alias(n) for n in fields])


def restored(wanted: DataFrame, saved: DataFrame, default: Column, key: str = "key") -> DataFrame:
    """``wanted`` (key, explicit) with value: the explicit one, else what was saved, else the default."""
    return wanted.join(saved.select(key, F.col("char_count").alias("_saved")), key, "left").withColumn("value", F.coalesce("explicit", "_saved", default)).drop("_saved")


def percent(chars: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100.0 * chars / total + 0.5).cast("long")).otherwise(0)
