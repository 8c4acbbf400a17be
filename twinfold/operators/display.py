"""Aligned pairs as displayed paragraphs: text, pairs, images, numbers, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions.text import is_blank

CHAPTERS, LEAST = 20, 50


def has_match() -> Column:
    return ~is_blank(F.col("src_text")) & ~is_blank(F.col("tgt_text"))


def paragraph_text() -> Column:
    """Aggregate: source sentences by sentence index (null first as 0), then order, joined by a space."""
    part = F.when(~is_blank(F.col("src_text")), F.struct(F.coalesce("src_sent_idx", F.lit(0)).alias("a"), F.col("pair_seq").alias("b"), F.col("src_text").alias("t")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), " ")


def grouped(pairs: DataFrame) -> DataFrame:
    """(pair_id, para_idx, text, n_pairs, pairs): pairs by source paragraph, none counting as paragraph 0."""
    cols = [c for c in pairs.columns if c not in ("pair_id", "pair_seq")]
    row = F.struct("pair_seq", *cols)
    return pairs.groupBy("pair_id", F.coalesce("src_para_idx", F.lit(0)).alias("para_idx")).agg(paragraph_text().alias("text"), F.count("*").alias("n_pairs"), F.array_sort(F.collect_list(row)).alias("pairs"))


def with_next_paragraph(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the source paragraph of those without one: that of the next pair that has one, else of the last before.

    Pairs of a text without any source paragraph keep none.
    """
    order = Window.partitionBy("pair_id")
    until_here = lambda *o: order.orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = lambda *o: F.last("src_para_idx", ignorenulls=True).over(until_here(*o))
    return pairs.withColumn("src_para_idx", F.coalesce(carried(F.desc("pair_seq")), carried(F.col("pair_seq"))))


def displayed(pairs: DataFrame, paragraphs: DataFrame | None = None, either_side: bool = False, orphan: str = "first") -> DataFrame:
    """(pair_id, display_idx, para_idx, text, image_ids, pairs).

    With source paragraphs (pair_id, para_idx, text, image_ids), each one with text or images is
    shown, in order, with the text of its pairs when it has any. Without, paragraphs come from the
    pairs. Pairs without source text are not shown, but with ``either_side`` (as exported) those with
    target text are. Pairs without a source paragraph are in paragraph 0, or with ``orphan='next'``
    in the paragraph of the next pair that has one.
    """
    found = grouped(with_next_paragraph(pairs) if orphan == "next" else pairs)
    none = F.array().cast("array<string>")
    shows = (lambda p: ~is_blank(p["src_text"]) | ~is_blank(p["tgt_text"])) if either_side else (lambda p: ~is_blank(p["src_text"]))
    if paragraphs is None:
        shown = found.where(F.exists("pairs", shows)).withColumn("image_ids", none)
    else:
        kept = paragraphs.where(~is_blank(F.col("text")) | (F.size(F.coalesce("image_ids", none)) > 0))
        shown = kept.withColumnRenamed("text", "raw").join(found, ["pair_id", "para_idx"], "left").withColumn("text", F.coalesce("text", "raw"))
    shown = shown.withColumn("pairs", F.filter(F.coalesce("pairs", F.array()), shows))
    order = Window.partitionBy("pair_id").orderBy("para_idx")
    return shown.withColumn("display_idx", F.row_number().over(order) - 1).select("pair_id", "display_idx", "para_idx", "text", F.coalesce("image_ids", none).alias("image_ids"), "pairs")


def exported(pairs: DataFrame, paragraphs: DataFrame, targets: DataFrame, mode: str = "both", orphan: str = "first") -> DataFrame:
    """(pair_id, display_idx, para_idx, images, pairs): paragraphs as exported, those with pairs or images of the mode.

    ``paragraphs`` and ``targets`` are (pair_id, para_idx, text, image_ids). A target paragraph's
    images go to the first paragraph with a pair that cites it, pairs without source text included.
    """
    shown = displayed(pairs, paragraphs, either_side=True, orphan=orphan)
    placed = placed_images(target_homes(shown), targets, shown)
    images = picked_images(mode, F.col("image_ids"), F.col("tgt_images"))
    rows = shown.join(placed, ["pair_id", "display_idx"], "left").withColumn("images", images).where((F.size("pairs") > 0) | (F.size("images") > 0))
    again = F.row_number().over(Window.partitionBy("pair_id").orderBy("display_idx")) - 1
    return rows.select("pair_id", again.alias("display_idx"), "para_idx", "images", "pairs")


def legacy_images(pairs: DataFrame, targets: DataFrame, mode: str = "both") -> DataFrame:
    """(pair_id, para_idx, images) for records without source paragraphs, whose pairs carry ``src_images``.

    A paragraph has the images of its first pair that has any, and those of the target paragraphs
    that its pairs cite, each one once, in the order of the first citation. Target paragraphs that
    no pair cites are not shown.
    """
    none = F.array().cast("array<string>")
    rows = pairs.select("pair_id", F.coalesce("src_para_idx", F.lit(0)).alias("para_idx"), "pair_seq", "tgt_para_idx", "src_images")
    has = F.size(F.coalesce("src_images", none)) > 0
    own = rows.groupBy("pair_id", "para_idx").agg(F.min_by(F.when(has, F.col("src_images")), F.when(has, F.col("pair_seq"))).alias("own"))
    cited = rows.where("tgt_para_idx is not null").groupBy("pair_id", "para_idx", "tgt_para_idx").agg(F.min("pair_seq").alias("seq"))
    known = targets.where(F.size("image_ids") > 0).select("pair_id", F.col("para_idx").alias("tgt_para_idx"), "image_ids")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "tgt_para_idx", "image_ids")))
    theirs = cited.join(known, ["pair_id", "tgt_para_idx"]).groupBy("pair_id", "para_idx").agg(F.flatten(F.transform(ordered, lambda x: x["image_ids"])).alias("theirs"))
    both = own.join(theirs, ["pair_id", "para_idx"], "left")
    return both.select("pair_id", "para_idx", picked_images(mode, F.coalesce("own", none), F.col("theirs")).alias("images"))


def target_homes(shown: DataFrame) -> DataFrame:
    """(pair_id, tgt_para_idx, display_idx): the first displayed paragraph that cites a target paragraph."""
    cited = shown.select("pair_id", "display_idx", F.explode("pairs").alias("p")).where("p.tgt_para_idx is not null")
    return cited.groupBy("pair_id", F.col("p.tgt_para_idx").alias("tgt_para_idx")).agg(F.min("display_idx").alias("display_idx"))


def placed_images(homes: DataFrame, targets: DataFrame, shown: DataFrame) -> DataFrame:
    """(pair_id, display_idx, tgt_images): images of target paragraphs (pair_id, para_idx, image_ids).

    A paragraph that nothing cites goes with the next one that is cited, else to the last place.
    """
    own = targets.where(F.size("image_ids") > 0).select("pair_id", F.col("para_idx").alias("at"), "image_ids", F.lit(None).cast("int").alias("home"))
    known = homes.select("pair_id", F.col("tgt_para_idx").alias("at"), F.lit(None).cast("array<string>").alias("image_ids"), F.col("display_idx").alias("home"))
    # from the last place backwards: a frame that only grows takes linear time
    onward = Window.partitionBy("pair_id").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    next_ = own.unionByName(known).withColumn("home", F.last("home", ignorenulls=True).over(onward)).where("image_ids is not null")
    last = shown.groupBy("pair_id").agg(F.max("display_idx").alias("last"))
    at = next_.join(last, "pair_id").withColumn("display_idx", F.coalesce("home", "last"))
    images = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "image_ids"))), lambda x: x["image_ids"]))
    return at.groupBy("pair_id", "display_idx").agg(images.alias("tgt_images"))


def picked_images(mode: str, source: Column, target: Column) -> Column:
    none = F.array().cast("array<string>")
    return {"source": source, "target": F.coalesce(target, none), "both": F.concat(source, F.coalesce(target, none)), "none": none}[mode]


def numbered(shown: DataFrame) -> DataFrame:
    """(pair_id, display_idx, pair_idx, number, src_text, tgt_text): displayed pairs counted from 1."""
    rows = shown.select("pair_id", "display_idx", F.posexplode("pairs").alias("pair_idx", "p"))
    order = Window.partitionBy("pair_id").orderBy("display_idx", "pair_idx")
    return rows.select("pair_id", "display_idx", "pair_idx", F.row_number().over(order).alias("number"), "p.src_text", "p.tgt_text", "p.alignment_type")


def chapters(shown: DataFrame, title: Column | None = None) -> DataFrame:
    """``shown`` with chapter_idx, chapter_id and chapter_title: at most 20 of 50 paragraphs or more."""
    sizes = shown.groupBy("pair_id").agg((F.max("display_idx") + 1).alias("_n"))
    size = F.greatest(F.lit(LEAST), F.ceil(F.col("_n") / CHAPTERS))
    out = shown.join(sizes, "pair_id").withColumn("chapter_idx", F.floor(F.col("display_idx") / size).cast("int")).withColumn("_n", F.ceil(F.col("_n") / size))
    n = F.col("_n")
    part = F.concat(F.lit("Part "), (F.col("chapter_idx") + 1).cast("string"), F.lit(" of "), n.cast("string"))
    name = F.when(n > 1, part).otherwise(F.coalesce(title, part) if title is not None else part)
    return out.withColumn("chapter_id", F.concat(F.lit("ch"), F.lpad((F.col("chapter_idx") + 1).cast("string"), 3, "0"))).withColumn("chapter_title", name).drop("_n")
