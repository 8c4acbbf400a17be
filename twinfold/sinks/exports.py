"""Pairs as TSV lines, records as JSON, images listed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.sources.records import EXPORTER, VERSION


def four_places(x: Column) -> Column:
    """The exact value of a double to four places, ties away from zero; from 256 on by its shortest digits.

    The value is cut at 2^-30, so that both parts times 10,000 are exact.
    """
    size = F.abs(x)
    high = F.floor(size * float(1 << 30)) / float(1 << 30)
    units = F.floor(high * 10000)
    up = (size - high) * 10000 >= 0.5 - (high * 10000 - units)
    made = F.format_string("%.4f", (units + up.cast("long")) / 10000)
    return F.when(size < 256, F.concat(F.when(x < 0, "-").otherwise(""), made)).otherwise(F.format_string("%.4f", x))


def tsv_lines(pairs: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(pair_id, line_no, line): header lines have line_no below 0, rows keep pair_seq.

    ``titles`` is (pair_id, source_title, target_title, src_lang, tgt_lang). A source text that
    starts with # gets a leading space, so that it is not read as metadata.
    """
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[\t\n]", " ")
    src = F.when(F.col("src_text").startswith("#"), F.concat(F.lit(" "), flat("src_text"))).otherwise(flat("src_text"))
    score = F.when(F.col("confidence").isNull(), "").otherwise(four_places(F.col("confidence")))
    rows = pairs.select("pair_id", F.col("pair_seq").alias("line_no"), F.concat_ws("\t", src, flat("tgt_text"), score).alias("line"))
    n = pairs.groupBy("pair_id").agg(F.count("*").alias("n"))
    if titles is not None:
        n = n.join(titles, "pair_id", "left")
    value = lambda c: F.coalesce(F.col(c), F.lit("")) if titles is not None else F.lit("")
    heads = [F.lit(f"# exported_by={EXPORTER}"), *[F.concat(F.lit(f"# {k}="), value(k)) for k in ("source_title", "target_title", "src_lang", "tgt_lang")], F.concat(F.lit("# total_pairs="), F.col("n")), F.lit("source_text\ttarget_text\tconfidence")]
    head = n.select("pair_id", F.posexplode(F.array(*heads)).alias("k", "line")).select("pair_id", (F.col("k") - len(heads)).alias("line_no"), "line")
    return head.unionByName(rows)


def write_tsv(lines: DataFrame, path: str, files: int | None = None) -> None:
    """One folder per pair with one file, its lines in order; no pair is one value.

    Pairs are dealt to ``files`` tasks (the session's shuffle partitions by default), which sort their
    lines by pair and line and write them one by one.
    """
    n = files or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartition(n, "pair_id").sortWithinPartitions("pair_id", "line_no")
    dealt.select("pair_id", F.col("line").alias("value")).write.partitionBy("pair_id").text(path)


def record_json(pairs: DataFrame, langs: DataFrame, sources: DataFrame | None = None, targets: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """(pair_id, json): one record per pair, image payloads left out.

    ``sources`` and ``targets`` are (pair_id, para_idx, text, image_ids), ``images`` is
    (pair_id, id, mime_type). What is not given is left out of the record.
    """
    listed = lambda rows, *cols: rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("_list"))
    body = listed(pairs, "pair_seq", *[c for c in pairs.columns if c not in ("pair_id", "pair_seq")]).withColumnRenamed("_list", "pairs").join(langs, "pair_id", "left")
    extra = []
    for name, rows, cols in (("source_paragraphs", sources, ("para_idx", "text", "image_ids")), ("target_paragraphs", targets, ("para_idx", "text", "image_ids")), ("images", images, ("id", "mime_type"))):
        if rows is not None:
            body, extra = body.join(listed(rows, *cols).withColumnRenamed("_list", name), "pair_id", "left"), [*extra, name]
    made = F.struct(F.lit(EXPORTER).alias("exported_by"), F.lit(VERSION).alias("version"), "pair_id", "src_lang", "tgt_lang", "pairs", *extra)
    return body.select("pair_id", F.to_json(made).alias("json"))


def distinct_images(refs: DataFrame, order: list, key: str = "book_id") -> DataFrame:
    """The first reference of each image of a book, with the file name that it is stored under."""
    first = F.row_number().over(Window.partitionBy(key, "asset_id").orderBy(*order))
    name = F.concat(F.lit("src_"), F.regexp_replace("asset_id", "[^A-Za-z0-9._-]", "_"))
    return refs.withColumn("_n", first).where("_n = 1").drop("_n").withColumn("file_name", name)


def has_scores(pairs: DataFrame) -> DataFrame:
    """(pair_id, has_confidence): whether any 1:1 row has a score."""
    return pairs.groupBy("pair_id").agg(F.bool_or((F.col("alignment_type") == "1:1") & F.col("confidence").isNotNull()).alias("has_confidence"))
