"""Pair TSV files to pairs, file metadata and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions.text import trim


def lines(files: DataFrame, key: str = "file", content: str = "content") -> DataFrame:
    """(key, line_no, line) without the byte order mark; line_no from 1."""
    text = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), "^﻿", "")
    return files.select(key, F.posexplode(F.split(text, "\r?\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def classified(rows: DataFrame, key: str = "file") -> DataFrame:
    """Lines with ``kind``: blank, meta, header, fatal, after (a fatal line), width, empty or pair."""
    cells = F.split("line", "\t")
    meta, blank = F.col("line").startswith("#"), trim(F.col("line")) == ""
    other = rows.withColumn("cells", cells).withColumn("meta", ~blank & meta).withColumn("blank", blank)
    data = ~F.col("blank") & ~F.col("meta")
    book = Window.partitionBy(key)
    head = data & (F.lower(F.col("cells")[0]) == "source_text")
    other = other.withColumn("header_at", F.min(F.when(head, F.col("line_no"))).over(book))
    body = data & ~F.col("line_no").eqNullSafe(F.col("header_at"))
    other = other.withColumn("first_at", F.min(F.when(body, F.struct("line_no", F.size("cells").alias("n")))).over(book))
    # without a header before it, the first data row fixes the format
    stop = ~F.col("first_at.n").isin(2, 3) & (F.col("header_at").isNull() | (F.col("header_at") > F.col("first_at.line_no")))
    other = other.withColumn("stop_at", F.when(stop, F.col("first_at.line_no")))
    src, tgt = trim(F.col("cells")[0]), trim(F.get("cells", F.lit(1)))
    kind = (
        F.when(F.col("line_no") > F.col("stop_at"), "after").when(F.col("blank"), "blank").when(F.col("meta"), "meta").when(F.col("line_no") == F.col("header_at"), "header")
        .when(F.col("line_no") == F.col("stop_at"), "fatal").when(~F.size("cells").isin(2, 3), "width").when((src == "") & (tgt == ""), "empty").otherwise("pair")
    )
    return other.select(key, "line_no", "line", "cells", kind.alias("kind"), src.alias("src_text"), tgt.alias("tgt_text"))


def confidence_of(cell):
    """A score's number, read as far as it is one; null outside 0..1."""
    number = F.regexp_extract(cell, r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", 0).try_cast("double")
    return F.when(number.between(0, 1), number)


def pairs(kinds: DataFrame, key: str = "file") -> DataFrame:
    """(key, pair_seq, src_text, tgt_text, alignment_type, confidence, bad_score)."""
    kind = F.when(F.col("src_text") == "", "0:1").when(F.col("tgt_text") == "", "1:0").otherwise("1:1")
    cell = trim(F.get("cells", F.lit(2)))
    scored = (F.col("alignment_type") == "1:1") & (F.coalesce(cell, F.lit("")) != "")
    out = kinds.where("kind = 'pair'").withColumn("alignment_type", kind).withColumn("confidence", F.when(scored, confidence_of(cell))).withColumn("bad_score", scored & F.col("confidence").isNull())
    return out.withColumn("pair_seq", F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1).select(key, "pair_seq", "line_no", "src_text", "tgt_text", "alignment_type", "confidence", "bad_score")


def metadata(kinds: DataFrame, key: str = "file", exporter: str = "twinfold") -> DataFrame:
    """(key, own, source_title, target_title, src_lang, tgt_lang) from the # lines; a later line wins, except in the old forms."""
    meta = kinds.where("kind = 'meta'").select(key, "line_no", trim(F.substring("line", 2, 1_000_000)).alias("m"))
    last = lambda name, value=None: F.max_by(trim(F.substring("m", len(name) + 2, 1_000_000)) if value is None else value, F.when(F.col("m").startswith(f"{name}="), F.col("line_no")))
    old = F.col("m").contains("↔") & ~F.col("m").contains("=")
    title = lambda k: F.min_by(trim(F.get(F.split("m", "↔"), F.lit(k))), F.when(old, F.col("line_no")))
    lang = F.split(F.substring("m", 10, 1_000_000), r"\s+")[0]
    beside = F.nullif(F.regexp_extract("m", r"^src_lang=.*tgt_lang=(\S+)", 1), F.lit(""))
    empty = F.lit("")
    found = meta.groupBy(key).agg(
        F.bool_or(F.col("m").startswith(f"exported_by={exporter}")).alias("own"),
        F.coalesce(last("source_title"), title(0), empty).alias("source_title"),
        F.coalesce(last("target_title"), title(1), empty).alias("target_title"),
        F.coalesce(last("src_lang", lang), empty).alias("src_lang"),
        F.coalesce(last("tgt_lang"), F.max(beside), empty).alias("tgt_lang"),
    )
    return kinds.select(key).distinct().join(found, key, "left").fillna("", ["source_title", "target_title", "src_lang", "tgt_lang"]).fillna(False, ["own"])


def issues(kinds: DataFrame, found: DataFrame, key: str = "file") -> DataFrame:
    """(key, line_no, level, issue): fatal and skipped lines, bad scores, files without rows."""
    level = F.when(F.col("kind") == "fatal", "error").otherwise("warning")
    by_line = kinds.where("kind in ('fatal', 'width', 'empty')").select(key, "line_no", level.alias("level"), F.col("kind").alias("issue"))
    scores = found.where("bad_score").select(key, "line_no", F.lit("warning").alias("level"), F.lit("score").alias("issue"))
    none = kinds.groupBy(key).agg(F.bool_or(F.col("kind").isin("pair", "fatal")).alias("some")).where("not some").select(key, F.lit(None).cast("int").alias("line_no"), F.lit("error").alias("level"), F.lit("no rows").alias("issue"))
    return by_line.unionByName(scores).unionByName(none)
