"""The tables that the registered queries read, in the library's shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.functions import sentence_breaks as breaks
from twinfold.sources.paragraphs import text_paragraphs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "book_id")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(books(spark, sf_dir))


def lines_of(some_books: DataFrame) -> DataFrame:
    """Each line of a book as a paragraph."""
    return text_paragraphs(some_books, delimiter="\n")


def label_sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as two sequences per pair: labels 0 and 1, 2 and 3, ... in order of vec_id, a pair for each block of ids."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null").withColumn("block", F.floor(F.col("vec_id") / BLOCK))
    at = F.row_number().over(Window.partitionBy("label", "block").orderBy("vec_id")) - 1
    rows = rows.select((F.col("block") * 1000 + F.floor(F.col("label") / 2)).cast("long").alias("pair_id"), (F.col("label") % 2).alias("side"), at.alias("global_idx"), "embedding")
    return rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")


def side_sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of even and of odd labels as two sequences, a pair for each 250 ids: longer than the narrowest band."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null").withColumn("block", F.floor(F.col("vec_id") / 250))
    at = F.row_number().over(Window.partitionBy("block", F.col("label") % 2).orderBy("vec_id")) - 1
    rows = rows.select(F.col("block").cast("long").alias("pair_id"), (F.col("label") % 2).alias("side"), at.alias("global_idx"), "embedding")
    return rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pairs: the k-th user text with the k-th answer; three pairs to a paragraph."""
    rows = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) - 1)
    side = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    both = rows.groupBy(F.col("conv_id").alias("pair_id"), F.col("k").alias("pair_seq")).agg(side("user").alias("s"), side("assistant").alias("t")).where("s is not null or t is not null")
    idx = lambda c, v: F.when(F.col(c).isNotNull(), v).cast("int")
    k = F.col("pair_seq")
    kind = F.when(F.col("s").isNull(), "0:1").when(F.col("t").isNull(), "1:0").otherwise("1:1")
    score = F.when(kind == "1:1", F.least(F.char_length("s"), F.char_length("t")) / F.greatest(F.char_length("s"), F.char_length("t"), F.lit(1)))
    return both.select(
        "pair_id", k.cast("int").alias("pair_seq"), F.coalesce("s", F.lit("")).alias("src_text"), F.coalesce("t", F.lit("")).alias("tgt_text"),
        idx("s", k % 3).alias("src_sent_idx"), idx("s", F.floor(k / 3)).alias("src_para_idx"), idx("s", k).alias("src_global_idx"),
        idx("t", k % 3).alias("tgt_sent_idx"), idx("t", F.floor(k / 3)).alias("tgt_para_idx"), idx("t", k).alias("tgt_global_idx"),
        kind.alias("alignment_type"), score.alias("confidence"),
    )


#: The same in SQL.
TURNS = """
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS k FROM conversations),
b AS (SELECT conv_id AS pair_id, k, max(CASE WHEN role = 'user' THEN text END) AS s, max(CASE WHEN role = 'assistant' THEN text END) AS t FROM k GROUP BY conv_id, k),
pairs AS (SELECT pair_id, k::INT AS pair_seq, coalesce(s, '') AS src_text, coalesce(t, '') AS tgt_text,
  CASE WHEN s IS NOT NULL THEN (k % 3)::INT END AS src_sent_idx, CASE WHEN s IS NOT NULL THEN (k // 3)::INT END AS src_para_idx, CASE WHEN s IS NOT NULL THEN k::INT END AS src_global_idx,
  CASE WHEN t IS NOT NULL THEN (k % 3)::INT END AS tgt_sent_idx, CASE WHEN t IS NOT NULL THEN (k // 3)::INT END AS tgt_para_idx, CASE WHEN t IS NOT NULL THEN k::INT END AS tgt_global_idx,
  CASE WHEN s IS NULL THEN '0:1' WHEN t IS NULL THEN '1:0' ELSE '1:1' END AS alignment_type,
  CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN least(length(s), length(t))::DOUBLE / greatest(length(s), length(t), 1) END AS confidence
  FROM b WHERE s IS NOT NULL OR t IS NOT NULL)
"""

PARAGRAPHS = r"""
raw AS (SELECT doc_id AS book_id, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS parts FROM documents),
cut AS (SELECT book_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM raw),
paragraphs AS (SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1)::INT AS para_idx, text
  FROM (SELECT book_id, pos, regexp_replace(part, '^\s+|\s+$', '', 'g') AS text FROM cut) WHERE text <> '')
"""

def split_sql(rows: str) -> str:
    """Sentences of ``rows`` (book_id, para_idx, text, lang)."""
    return rf"""
found AS (SELECT book_id, para_idx, lang, regexp_extract_all(text, '{breaks.PIECE}') AS parts FROM ({rows})),
cut_parts AS (SELECT book_id, para_idx, lang, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM found),
beside AS (SELECT *, lead(part) OVER (PARTITION BY book_id, para_idx ORDER BY pos) AS nxt FROM cut_parts),
ends AS (SELECT book_id, para_idx, pos, part, {breaks.breaks_sql("part", "nxt", "lang")} AS ended FROM beside),
runs AS (SELECT *, coalesce(sum(ended::INT) OVER (PARTITION BY book_id, para_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM ends),
whole AS (SELECT book_id, para_idx, run AS pos, string_agg(part, '' ORDER BY pos) AS part FROM runs GROUP BY book_id, para_idx, run),
trimmed AS (SELECT book_id, para_idx, pos, regexp_replace(part, '^\s+|\s+$', '', 'g') AS text FROM whole),
sentences AS (SELECT book_id, para_idx, (row_number() OVER (PARTITION BY book_id, para_idx ORDER BY pos) - 1)::INT AS sent_idx,
  (row_number() OVER (PARTITION BY book_id ORDER BY para_idx, pos) - 1)::INT AS global_idx, text FROM trimmed WHERE text <> '')
"""


SENTENCES = PARAGRAPHS + "," + split_sql("SELECT book_id, para_idx, paragraphs.text AS text, lang FROM paragraphs JOIN documents ON doc_id = book_id")

#: Vectors to a block of a sequence: about a tenth of them have each label.
BLOCK = 2000

SEQUENCES = """
v AS (SELECT (vec_id // 2000 * 1000 + label // 2)::BIGINT AS pair_id, label % 2 AS side, row_number() OVER (PARTITION BY label, vec_id // 2000 ORDER BY vec_id) - 1 AS global_idx, embedding FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
src AS (SELECT pair_id, global_idx AS i, embedding AS a FROM v WHERE side = 0),
tgt AS (SELECT pair_id, global_idx AS j, embedding AS b FROM v WHERE side = 1)
"""

#: ``side_sequences`` in SQL.
SIDES = """
v AS (SELECT (vec_id // 250)::BIGINT AS pair_id, label % 2 AS side, row_number() OVER (PARTITION BY vec_id // 250, label % 2 ORDER BY vec_id) - 1 AS global_idx, embedding FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
src AS (SELECT pair_id, global_idx AS i, embedding AS a FROM v WHERE side = 0),
tgt AS (SELECT pair_id, global_idx AS j, embedding AS b FROM v WHERE side = 1)
"""
