"""The whole pipeline: books to paragraphs, sentences, vectors, aligned pairs and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.operators import align, near, sentences
from twinfold.operators.shared import checkpointed, ranked, text_batches


def books_of(jobs: DataFrame, books: DataFrame, key: str = "book_id") -> DataFrame:
    """The rows of ``books`` that a job uses, so that no other book is read further."""
    return books.join(jobs.select(F.explode(F.array("src_book_id", "tgt_book_id")).alias(key)).distinct(), key, "left_semi")


def align_books(jobs: DataFrame, paragraphs: DataFrame, rules: list[tuple[str, str]] | None = None, cap: int | None = None, band: float = align.BAND, gap: float = align.GAP, key: str = "book_id") -> DataFrame:
    """Pair rows of all jobs (pair_id, src_book_id, tgt_book_id), from paragraphs (key, para_idx, text).

    Only the books of a job are split, each once however many jobs it is in. A book is one row of
    sentences; it is sent to its jobs as text and embedded where it is aligned, so that neither
    vectors nor single sentences are shuffled. Books are aligned to their end, unless a ``cap`` of sentences is given.
    """
    wanted = books_of(jobs, paragraphs, key)
    if rules:
        wanted = sentences.clean(wanted, sentences.valid_rules(wanted.sparkSession, rules))
    books = checkpointed(sentences.whole_books(wanted, key, cap))
    # the target first: a source has more jobs than a target
    rows = with_book(with_book(jobs.select("pair_id", "src_book_id", "tgt_book_id"), books, "tgt", key), books, "src", key)
    made = text_batches(rows).select(F.col("pair_id").cast("string").alias("pair_id"), "src", "tgt", align.text_moves(F.col("src"), F.col("tgt"), band, gap).alias("moves"))
    side = lambda p, at: [F.get(p, at)[c].alias(f"{p}_{c}") for c in ("text", "sent_idx", "para_idx")]

    def row(m, seq):
        (s, *src), (t, *tgt) = side("src", m["src"]), side("tgt", m["tgt"])
        texts = [F.coalesce(s, F.lit("")).alias("src_text"), F.coalesce(t, F.lit("")).alias("tgt_text")]
        at = [m[p].alias(f"{p}_global_idx") for p in ("src", "tgt")]
        kind = F.get(F.array(*map(F.lit, align.TYPES)), m["kind"])
        return F.struct(seq.alias("pair_seq"), *texts, *src, at[0], *tgt, at[1], kind.alias("alignment_type"), m["confidence"].alias("confidence"))

    return made.select("pair_id", F.inline(F.transform("moves", row)))


def with_book(jobs: DataFrame, books: DataFrame, side: str, key: str, share: int = 1000) -> DataFrame:
    """``jobs`` with the sentences of the book on one side; a book of many jobs is sent to several tasks, ``share`` jobs each."""
    book = f"{side}_book_id"
    parts = jobs.groupBy(book).count().select(F.col(book).alias(key), F.ceil(F.col("count") / share).cast("int").alias("_parts"))
    dealt = jobs.join(parts.withColumnRenamed(key, book), book).withColumn("_part", F.pmod(F.xxhash64("pair_id"), F.col("_parts")).cast("int")).drop("_parts")
    sent = books.join(parts, key).select(F.col(key).alias(book), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("sentences").alias(side))
    return dealt.join(sent, [book, "_part"]).drop("_part")


def near_version_jobs(books: DataFrame, key: str = "book_id", text: str = "text") -> DataFrame:
    """Jobs between versions of a book: books whose whole texts are near copies, each with the first of them.

    Books with one text are one version. A group's jobs grow with its size, not with its square.
    """
    found = near.groups(books, key, text, across=True)
    versions = found.groupBy("t", F.col("group_id").alias("src_book_id")).agg(F.min("id").alias("b")).where("b <> src_book_id")
    return versions.select(F.concat_ws("-", "src_book_id", "b").alias("pair_id"), "src_book_id", F.col("b").alias("tgt_book_id"))


def language_jobs(books: DataFrame, pairs: tuple = (("en", "fr"),), key: str = "book_id") -> DataFrame:
    """Jobs (pair_id, src_book_id, tgt_book_id): the k-th book of a source in one language with its k-th in another.

    ``pairs`` lists (source language, target language). Books are ranked by key within source and
    language; a book without a partner has no job, and each pair of languages has at most one job a book.
    """
    wanted = sorted({lang for pair in pairs for lang in pair})
    rows = ranked(books.where(F.col("lang").isin(wanted)).select("source", "lang", key), ["source", "lang"], [key], "k")
    src = rows.select("source", "k", F.col("lang").alias("src_lang"), F.col(key).alias("src_book_id"))
    tgt = rows.select("source", "k", F.col("lang").alias("tgt_lang"), F.col(key).alias("tgt_book_id"))
    ways = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    both = src.join(tgt, ["source", "k"]).where(F.array_contains(ways, F.struct(F.col("src_lang").alias("a"), F.col("tgt_lang").alias("b"))))
    return both.select(F.concat_ws("-", "src_book_id", "tgt_book_id").alias("pair_id"), "src_book_id", "tgt_book_id")
