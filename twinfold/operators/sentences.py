"""Clean-up rules and sentence splitting."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.functions.sentence_breaks import sentence_texts
from twinfold.functions.text import paragraph_texts, replacement

CAP, COUNT_CAP = 10_000, 100_000


def groups_of(pattern: str) -> int:
    """How many capturing groups a pattern has: opening brackets that are neither escaped nor in a class nor special."""
    bare = re.sub(r"\\Q.*?(?:\\E|$)|\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


def valid_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The rules whose pattern is not empty and that Java accepts, all compiled in one row each of one job."""
    some = [r for r in rules if r[0]]
    if not some:
        return []
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("pattern"))
    tried = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(some)], "k int, pattern string").where(compiled.isNotNull())
    good = {r["k"] for r in tried.select("k").collect()}
    return [r for k, r in enumerate(some) if k in good]


def clean(paragraphs: DataFrame, rules: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """Regex replacements over each paragraph, in order."""
    made = functools.reduce(lambda c, r: F.regexp_replace(c, r[0], replacement(r[1], groups_of(r[0]), tuple(re.findall(r"\(\?<(\w+)>", r[0])))), rules, F.col(text))
    return paragraphs.withColumn(text, made)


def sentences(paragraphs: DataFrame, key: str = "book_id", cap: int | None = CAP, lang: str | None = None) -> DataFrame:
    """(key, para_idx, sent_idx, global_idx, text, truncated).

    Blank paragraphs and sentences are dropped; sent_idx restarts by paragraph and global_idx runs
    over the book; ``lang`` names the column of their language. Sentences from ``cap`` on are dropped and the book is flagged. One shuffle brings
    a book's paragraphs together, a row each; sentences are numbered from what stands before them.
    """
    rows = paragraphs.select(key, "para_idx", sentence_texts(F.col("text"), F.col(lang) if lang else None).alias("parts")).where("size(parts) > 0")
    before = Window.partitionBy(key).orderBy("para_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum(F.size("parts")).over(before), F.lit(0)))
    total = F.sum(F.size("parts")).over(Window.partitionBy(key))
    rows = rows.withColumn("truncated", F.lit(False) if cap is None else total > cap)
    found = rows.select(key, "para_idx", "first", "truncated", F.posexplode("parts").alias("sent_idx", "text"))
    found = found.select(key, "para_idx", "sent_idx", (F.col("first") + F.col("sent_idx")).cast("int").alias("global_idx"), "text", "truncated")
    return found if cap is None else found.where(F.col("global_idx") < cap)


def whole_books(paragraphs: DataFrame, key: str = "book_id", cap: int | None = None, lang: str | None = None) -> DataFrame:
    """(key, sentences): ``sentences`` as one row a book, an array of (para_idx, sent_idx, text) whose places are global_idx; all, unless a ``cap`` is given. Books without any have no row."""
    parts = F.transform(sentence_texts(F.col("text"), F.col(lang) if lang else None), lambda s, k: F.struct(F.col("para_idx"), k.alias("sent_idx"), s.alias("text")))
    rows = paragraphs.select(key, "para_idx", parts.alias("parts")).where("size(parts) > 0")
    whole = F.array_sort(F.collect_list(F.struct("para_idx", "parts")))
    every = F.flatten(F.transform(whole, lambda p: p["parts"]))
    return rows.groupBy(key).agg((every if cap is None else F.slice(every, 1, cap)).alias("sentences"))


def book_sentences(books: DataFrame, key: str = "book_id", text: str = "text", cap: int | None = None, delimiter: str = r"\n{2,}", lang: str | None = None) -> DataFrame:
    """As ``sentences``, straight from whole texts (key, text), one per book: nothing is shuffled. All sentences, unless a ``cap`` is given."""
    by_para = F.transform(paragraph_texts(F.col(text), delimiter), lambda p, i: F.transform(sentence_texts(p, F.col(lang) if lang else None), lambda s, k: F.struct(i.alias("para_idx"), k.alias("sent_idx"), s.alias("text"))))
    rows = books.select(key, F.flatten(by_para).alias("s"))
    cut = F.col("s") if cap is None else F.slice("s", 1, cap)
    rows = rows.select(key, F.lit(False).alias("truncated") if cap is None else (F.size("s") > cap).alias("truncated"), F.posexplode_outer(cut).alias("global_idx", "s"))
    # outer, as Spark would else split the text twice: once to see whether there are sentences
    return rows.where("s is not null").select(key, "s.para_idx", "s.sent_idx", "global_idx", "s.text", "truncated")


def sentence_counts(paragraphs: DataFrame, key: str = "book_id", cap: int = COUNT_CAP, lang: str | None = None) -> DataFrame:
    """(key, n_sentences, truncated) without numbering a sentence."""
    total = F.sum(F.size(sentence_texts(F.col("text"), F.col(lang) if lang else None)))
    return paragraphs.groupBy(key).agg(F.least(total, F.lit(cap)).cast("long").alias("n_sentences"), (total > cap).alias("truncated"))
