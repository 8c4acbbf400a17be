"""Quality rules kept as a bitmask ledger.

Every measurement of a text is taken once and every rule is evaluated once; the ledger holds the
measurements and one failure bit per rule. A policy is a named, versioned mask: applying one is an
integer test, and what each rule costs under a policy (its ablation) is a count over masks. All of
it runs inside Spark's own expressions, a row at a time, without a shuffle.

Defined results: a null text is an empty text; a text without words fails the rules on too few
words and no others that divide by words; equal rows get equal results; other columns pass through, but columns named
``measures`` and ``failures`` are replaced. Three-word windows are compared by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import SPACE, words

#: (rule, fails when); a rule's bit is its place here. Append only: stored masks depend on it.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeat_words", "100 * n_repeat_words > 50 * n_words"),
    ("dup_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    ("symbols", "100 * n_symbols > 10 * n_words AND n_words > 0"),
    ("long_words", "word_chars > 12 * n_words AND n_words > 0"),
    ("short_words", "2 * word_chars < 5 * n_words"),
    ("shouting", "2 * n_upper > word_chars AND n_words > 0"),
    ("digits", "100 * n_digits > 30 * word_chars AND n_words > 0"),
    ("few_stops", "n_words >= 50 AND 50 * n_ends < n_words"),
)

#: Policies by version: the rules whose failure rejects a text.
POLICIES = {
    "base-1": ("few_words", "repeat_words"),
    "web-1": ("few_words", "repeat_words", "dup_lines", "symbols", "long_words", "short_words", "shouting", "digits"),
    "web-2": ("few_words", "repeat_words", "dup_lines", "symbols", "long_words", "short_words", "shouting", "digits", "few_stops"),
}


def mask(policy: str) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def without(text: Column, chars: str) -> Column:
    return F.char_length(F.regexp_replace(text, chars, ""))


def repeated_words(hashes: Column) -> Column:
    """Words covered by 3-word windows whose hash occurs twice or more, from the windows' hashes in order."""
    at = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # a window repeats if a neighbour in hash order has the same hash
    flagged = F.transform(F.array(at), lambda s: F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])))
    places = F.array_sort(F.array_compact(flagged[0]))
    covered = F.transform(F.array(places), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))
    return covered[0]


def kept_columns(docs: DataFrame, new: tuple[str, ...]):
    """The columns of ``docs`` as one struct, without those that have one of the new names in any case."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``measures``."""
    clean = docs.select(kept_columns(docs, ("measures",)).alias("_in"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    clean = clean.withColumn("_w", words(F.col("_t"))).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    three = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(F.element_at("_w", i), F.element_at("_w", i + 1), F.element_at("_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    clean = clean.withColumn("_h", three).withColumn("_repeats", F.size(F.array_distinct("_h")) < F.size("_h"))
    long = lambda c, name: c.cast("long").alias(name)
    measures = F.struct(
        long(F.size("_w"), "n_words"),
        long(without(F.col("_t"), f"[{SPACE}]+"), "word_chars"),
        long(F.char_length("_t") - without(F.col("_t"), r"[#*$%&|<>]+"), "n_symbols"),
        long(F.size("_lines"), "n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines")), "n_dup_lines"),
        long(F.when(F.col("_repeats"), repeated_words(F.col("_h"))).otherwise(0), "n_repeat_words"),
        long(F.char_length("_t") - without(F.col("_t"), r"[A-Z]+"), "n_upper"),
        long(F.char_length("_t") - without(F.col("_t"), r"[0-9]+"), "n_digits"),
        long(F.char_length("_t") - without(F.col("_t"), r"[.!?:;\n|]+"), "n_ends"),
    )
    return clean.select("_in.*", measures.alias("measures"))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``measures`` and ``failures``, one bit per failed rule."""
    measured = measure(docs, text_col)
    seen = measured.select(kept_columns(measured, ("measures", "failures")).alias("_in"), "measures", "measures.*")
    bits = sum((F.when(F.expr(test), 1 << k).otherwise(0) for k, (_, test) in enumerate(RULES)), F.lit(0))
    return seen.select("_in.*", "measures", bits.cast("long").alias("failures"))


def passes(failures: Column, policy: str) -> Column:
    return failures.bitwiseAND(F.lit(mask(policy))) == 0


def ablations(kept: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that only it rejects, and rows kept without it."""
    m = mask(policy)
    under = kept.groupBy(F.col("failures").bitwiseAND(F.lit(m)).alias("f")).count()
    names = [n for n, _ in RULES]
    total = [F.sum("count").alias("rows"), F.sum(F.when(F.col("f") == 0, F.col("count")).otherwise(0)).alias("kept")]
    each = [
        F.struct(F.lit(n).alias("rule"), F.coalesce(F.sum(F.when(F.col("f").bitwiseAND(F.lit(b)) != 0, F.col("count"))), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(F.col("f") == b, F.col("count"))), F.lit(0)).alias("only"))
        for n in POLICIES[policy]
        for b in [1 << names.index(n)]
    ]
    return under.agg(*total, F.array(*each).alias("r")).select(F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("kept", F.lit(0)).alias("kept"), F.explode("r").alias("r")).select("rows", "r.rule", "r.failed", "r.only", (F.col("kept") + F.col("r.only")).alias("kept_without"))


def op10_quality(spark, sf_dir):
    kept = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    m = F.col("measures")
    return kept.select("doc_id", m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"), (~passes(F.col("failures"), "base-1")).alias("base_failed"), passes(F.col("failures"), "web-1").alias("kept"), "failures")


def op10_sql() -> str:
    """The same in SQL."""
    bits = " + ".join(f"CASE WHEN {test} THEN {1 << k} ELSE 0 END" for k, (_, test) in enumerate(RULES))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) > 2),
s AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w[k], w[k + 1], w[k + 2]) AS n FROM k),
c AS (SELECT doc_id, k FROM s WHERE n > 1 UNION SELECT doc_id, k + 1 FROM s WHERE n > 1 UNION SELECT doc_id, k + 2 FROM s WHERE n > 1),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM c GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id AS doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits, length(regexp_replace(t, '[^.!?:;\n|]+', '', 'g')) AS n_ends
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id),
f AS (SELECT *, ({bits})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & {mask("base-1")}) <> 0 AS base_failed, (failures & {mask("web-1")}) = 0 AS kept, failures FROM f
"""


OP10_SQL = op10_sql()
