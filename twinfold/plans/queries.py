"""Registered queries of the library's own operators; each runs over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinfold.functions import text as tx
from twinfold.operators import align, catalog, display, near, progress, search, sentences, store, vectors
from twinfold.operators.shared import checkpointed, ranked, shared_folder
from twinfold.plans import align_books as plan
from twinfold.plans import inputs
from twinfold.sinks import exports
from twinfold.sources import markup, pair_tsv, records, spine
from twinfold.sources import paragraphs as paras

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


r6 = lambda c: F.round(c, 6)


# ---------------------------------------------------------------- alignment of vectors


@query("WITH RECURSIVE " + inputs.SEQUENCES + """,
size AS (SELECT s.pair_id, m, n FROM (SELECT pair_id, count(*) AS m FROM src GROUP BY pair_id) s JOIN (SELECT pair_id, count(*) AS n FROM tgt GROUP BY pair_id) t ON s.pair_id = t.pair_id),
sims AS (SELECT src.pair_id AS pair_id, i, j, list_dot_product(a::DOUBLE[], b::DOUBLE[]) AS sim FROM src JOIN tgt ON src.pair_id = tgt.pair_id),
dp AS (
  SELECT pair_id, 0::BIGINT AS i, j::BIGINT AS j, 0.0::DOUBLE AS v FROM size, range(0, 100000) r(j) WHERE j <= n
  UNION ALL
  SELECT pair_id, i + 1 AS i, j, max(c) OVER (PARTITION BY pair_id ORDER BY j) AS v
  FROM (SELECT d.pair_id AS pair_id, d.i AS i, d.j AS j, greatest(d.v, coalesce(d.before + s.sim, d.v)) AS c
        FROM (SELECT *, lag(v) OVER (PARTITION BY pair_id ORDER BY j) AS before FROM dp) d
        LEFT JOIN sims s ON s.pair_id = d.pair_id AND s.i = d.i AND s.j = d.j - 1
        JOIN size z ON z.pair_id = d.pair_id WHERE d.i < z.m))
SELECT z.pair_id::VARCHAR AS pair_id, m, n, round(v, 6) AS score FROM dp JOIN size z ON z.pair_id = dp.pair_id WHERE dp.i = m AND dp.j = n
""")
def align_score(spark, sf_dir):
    src, tgt = inputs.label_sequences(spark, sf_dir)
    return align.scores(src, tgt).withColumn("score", r6(F.col("score")))


GAP = -0.05

#: Score table row by row, then the path back from its end, of src (pair_id, i, a) and tgt (pair_id, j, b), within a band.
def moves_sql(sequences: str, gap: float, fraction: float = 1.0) -> str:
    # row i + 1 of the table; cells outside the band are as good as minus infinity
    return "WITH RECURSIVE " + sequences + f""",
size AS (SELECT s.pair_id AS pair_id, m, n, greatest(50, ceil({fraction} * greatest(m, n)), ceil(n::DOUBLE / greatest(m, 1)))::BIGINT AS w
  FROM (SELECT pair_id, count(*) AS m FROM src GROUP BY pair_id) s JOIN (SELECT pair_id, count(*) AS n FROM tgt GROUP BY pair_id) t ON s.pair_id = t.pair_id),
sims AS (SELECT src.pair_id AS pair_id, i, j, list_dot_product(a::DOUBLE[], b::DOUBLE[]) AS sim FROM src JOIN tgt ON src.pair_id = tgt.pair_id),
dp AS (
  SELECT pair_id, 0::BIGINT AS i, j::BIGINT AS j, (CASE WHEN j <= w THEN j * {gap} ELSE -1e18 END)::DOUBLE AS v, 2 AS kind FROM size, range(0, 100000) r(j) WHERE j <= n
  UNION ALL
  SELECT pair_id, i, j, v, CASE WHEN diag >= v - 1e-5 THEN 0 WHEN up >= v - 1e-5 THEN 1 ELSE 2 END AS kind
  FROM (SELECT pair_id, i, j, diag, up, CASE WHEN inside THEN best + j * {gap} ELSE -1e18 END AS v
    FROM (SELECT *, max(CASE WHEN inside THEN greatest(diag, up) - j * {gap} ELSE -1e18 END) OVER (PARTITION BY pair_id ORDER BY j) AS best
      FROM (SELECT d.pair_id AS pair_id, d.i + 1 AS i, d.j AS j, CASE WHEN d.j = 0 THEN (d.i + 1) * {gap} ELSE d.v + {gap} END AS up, coalesce(d.before + s.sim, -1e18) AS diag,
          abs(d.j - floor((d.i + 1) * (z.n::DOUBLE / greatest(z.m, 1)) + 0.5)) <= z.w AS inside
        FROM (SELECT *, lag(v) OVER (PARTITION BY pair_id ORDER BY j) AS before FROM dp) d
        LEFT JOIN sims s ON s.pair_id = d.pair_id AND s.i = d.i AND s.j = d.j - 1 JOIN size z ON z.pair_id = d.pair_id WHERE d.i < z.m)))),
back AS (
  SELECT pair_id, m AS i, n AS j, 0 AS step, -1 AS kind FROM size
  UNION ALL
  SELECT pair_id, i - CASE WHEN k = 2 THEN 0 ELSE 1 END AS i, j - CASE WHEN k = 1 THEN 0 ELSE 1 END AS j, step + 1 AS step, k AS kind
  FROM (SELECT b.pair_id AS pair_id, b.i AS i, b.j AS j, b.step AS step, CASE WHEN b.i = 0 THEN 2 WHEN b.j = 0 THEN 1 ELSE d.kind END AS k
    FROM back b JOIN dp d ON d.pair_id = b.pair_id AND d.i = b.i AND d.j = b.j WHERE b.i > 0 OR b.j > 0)),
moves AS (SELECT b.pair_id::VARCHAR AS pair_id, (row_number() OVER (PARTITION BY b.pair_id ORDER BY step DESC) - 1)::INT AS pair_seq,
  CASE WHEN kind <> 2 THEN b.i::INT END AS src_global_idx, CASE WHEN kind <> 1 THEN b.j::INT END AS tgt_global_idx,
  CASE kind WHEN 0 THEN '1:1' WHEN 1 THEN '1:0' ELSE '0:1' END AS alignment_type, CASE WHEN kind = 0 THEN round(s.sim, 6) END AS confidence
  FROM back b LEFT JOIN sims s ON s.pair_id = b.pair_id AND s.i = b.i AND s.j = b.j WHERE kind >= 0)
"""


MOVES = moves_sql(inputs.SEQUENCES, GAP, align.BAND)


@query(MOVES + "SELECT pair_id, pair_seq, src_global_idx, tgt_global_idx, alignment_type, confidence FROM moves")
def align_moves(spark, sf_dir):
    src, tgt = inputs.label_sequences(spark, sf_dir)
    return align.align(src, tgt, gap=GAP).withColumn("confidence", r6(F.col("confidence")))


@query(MOVES + """
SELECT pair_id, count(*) FILTER (WHERE alignment_type = '1:1') AS matched, count(*) FILTER (WHERE alignment_type = '1:0') AS src_gaps, count(*) FILTER (WHERE alignment_type = '0:1') AS tgt_gaps,
count(*) FILTER (WHERE alignment_type <> '0:1') AS n_src, count(*) FILTER (WHERE alignment_type <> '1:0') AS n_tgt,
floor(100.0 * count(*) FILTER (WHERE alignment_type = '1:1') / count(*) + 0.5)::BIGINT AS match_pct, bool_or(confidence IS NOT NULL) AS has_confidence FROM moves GROUP BY pair_id
""")
def align_summary(spark, sf_dir):
    src, tgt = inputs.label_sequences(spark, sf_dir)
    return align.summary(align.align(src, tgt, gap=GAP))


@query(moves_sql(inputs.SIDES, GAP, align.BAND) + "SELECT pair_id, pair_seq, src_global_idx, tgt_global_idx, alignment_type, confidence FROM moves")
def align_banded(spark, sf_dir):
    """The default band on sequences that are longer than it is wide."""
    src, tgt = inputs.side_sequences(spark, sf_dir)
    return align.align(src, tgt, gap=GAP).withColumn("confidence", r6(F.col("confidence")))


@query("WITH " + inputs.SEQUENCES + """
SELECT src.pair_id AS pair_id, i, j, round(list_dot_product(a::DOUBLE[], b::DOUBLE[]), 6) AS sim FROM src JOIN tgt ON src.pair_id = tgt.pair_id
""")
def pair_similarities(spark, sf_dir):
    src, tgt = inputs.label_sequences(spark, sf_dir)
    found = vectors.similarities(src, tgt)
    return found.select("pair_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6(F.col("sim")).alias("sim"))


BAND = inputs.SEQUENCES + """,
size AS (SELECT s.pair_id AS pair_id, m, n, greatest(50, ceil(0.15 * greatest(m, n)), ceil(n::DOUBLE / greatest(m, 1)))::BIGINT AS w
  FROM (SELECT pair_id, count(*) AS m FROM src GROUP BY pair_id) s JOIN (SELECT pair_id, count(*) AS n FROM tgt GROUP BY pair_id) t ON s.pair_id = t.pair_id),
ri AS (SELECT pair_id, m, n, w, unnest(range(0, m + 1)) AS i FROM size),
band AS (SELECT pair_id, i, greatest(0, floor(i * n::DOUBLE / greatest(m, 1) + 0.5)::BIGINT - w) AS lo, least(n, floor(i * n::DOUBLE / greatest(m, 1) + 0.5)::BIGINT + w) AS hi FROM ri)
"""


@query("WITH " + BAND + " SELECT pair_id, i, lo, hi FROM band")
def band_limits(spark, sf_dir):
    src, tgt = inputs.label_sequences(spark, sf_dir)
    sizes = src.groupBy("pair_id").agg(F.count("*").alias("m")).join(tgt.groupBy("pair_id").agg(F.count("*").alias("n")), "pair_id")
    return vectors.band(sizes)


@query("WITH " + BAND + """
SELECT src.pair_id AS pair_id, src.i AS i, tgt.j AS j, round(list_dot_product(a::DOUBLE[], b::DOUBLE[]), 6) AS sim
FROM band JOIN src ON src.pair_id = band.pair_id AND src.i = band.i - 1 JOIN tgt ON tgt.pair_id = band.pair_id AND tgt.j >= greatest(band.lo, 1) - 1 AND tgt.j < band.hi
""")
def band_candidates(spark, sf_dir):
    src, tgt = inputs.label_sequences(spark, sf_dir)
    return vectors.band_candidates(src, tgt).withColumn("sim", r6(F.col("sim")))


@query("""
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
p AS (SELECT label, d, avg(x) AS x FROM x GROUP BY label, d)
SELECT label, d::INT AS d, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM p
""")
def mean_pooled(spark, sf_dir):
    pooled = vectors.mean_pool(inputs.table(spark, sf_dir, "embeddings"), ["label"])
    return pooled.select("label", F.posexplode("embedding").alias("d", "x")).withColumn("x", r6(F.col("x")))


@query("""
WITH t AS (SELECT item_id, ' ' || lower(text) || ' ' AS t FROM benchmark),
g AS (SELECT item_id, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS k FROM t),
c AS (SELECT item_id, ('0x' || substr(md5(substr(t, k, 3)), 1, 8))::BIGINT % 64 AS d, count(*) AS n FROM g GROUP BY item_id, d)
SELECT item_id, d::INT AS d, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 5) AS x FROM c
""")
def hashed_vectors(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "benchmark").where("text is not null")
    counts = vectors.gram_counts(rows, ["item_id"])
    vector = vectors.embed_hashed(rows, ["item_id"])
    return counts.join(vector, "item_id").select("item_id", "d", "n", F.round(F.get("embedding", F.col("d")).cast("double"), 5).alias("x"))


# ---------------------------------------------------------------- text


@query("WITH " + inputs.PARAGRAPHS + " SELECT book_id, para_idx, text FROM paragraphs")
def text_paragraphs(spark, sf_dir):
    return inputs.paragraphs(spark, sf_dir)


RULES = [(r"[#*$%&]{3,}", ""), (r"\s+", " "), (r"(\w+) (\w+)", "$2 $1"), ("(", "broken"), ("", "empty")]


@query("WITH " + inputs.PARAGRAPHS + r""" SELECT book_id, para_idx,
regexp_replace(regexp_replace(regexp_replace(text, '[#*$%&]{3,}', '', 'g'), '\s+', ' ', 'g'), '([A-Za-z0-9_]+) ([A-Za-z0-9_]+)', '\2 \1', 'g') AS text FROM paragraphs""")
def cleaned_paragraphs(spark, sf_dir):
    return sentences.clean(inputs.paragraphs(spark, sf_dir), sentences.valid_rules(spark, RULES))


@query("WITH " + inputs.SENTENCES + " SELECT *, false AS truncated FROM sentences")
def split_sentences(spark, sf_dir):
    return sentences.book_sentences(inputs.books(spark, sf_dir), delimiter="\n", lang="lang")


BOUNDARIES = {"f": "She met Dr. No at 3.14 p.m. in the U.S.A today", "s": "e.g. this; z.B. Berlin... or not? “Yes.” Then", "c": "彼は「行け。」と言った。そうか！」 Mr. X left (at 9.) He slept."}


@query("WITH " + inputs.split_sql("SELECT conv_id * 10 + k AS book_id, turn AS para_idx, CASE k " + " ".join(f"WHEN {n} THEN '{t} '" for n, t in enumerate(BOUNDARIES.values())) + " END || text || ' ' || CASE k " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(BOUNDARIES.values())) + " END AS text, 'en' AS lang FROM conversations, range(3) r(k) WHERE text IS NOT NULL") + " SELECT book_id, para_idx, global_idx, text FROM sentences")
def sentence_boundaries(spark, sf_dir):
    """Turns between awkward sentences, in three ways: abbreviations, numbers, closers, full-width marks."""
    ways = F.posexplode(F.array(*[F.concat(F.lit(t + " "), F.col("text"), F.lit(" " + t)) for t in BOUNDARIES.values()])).alias("k", "text")
    rows = inputs.table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", F.col("turn").alias("para_idx"), ways)
    found = sentences.sentences(rows.select((F.col("conv_id") * 10 + F.col("k")).alias("book_id"), "para_idx", "text", F.lit("en").alias("lang")), cap=None, lang="lang")
    return found.select("book_id", "para_idx", "global_idx", "text")


@query("WITH " + inputs.SENTENCES + " SELECT book_id, least(count(*), 100000)::BIGINT AS n_sentences, count(*) > 100000 AS truncated FROM sentences GROUP BY book_id")
def sentence_counts(spark, sf_dir):
    return sentences.sentence_counts(paras.text_paragraphs(inputs.books(spark, sf_dir), delimiter="\n", keep=("lang",)), lang="lang")


@query("""SELECT doc_id, CASE WHEN lower(lang) IN ('jp', 'ja') THEN 'ja' WHEN lower(lang) IN ('zh', 'zh-cn', 'zh-tw', 'ko') THEN lower(lang) WHEN coalesce(lang, '') = '' THEN 'und' ELSE lang END AS locale,
octet_length(encode(text))::BIGINT AS bytes, (text LIKE '%�%' OR text LIKE '%縺%') AS mojibake FROM documents""")
def text_facts(spark, sf_dir):
    t = F.col("text")
    return inputs.table(spark, sf_dir, "documents").select("doc_id", tx.locale(F.col("lang")).alias("locale"), F.octet_length(t).cast("long").alias("bytes"), tx.has_mojibake(t).alias("mojibake"))


# ---------------------------------------------------------------- whole pipelines


@query()
def align_languages(spark, sf_dir):
    """English books with the French, German and Spanish ones of their source, by rank. SQL is too slow for whole tables."""
    books = inputs.books(spark, sf_dir)
    jobs = checkpointed(plan.language_jobs(books, (("en", "fr"), ("en", "de"), ("en", "es"))))
    pairs = plan.align_books(jobs, inputs.lines_of(plan.books_of(jobs, books)), gap=GAP)
    return pairs.withColumn("confidence", r6(F.col("confidence")))


@query(r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE o >= 0.8 * (x.n + y.n - o) - 1e-9),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other)
SELECT doc_id AS book_id, min(other) AS group_id FROM reach GROUP BY doc_id
""")
def version_groups(spark, sf_dir):
    """The first of the books that each book is a version of, over chains of near texts."""
    found = near.groups(inputs.books(spark, sf_dir), "book_id", "text", across=True)
    return found.select(F.col("id").alias("book_id"), "group_id")


@query()
def align_versions(spark, sf_dir):
    books = inputs.books(spark, sf_dir)
    jobs = checkpointed(plan.near_version_jobs(books))
    return align.summary(plan.align_books(jobs, inputs.lines_of(plan.books_of(jobs, books))))


# ---------------------------------------------------------------- pairs


@query("WITH " + inputs.TURNS + """
SELECT pair_id, count(*) FILTER (WHERE alignment_type = '1:1') AS matched, count(*) FILTER (WHERE alignment_type = '1:0') AS src_gaps, count(*) FILTER (WHERE alignment_type = '0:1') AS tgt_gaps,
count(*) FILTER (WHERE alignment_type <> '0:1') AS n_src, count(*) FILTER (WHERE alignment_type <> '1:0') AS n_tgt,
floor(100.0 * count(*) FILTER (WHERE alignment_type = '1:1') / count(*) + 0.5)::BIGINT AS match_pct, bool_or(alignment_type = '1:1' AND confidence IS NOT NULL) AS has_confidence FROM pairs GROUP BY pair_id
""")
def pair_summary(spark, sf_dir):
    return align.summary(inputs.turns(spark, sf_dir))


@query("WITH " + inputs.TURNS + """
SELECT pair_id, pair_seq, tgt_text AS src_text, src_text AS tgt_text, tgt_sent_idx AS src_sent_idx, tgt_para_idx AS src_para_idx, tgt_global_idx AS src_global_idx, src_sent_idx AS tgt_sent_idx, src_para_idx AS tgt_para_idx, src_global_idx AS tgt_global_idx,
CASE alignment_type WHEN '1:0' THEN '0:1' WHEN '0:1' THEN '1:0' ELSE alignment_type END AS alignment_type, round(confidence, 6) AS confidence FROM pairs
""")
def swapped_pairs(spark, sf_dir):
    return align.swapped(inputs.turns(spark, sf_dir)).withColumn("confidence", r6(F.col("confidence")))


GROUPED = inputs.TURNS + """,
shown AS (SELECT pair_id, coalesce(src_para_idx, 0) AS para_idx, count(*) AS n_pairs,
  string_agg(CASE WHEN regexp_matches(src_text, '\\S') THEN src_text END, ' ' ORDER BY coalesce(src_sent_idx, 0), pair_seq) AS text FROM pairs GROUP BY pair_id, coalesce(src_para_idx, 0))
"""


@query("WITH " + GROUPED + " SELECT pair_id, para_idx, coalesce(text, '') AS text, n_pairs FROM shown")
def grouped_paragraphs(spark, sf_dir):
    return display.grouped(inputs.turns(spark, sf_dir)).drop("pairs")


NUMBERED = inputs.TURNS + """,
kept AS (SELECT *, coalesce(src_para_idx, 0) AS para_idx FROM pairs WHERE regexp_matches(src_text, '\\S')),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY pair_id ORDER BY para_idx) - 1 AS display_idx, row_number() OVER (PARTITION BY pair_id, para_idx ORDER BY pair_seq) - 1 AS pair_idx FROM kept)
"""


@query("WITH " + NUMBERED + """ SELECT pair_id, display_idx::INT AS display_idx, pair_idx::INT AS pair_idx, row_number() OVER (PARTITION BY pair_id ORDER BY display_idx, pair_idx)::INT AS number, src_text, tgt_text, alignment_type FROM ranked""")
def numbered_pairs(spark, sf_dir):
    return display.numbered(display.displayed(inputs.turns(spark, sf_dir)))


@query("WITH " + inputs.TURNS + r""" SELECT pair_id, pair_seq, regexp_matches(src_text, '\S') AND regexp_matches(tgt_text, '\S') AS has_match, regexp_matches(src_text, '\S') AS in_reader FROM pairs""")
def pair_predicates(spark, sf_dir):
    return inputs.turns(spark, sf_dir).select("pair_id", "pair_seq", display.has_match().alias("has_match"), (~tx.is_blank(F.col("src_text"))).alias("in_reader"))


@query("""
WITH s AS (SELECT source AS pair_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS display_idx, count(*) OVER (PARTITION BY source) AS n FROM documents),
c AS (SELECT *, floor(display_idx / greatest(50, ceil(n / 20.0)))::INT AS chapter_idx FROM s), m AS (SELECT *, max(chapter_idx) OVER (PARTITION BY pair_id) + 1 AS k FROM c)
SELECT pair_id, display_idx::INT AS display_idx, chapter_idx, 'ch' || lpad((chapter_idx + 1)::VARCHAR, 3, '0') AS chapter_id, CASE WHEN k > 1 THEN 'Part ' || (chapter_idx + 1) || ' of ' || k ELSE pair_id END AS chapter_title FROM m
""")
def chapters(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "documents").select(F.col("source").alias("pair_id"), "doc_id")
    shown = ranked(rows, ["pair_id"], ["doc_id"], "display_idx")
    return display.chapters(shown, F.col("pair_id")).select("pair_id", "display_idx", "chapter_idx", "chapter_id", "chapter_title")


@query("WITH " + NUMBERED + """,
homes AS (SELECT pair_id, tgt_para_idx, min(display_idx) AS display_idx FROM ranked WHERE tgt_para_idx IS NOT NULL GROUP BY pair_id, tgt_para_idx),
own AS (SELECT DISTINCT conv_id AS pair_id, (turn * 2)::INT AS para_idx FROM conversations WHERE turn % 3 = 0),
last AS (SELECT pair_id, max(display_idx) AS last FROM ranked GROUP BY pair_id),
placed AS (SELECT own.pair_id AS pair_id, own.para_idx AS para_idx, last, (SELECT min(tgt_para_idx) FROM homes h WHERE h.pair_id = own.pair_id AND h.tgt_para_idx >= own.para_idx) AS nxt FROM own JOIN last ON own.pair_id = last.pair_id)
SELECT placed.pair_id AS pair_id, coalesce(h.display_idx, last)::INT AS display_idx, string_agg('i' || para_idx, ',' ORDER BY para_idx) AS images
FROM placed LEFT JOIN homes h ON h.pair_id = placed.pair_id AND h.tgt_para_idx = placed.nxt GROUP BY placed.pair_id, coalesce(h.display_idx, last)
""")
def placed_images(spark, sf_dir):
    shown = display.displayed(inputs.turns(spark, sf_dir))
    at = (F.col("turn") * 2).cast("int")
    targets = inputs.table(spark, sf_dir, "conversations").where("turn % 3 = 0").select(F.col("conv_id").alias("pair_id"), at.alias("para_idx"), F.array(F.concat(F.lit("i"), at)).alias("image_ids")).distinct()
    placed = display.placed_images(display.target_homes(shown), targets, shown)
    return placed.select("pair_id", "display_idx", F.array_join(display.picked_images("target", F.array().cast("array<string>"), F.col("tgt_images")), ",").alias("images"))


EXPORTED = inputs.TURNS + r""",
own AS (SELECT DISTINCT conv_id AS pair_id, turn::INT AS pl FROM conversations),
paras AS (SELECT pair_id, src_para_idx AS para_idx, CASE WHEN src_para_idx % 2 = 1 THEN 's' || src_para_idx END AS img FROM pairs WHERE src_para_idx IS NOT NULL
  GROUP BY pair_id, src_para_idx HAVING src_para_idx % 2 = 1 OR regexp_matches(max(src_text), '\S')),
disp AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY para_idx) - 1 AS d FROM paras)
"""


def illustrated(spark, sf_dir):
    """Turns with their source paragraphs, each second one with an image, and an image for each turn of the conversation."""
    pairs = inputs.turns(spark, sf_dir)
    idx = F.col("src_para_idx")
    pictures = F.when(idx % 2 == 1, F.array(F.concat(F.lit("s"), idx))).otherwise(F.array().cast("array<string>"))
    paragraphs = pairs.where(idx.isNotNull()).groupBy("pair_id", idx.alias("para_idx")).agg(F.max("src_text").alias("text"), F.first(pictures).alias("image_ids"))
    at = F.col("turn").cast("int")
    targets = inputs.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), at.alias("para_idx"), F.lit("").alias("text"), F.array(F.concat(F.lit("t"), at)).alias("image_ids")).distinct()
    return pairs, paragraphs, targets


@query("WITH " + EXPORTED + r""",
p AS (SELECT disp.pair_id AS pair_id, d, tgt_para_idx FROM disp JOIN pairs ON pairs.pair_id = disp.pair_id AND coalesce(src_para_idx, 0) = disp.para_idx WHERE regexp_matches(src_text, '\S') OR regexp_matches(tgt_text, '\S')),
homes AS (SELECT pair_id, tgt_para_idx, min(d) AS d FROM p WHERE tgt_para_idx IS NOT NULL GROUP BY pair_id, tgt_para_idx),
last AS (SELECT pair_id, max(d) AS last FROM disp GROUP BY pair_id),
placed AS (SELECT own.pair_id AS pair_id, pl, last, (SELECT min(tgt_para_idx) FROM homes h WHERE h.pair_id = own.pair_id AND h.tgt_para_idx >= pl) AS nxt FROM own JOIN last ON own.pair_id = last.pair_id),
theirs AS (SELECT placed.pair_id AS pair_id, coalesce(h.d, last) AS d, string_agg('t' || pl, ',' ORDER BY pl) AS images FROM placed LEFT JOIN homes h ON h.pair_id = placed.pair_id AND h.tgt_para_idx = nxt GROUP BY placed.pair_id, coalesce(h.d, last)),
n AS (SELECT pair_id, d, count(*) AS n FROM p GROUP BY pair_id, d)
SELECT disp.pair_id AS pair_id, (row_number() OVER (PARTITION BY disp.pair_id ORDER BY disp.d) - 1)::INT AS display_idx, para_idx, concat_ws(',', img, images) AS images, coalesce(n, 0)::INT AS n_pairs
FROM disp LEFT JOIN n ON n.pair_id = disp.pair_id AND n.d = disp.d LEFT JOIN theirs ON theirs.pair_id = disp.pair_id AND theirs.d = disp.d WHERE n > 0 OR img IS NOT NULL OR images IS NOT NULL
""")
def exported_paragraphs(spark, sf_dir):
    """Conversations as exported: pairs with either side, images of both sides."""
    rows = display.exported(*illustrated(spark, sf_dir))
    return rows.select("pair_id", "display_idx", "para_idx", F.array_join("images", ",").alias("images"), F.size("pairs").alias("n_pairs"))


ORPHANED = inputs.TURNS + """,
half AS (SELECT pair_id, pair_seq, CASE WHEN length(src_text) % 2 = 1 THEN src_para_idx END AS src_para_idx FROM pairs)
"""


@query("WITH " + ORPHANED + """
SELECT pair_id, pair_seq, coalesce(first_value(src_para_idx IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY pair_seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(src_para_idx IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY pair_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS src_para_idx FROM half
""")
def orphans_onward(spark, sf_dir):
    """Turns whose user texts of even length have no paragraph, with the paragraph that they are shown in."""
    half = F.when(F.char_length("src_text") % 2 == 1, F.col("src_para_idx"))
    return display.with_next_paragraph(inputs.turns(spark, sf_dir).withColumn("src_para_idx", half)).select("pair_id", "pair_seq", "src_para_idx")


@query("WITH " + EXPORTED + """,
r AS (SELECT pair_id, coalesce(src_para_idx, 0) AS para_idx, pair_seq, tgt_para_idx FROM pairs),
mine AS (SELECT pair_id, para_idx, min(CASE WHEN pair_seq % 2 = 1 THEN pair_seq END) AS first FROM r GROUP BY pair_id, para_idx),
cited AS (SELECT pair_id, para_idx, tgt_para_idx, min(pair_seq) AS seq FROM r WHERE tgt_para_idx IS NOT NULL GROUP BY pair_id, para_idx, tgt_para_idx),
theirs AS (SELECT c.pair_id AS pair_id, para_idx, string_agg('t' || pl, ',' ORDER BY seq) AS images FROM cited c JOIN own ON own.pair_id = c.pair_id AND pl = tgt_para_idx GROUP BY c.pair_id, para_idx)
SELECT mine.pair_id AS pair_id, mine.para_idx AS para_idx, concat_ws(',', 'p' || first, images) AS images FROM mine LEFT JOIN theirs ON theirs.pair_id = mine.pair_id AND theirs.para_idx = mine.para_idx
""")
def legacy_images(spark, sf_dir):
    """Images of turns without source paragraphs, each second pair with one of its own."""
    pairs, _, targets = illustrated(spark, sf_dir)
    own = F.when(F.col("pair_seq") % 2 == 1, F.array(F.concat(F.lit("p"), "pair_seq")))
    rows = display.legacy_images(pairs.withColumn("src_images", own), targets)
    return rows.select("pair_id", "para_idx", F.array_join("images", ",").alias("images"))


# ---------------------------------------------------------------- interchange

TSV = inputs.TURNS + r""",
rows AS (SELECT pair_id, pair_seq AS line_no, concat_ws(chr(9), CASE WHEN src_text LIKE '#%' THEN ' ' ELSE '' END || regexp_replace(src_text, '[\t\n]', ' ', 'g'), regexp_replace(tgt_text, '[\t\n]', ' ', 'g'), CASE WHEN confidence IS NULL THEN '' ELSE format('{:.4f}', CASE WHEN (confidence * 32) % 2 = 1 THEN floor(confidence * 10000 + 0.5) / 10000 ELSE confidence END) END) AS line FROM pairs)
"""


@query("WITH " + TSV + """,
n AS (SELECT pair_id, count(*) AS n FROM pairs GROUP BY pair_id)
SELECT * FROM rows
UNION ALL SELECT pair_id, -7, '# exported_by=twinfold' FROM n UNION ALL SELECT pair_id, -6, '# source_title=' FROM n UNION ALL SELECT pair_id, -5, '# target_title=' FROM n
UNION ALL SELECT pair_id, -4, '# src_lang=' FROM n UNION ALL SELECT pair_id, -3, '# tgt_lang=' FROM n UNION ALL SELECT pair_id, -2, '# total_pairs=' || n FROM n UNION ALL SELECT pair_id, -1, concat_ws(chr(9), 'source_text', 'target_text', 'confidence') FROM n
""")
def tsv_export(spark, sf_dir):
    return exports.tsv_lines(inputs.turns(spark, sf_dir))


def tsv_files(spark, sf_dir):
    """The exported lines of each conversation as one file's content."""
    lines = exports.tsv_lines(inputs.turns(spark, sf_dir))
    return lines.groupBy(F.col("pair_id").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))


@query("WITH " + inputs.TURNS + r""" SELECT pair_id AS file, (row_number() OVER (PARTITION BY pair_id ORDER BY pair_seq) - 1)::INT AS pair_seq,
regexp_replace(regexp_replace(src_text, '[\t\n]', ' ', 'g'), '^\s+|\s+$', '', 'g') AS src_text, regexp_replace(regexp_replace(tgt_text, '[\t\n]', ' ', 'g'), '^\s+|\s+$', '', 'g') AS tgt_text, alignment_type, round(format('{:.4f}', confidence)::DOUBLE, 3) AS confidence FROM pairs""")
def tsv_import(spark, sf_dir):
    kinds = pair_tsv.classified(pair_tsv.lines(tsv_files(spark, sf_dir)))
    return pair_tsv.pairs(kinds).select("file", "pair_seq", "src_text", "tgt_text", "alignment_type", F.round("confidence", 3).alias("confidence"))


@query("SELECT DISTINCT conv_id AS file, true AS own, '' AS source_title, '' AS target_title, '' AS src_lang, '' AS tgt_lang FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL")
def tsv_metadata(spark, sf_dir):
    return pair_tsv.metadata(pair_tsv.classified(pair_tsv.lines(tsv_files(spark, sf_dir))))


@query("WITH " + inputs.PARAGRAPHS + r""",
l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
d AS (SELECT *, regexp_matches(line, '\S') AS has_text, line LIKE '#%' AS is_meta FROM l),
f AS (SELECT file, min(line_no) AS first_line FROM d WHERE has_text AND NOT is_meta GROUP BY file)
SELECT file, first_line::INT AS line_no, 'error' AS level, 'fatal' AS issue FROM f
UNION ALL SELECT doc_id, NULL, 'error', 'no rows' FROM documents WHERE doc_id NOT IN (SELECT file FROM f)
""")
def tsv_issues(spark, sf_dir):
    files = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))
    kinds = pair_tsv.classified(pair_tsv.lines(files))
    return pair_tsv.issues(kinds, pair_tsv.pairs(kinds))


@query("WITH " + inputs.TURNS + " SELECT pair_id, pair_seq, src_text, tgt_text, src_para_idx, tgt_para_idx, alignment_type, round(confidence, 6) AS confidence FROM pairs")
def record_round_trip(spark, sf_dir):
    pairs = inputs.turns(spark, sf_dir)
    langs = pairs.select("pair_id").distinct().select("pair_id", F.lit("en").alias("src_lang"), F.lit("fr").alias("tgt_lang"))
    back = records.pairs(records.read(exports.record_json(pairs, langs)), "pair_id")
    return back.select("pair_id", "pair_seq", "src_text", "tgt_text", "src_para_idx", "tgt_para_idx", "alignment_type", r6(F.col("confidence")).alias("confidence"))


@query("WITH " + EXPORTED + """
SELECT pair_id, 'source' AS side, para_idx, coalesce(img, '') AS images FROM disp
UNION ALL SELECT own.pair_id AS pair_id, 'target', pl, 't' || pl FROM own JOIN (SELECT DISTINCT pair_id FROM pairs) k ON k.pair_id = own.pair_id
UNION ALL SELECT DISTINCT pair_id, 'list', NULL::INT, img FROM disp WHERE img IS NOT NULL
UNION ALL SELECT own.pair_id AS pair_id, 'list', NULL::INT, 't' || pl FROM own JOIN (SELECT DISTINCT pair_id FROM pairs) k ON k.pair_id = own.pair_id
""")
def record_paragraphs(spark, sf_dir):
    """Paragraphs of both sides and the image list, written into records and read back."""
    pairs, paragraphs, targets = illustrated(spark, sf_dir)
    paragraphs = paragraphs.where(~tx.is_blank(F.col("text")) | (F.size("image_ids") > 0))
    langs = pairs.select("pair_id").distinct().select("pair_id", F.lit("en").alias("src_lang"), F.lit("fr").alias("tgt_lang"))
    ids = paragraphs.select("pair_id", "image_ids").unionByName(targets.select("pair_id", "image_ids")).select("pair_id", F.explode("image_ids").alias("id")).distinct()
    back = records.read(exports.record_json(pairs, langs, paragraphs, targets, ids.withColumn("mime_type", F.lit("image/png"))))
    side = lambda f, name: f(back, "pair_id").select("pair_id", F.lit(name).alias("side"), "para_idx", F.array_join("image_ids", ",").alias("images"))
    listed = records.images(back, "pair_id").select("pair_id", F.lit("list").alias("side"), F.lit(None).cast("int").alias("para_idx"), F.col("id").alias("images"))
    return side(records.source_paragraphs, "source").unionByName(side(records.target_paragraphs, "target")).unionByName(listed)


@query("SELECT doc_id, false AS is_record FROM documents")
def foreign_records(spark, sf_dir):
    read = records.read(inputs.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return read.select("doc_id", F.col("record").isNotNull().alias("is_record"))


@query("""
WITH r AS (SELECT source AS book_id, 'img/' || (doc_id % 7) || ' a.png' AS asset_id, doc_id FROM documents),
f AS (SELECT book_id, asset_id, min(doc_id) AS doc_id FROM r GROUP BY book_id, asset_id)
SELECT book_id, asset_id, doc_id, 'src_' || regexp_replace(asset_id, '[^A-Za-z0-9._-]', '_', 'g') AS file_name, CASE WHEN doc_id % 2 = 0 THEN 'stored' ELSE 'own' END AS payload FROM f
""")
def book_images(spark, sf_dir):
    refs = inputs.table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.concat(F.lit("img/"), F.col("doc_id") % 7, F.lit(" a.png")).alias("asset_id"), "doc_id")
    first = exports.distinct_images(refs, ["doc_id"])
    assets = first.where("doc_id % 2 = 0").select("book_id", "asset_id", F.lit("stored").alias("data"))
    return records.with_payload(first, assets, F.lit("own"))


# ---------------------------------------------------------------- markup and items


def blocks_sql() -> str:
    decoded = "text"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        decoded = f"replace({decoded}, '&{name};', '{char}')"
    ends = ", ".join(f"'{t}'" for t in markup.BLOCK_TAGS)
    return rf"""
WITH b AS (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)^.*?<body\b[^>]*>', ''), '{markup.TOKEN}') AS tokens FROM pages),
u AS (SELECT page_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM b),
t AS (SELECT page_id, pos, CASE WHEN starts_with(token, '<') THEN lower(regexp_extract(token, '^</?\s*([A-Za-z][A-Za-z0-9:]*)', 1)) END AS tag, starts_with(token, '</') AS closing,
  CASE WHEN NOT starts_with(token, '<') THEN regexp_replace(token, '[ \t]*[\n\r]+[ \t]*', ' ', 'g') END AS text FROM u WHERE NOT regexp_matches(token, '(?is)^(<!|<script|<style|<\?)')),
f AS (SELECT *, sum(CASE WHEN tag IN ({ends}) THEN 1 ELSE 0 END) OVER w AS p_part, sum(CASE WHEN tag IN ({ends}, 'br', 'img') THEN 1 ELSE 0 END) OVER w AS br_part
  FROM t WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, bool_or(coalesce(tag = 'p' AND NOT closing, false)) OVER (PARTITION BY page_id, p_part) AS in_p FROM f),
n AS (SELECT *, bool_or(in_p AND text IS NOT NULL AND regexp_matches({decoded}, '\S')) OVER (PARTITION BY page_id) AS by_p FROM g),
j AS (SELECT page_id, CASE WHEN by_p THEN p_part ELSE br_part END AS part, string_agg(text, '' ORDER BY pos) AS text FROM n WHERE text IS NOT NULL AND (in_p OR NOT by_p) GROUP BY page_id, CASE WHEN by_p THEN p_part ELSE br_part END),
k AS (SELECT page_id, part, regexp_replace({decoded}, '^\s+|\s+$', '', 'g') AS text FROM j)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY part) - 1)::INT AS block_idx, text FROM k WHERE text <> ''
"""


@query(blocks_sql())
def page_blocks(spark, sf_dir):
    return markup.blocks(inputs.table(spark, sf_dir, "pages")).drop("image_ids")


#: Lists of a page as divs in a div, each with an image; the files of even pages are there.
NESTING = ((r"<ul>", r'<div class="x bs1">All &#x1F600;&hellip; '), (r'<li><a href="/([^"]*)">', r'<div class="bs"><img src="../img/\1.png" alt=""/>'), (r"</a></li>|</ul>", "</div>"))


@query(rf"""
WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{NESTING[0][0]}', '{NESTING[0][1]}', 'g'), '{NESTING[1][0]}', '{NESTING[1][1]}', 'g'), '{NESTING[2][0]}', '{NESTING[2][1]}', 'g') AS html FROM pages),
b AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)^.*?<body\b[^>]*>', ''), '{markup.TOKEN}') AS tokens FROM h),
u AS (SELECT page_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM b),
d AS (SELECT *, starts_with(token, '<div') AS opens, token = '</div>' AS shuts, regexp_matches(token, '^<div class="(x )?bs1?"') AS bs FROM u),
l AS (SELECT *, sum(opens::INT - shuts::INT) OVER (PARTITION BY page_id ORDER BY pos) + shuts::INT AS level, sum(bs::INT) OVER (PARTITION BY page_id) AS n FROM d),
s AS (SELECT page_id, pos AS low, bs, lead(pos) OVER (PARTITION BY page_id, level ORDER BY pos) AS high FROM l WHERE n >= 3 AND (opens OR shuts)),
x AS (SELECT s.page_id AS page_id, low, pos, CASE WHEN NOT starts_with(token, '<') THEN token END AS text, CASE WHEN starts_with(token, '<img') AND u.page_id % 2 = 0 THEN regexp_extract(token, '<img src="../(img/[^"]*)"', 1) END AS image
  FROM s JOIN u ON u.page_id = s.page_id AND pos > low AND pos < high WHERE bs),
i AS (SELECT page_id, low, image, min(pos) AS pos FROM x WHERE image IS NOT NULL GROUP BY page_id, low, image),
k AS (SELECT page_id, low, string_agg(image, ' ' ORDER BY pos) AS images FROM i GROUP BY page_id, low),
y AS (SELECT page_id, low, string_agg(text, '' ORDER BY pos) AS text FROM x GROUP BY page_id, low),
j AS (SELECT y.page_id AS page_id, y.low AS low, text, images FROM y LEFT JOIN k ON k.page_id = y.page_id AND k.low = y.low),
t AS (SELECT page_id, low, regexp_replace(replace(replace(replace(replace(replace(text, '&quot;', '"'), '&#x1F600;', '😀'), '&hellip;', '…'), '&copy;', '©'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS text, coalesce(images, '') AS images FROM j)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY low) - 1)::INT AS block_idx, text, images FROM t WHERE text <> '' OR images <> ''
""")
def nested_blocks(spark, sf_dir):
    """Blocks of divs in divs with their images; pages with too few of them have none here."""
    pages = inputs.table(spark, sf_dir, "pages").select("page_id", "html")
    for pattern, new in NESTING:
        pages = pages.withColumn("html", F.regexp_replace("html", pattern, new.replace("\\1", "$1")))
    pages = pages.where(F.size(F.regexp_extract_all("html", F.lit('<div class="(x )?bs1?"'), F.lit(0))) >= 3)
    names = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'<img src="\.\./(img/[^"]*)"'), F.lit(1))))
    members = pages.where("page_id % 2 = 0").select("page_id", names.alias("path"))
    found = markup.blocks(pages, path=F.lit("text/page.xhtml"), members=members, on=["page_id"])
    return found.select("page_id", "block_idx", "text", F.array_join("image_ids", " ").alias("images"))


@query(r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="/([^"'']+)"', 1) AS l FROM pages),
u AS (SELECT page_id, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM l),
d AS (SELECT page_id, name, min(pos) AS pos FROM u GROUP BY page_id, name)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INT AS image_idx, 'OEBPS/img/' || name AS asset_id, 'application/octet-stream' AS mime_type FROM d
""")
def page_images(spark, sf_dir):
    """Local links taken for pictures beside the page."""
    pages = inputs.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", '<a href="/', '<img src="../img/').alias("html"))
    return markup.image_refs(pages, F.concat(F.lit("OEBPS/text/"), F.col("page_id"), F.lit(".xhtml")))


def zipped_books(spark, sf_dir):
    """Pages as zipped books of five: the second page is left out of the spine, the third is its navigation."""

    def run(frame):
        import io
        import zipfile

        import pandas as pd

        ids = sorted(frame["page_id"])
        html = dict(zip(frame["page_id"], frame["html"], strict=True))
        item = "".join(f'<item id="p{k}" href="text/{k}.xhtml"{" properties='nav'" if k % 5 == 2 else ""}/>' for k in ids)
        ref = "".join(f'<itemref idref="p{k}"/>' for k in reversed(ids) if k % 5 != 1)
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
            z.writestr("OEBPS/content.opf", f"<package><manifest>{item}</manifest><spine>{ref}<itemref idref='none'/></spine></package>")
            for k in ids:
                z.writestr(f"OEBPS/text/{k}.xhtml", html[k] or "")
        return pd.DataFrame({"book_id": [int(ids[0]) // 5], "content": [data.getvalue()]})

    pages = inputs.table(spark, sf_dir, "pages").select("page_id", "html", F.floor(F.col("page_id") / 5).alias("b"))
    return pages.groupBy("b").applyInPandas(run, "book_id long, content binary")


@query("""SELECT page_id // 5 AS book_id, (row_number() OVER (PARTITION BY page_id // 5 ORDER BY page_id DESC) - 1)::INT AS spine_pos, 'OEBPS/text/' || page_id || '.xhtml' AS path, length(html)::BIGINT AS n
FROM pages WHERE page_id % 5 NOT IN (1, 2) AND html <> ''""")
def book_spines(spark, sf_dir):
    found = spine.spine(spine.members(zipped_books(spark, sf_dir)))
    return found.select("book_id", "spine_pos", "path", F.char_length("xhtml").cast("long").alias("n"))


@query(r"""
SELECT page_id, CASE WHEN instr(html, '<h1>') > 0 AND instr(html, '</h1>') > 0 THEN regexp_replace(substr(html, instr(html, '<h1>') + 4, instr(html, '</h1>') - instr(html, '<h1>') - 4), '^\s+|\s+$', '', 'g') END AS title,
nullif(regexp_extract(html, '(?i)charset\s*=\s*["'']?\s*([^"''\s;>]+)', 1), '') AS charset FROM pages
""")
def page_slices(spark, sf_dir):
    html = F.col("html")
    return inputs.table(spark, sf_dir, "pages").select("page_id", markup.between_markers(html, "<h1>", "</h1>").alias("title"), markup.charset(html.cast("binary")).alias("charset"))


@query("SELECT page_id, 'utf-8' AS charset, length(html) AS n, NULL::VARCHAR AS error FROM pages")
def page_decoding(spark, sf_dir):
    files = inputs.table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return markup.decoded(files).select("page_id", "charset", F.char_length("text").cast("long").alias("n"), "error")


@query(r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '<a href="(/[^"]*)">[^<]*</a>', 1) AS a, regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1) AS b FROM pages)
SELECT page_id, (generate_subscripts(a, 1) - 1)::INT AS heading_idx, unnest(a) AS anchor, unnest(b) AS label FROM h
""")
def page_headings(spark, sf_dir):
    return markup.headings(inputs.table(spark, sf_dir, "pages"), r'<a href="(/[^"]*)">[^<]*</a>', r'<a href="/[^"]*">([^<]*)</a>')


ITEMS = r"""
w AS (SELECT doc_id AS book_id, unnest(string_split(text, chr(10))) AS str, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
"""


@query("WITH " + ITEMS + r""",
t AS (SELECT book_id, line, regexp_replace(str, '^\s+|\s+$', '', 'g') AS str, (line - 1) // 40 AS page, ((line - 1) % 40) // 4 AS block FROM w WHERE str <> ''),
p AS (SELECT book_id, page, block, string_agg(str, ' ' ORDER BY line) AS text FROM t WHERE str <> '' GROUP BY book_id, page, block)
SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY page, block) - 1)::INT AS para_idx, page::INT AS page, text FROM p
""")
def item_paragraphs(spark, sf_dir):
    """Lines laid out 40 to a page, 12 apart, with a wide gap after every fourth."""
    lines = inputs.books(spark, sf_dir).select("book_id", F.posexplode(F.split("text", "\n")).alias("line", "str"))
    k = F.col("line") % 40
    y = (F.lit(5000) - k * 12 - F.floor(k / 4) * 100).cast("double")
    items = lines.select("book_id", F.floor(F.col("line") / 40).cast("int").alias("page"), k.alias("item_idx"), "str", y.alias("y"), F.lit(12.0).alias("height"), F.lit(False).alias("has_eol"))
    return paras.item_paragraphs(items)


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'epub' WHEN doc_id % 4 = 1 THEN 'pdf' ELSE 'txt' END AS type, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 = 0 THEN 'Own ' || doc_id ELSE source || '-' || doc_id END AS title FROM documents WHERE doc_id % 4 <> 3
""")
def file_catalog(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").withColumn("ext", F.element_at(F.array(*[F.lit(x) for x in ("EPUB", "pdf", "txt", "doc")]), (F.col("doc_id") % 4 + 1).cast("int")))
    files = docs.select("doc_id", F.concat("source", F.lit("-"), "doc_id", F.lit("."), "ext").alias("file_name"), F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit(" Own "), "doc_id", F.lit(" "))).alias("own_title"))
    return paras.file_catalog(files, F.col("file_name"), F.lit(None).cast("string"), F.col("own_title")).select("doc_id", "type", "title")


# ---------------------------------------------------------------- search


def asked_queries(spark, sf_dir):
    """The query set: every benchmark row whose id is divisible by 20, whole."""
    return inputs.table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def search_pairs_sql(asked: str) -> str:
    return "WITH " + NUMBERED + f""",
q AS ({asked}),
h AS (SELECT query_id, pair_id, display_idx, pair_idx, CASE WHEN instr(lower(src_text), q) > 0 THEN src_text ELSE tgt_text END AS snippet FROM ranked, q WHERE instr(lower(src_text), q) > 0 OR instr(lower(tgt_text), q) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, pair_id ORDER BY display_idx, pair_idx) AS rank, count(*) OVER (PARTITION BY query_id, pair_id) AS n FROM h)
SELECT query_id, pair_id, rank::INT AS rank, display_idx || '-' || pair_idx AS id, display_idx::INT AS para_idx, snippet, n > 30 AS has_more FROM r WHERE rank <= 30
"""


ASKED = "SELECT item_id AS query_id, lower(trim(text)) AS q FROM benchmark WHERE item_id % 20 = 0 AND trim(text) <> ''"


@query(search_pairs_sql(ASKED))
def search_pairs(spark, sf_dir):
    shown = display.numbered(display.displayed(inputs.turns(spark, sf_dir)))
    return search.search_pairs(shown, asked_queries(spark, sf_dir))


@query(search_pairs_sql("SELECT conv_id * 1000 + turn AS query_id, lower(trim(text)) AS q FROM conversations WHERE conv_id % 20 = 0 AND trim(text) <> ''"))
def search_turns(spark, sf_dir):
    """Turns of every twentieth conversation, searched in all."""
    shown = display.numbered(display.displayed(inputs.turns(spark, sf_dir)))
    asked = inputs.table(spark, sf_dir, "conversations").where("conv_id % 20 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return search.search_pairs(shown, asked)


def search_books_sql(asked: str) -> str:
    return "WITH " + inputs.PARAGRAPHS + f""",
q AS ({asked}),
h AS (SELECT query_id, book_id, para_idx, text, q, instr(lower(text), q) - 1 AS hit FROM paragraphs, q WHERE instr(lower(text), q) > 0),
c AS (SELECT *, greatest(0, hit - 50) AS a, least(length(text), hit + length(q) + 50) AS z FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, book_id ORDER BY para_idx) AS rank, count(*) OVER (PARTITION BY query_id, book_id) AS n FROM c)
SELECT query_id, book_id, rank::INT AS rank, para_idx, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(text, a + 1, z - a) || CASE WHEN z < length(text) THEN '…' ELSE '' END AS snippet, n > 30 AS has_more FROM r WHERE rank <= 30
"""


@query(search_books_sql("SELECT book_id * 100000 + para_idx AS query_id, lower(text) AS q FROM paragraphs WHERE book_id % 20 = 0"))
def search_lines(spark, sf_dir):
    """Lines of every twentieth book, searched in all."""
    lines = inputs.paragraphs(spark, sf_dir)
    asked = lines.where("book_id % 20 = 0").select((F.col("book_id") * 100_000 + F.col("para_idx")).alias("query_id"), F.col("text").alias("query"))
    return search.search_books(lines, asked)


@query(search_books_sql(ASKED))
def search_books(spark, sf_dir):
    return search.search_books(inputs.paragraphs(spark, sf_dir), asked_queries(spark, sf_dir))


# ---------------------------------------------------------------- catalog


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def catalog_page(spark, sf_dir):
    return catalog.page(inputs.table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 50, 25).select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_partkey = 7 OR l_suppkey = 7")
def catalog_of_book(spark, sf_dir):
    found = catalog.of_book(inputs.table(spark, sf_dir, "lineitem"), 7, "l_partkey", "l_suppkey", "l_shipdate", "l_orderkey")
    return found.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""
SELECT l_orderkey, l_linenumber, p.p_name AS src_name, q.p_name AS tgt_name, coalesce(n.n_name, (l_suppkey % 40)::VARCHAR) AS label
FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN part q ON q.p_partkey = l_suppkey LEFT JOIN nation n ON n.n_nationkey = l_suppkey % 40 WHERE l_partkey <> l_suppkey
""")
def catalog_jobs(spark, sf_dir):
    jobs = inputs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src_book_id"), F.col("l_suppkey").alias("tgt_book_id"))
    books = inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("name"))
    models = inputs.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("model_id"), F.col("n_name").alias("model_label"))
    found = catalog.labelled(catalog.with_books(jobs, books), models, (F.col("tgt_book_id") % 40).cast("string"))
    return found.select("l_orderkey", "l_linenumber", "src_name", "tgt_name", "label")


@query("""
SELECT source, lang, count(*) AS n, min(doc_id) AS "first", max(doc_id) AS "last" FROM documents WHERE lang IS DISTINCT FROM 'de' AND doc_id IS NOT NULL GROUP BY source, lang
""")
def stored_books(spark, sf_dir):
    """All books stored in two writes, the German ones deleted, the rest compacted and counted."""
    folder, schema = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "id long, source string, lang string"
    rows = inputs.books(spark, sf_dir).where("book_id is not null").select(F.col("book_id").alias("id"), "source", "lang")
    german = F.coalesce(F.col("lang") == "de", F.lit(False))
    store.add(rows.where(german), f"{folder}/a")
    store.add(rows.where(~german), f"{folder}/a")
    store.remove(rows.where(german), f"{folder}/a")
    store.compacted(store.stored(spark, f"{folder}/a", schema), f"{folder}/b")
    left = store.stored(spark, f"{folder}/b", schema)
    return left.groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("WITH " + inputs.TURNS + """ SELECT pair_id, count(*) FILTER (WHERE alignment_type = '1:1') AS matched, count(*) FILTER (WHERE alignment_type <> '0:1') AS src_total, count(*) FILTER (WHERE alignment_type <> '1:0') AS tgt_total FROM pairs GROUP BY pair_id""")
def import_totals(spark, sf_dir):
    return catalog.import_totals(inputs.turns(spark, sf_dir))


# ---------------------------------------------------------------- reading positions

STARTS = inputs.PARAGRAPHS + """,
starts AS (SELECT book_id, para_idx, coalesce(sum(length(text)) OVER (PARTITION BY book_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(text)::BIGINT AS n_chars FROM paragraphs),
total AS (SELECT book_id, max(para_idx) + 1 AS para_idx, sum(n_chars)::BIGINT AS start, 0::BIGINT AS n_chars FROM starts GROUP BY book_id)
"""


@query("WITH " + STARTS + " SELECT book_id, para_idx, start, n_chars FROM starts UNION ALL SELECT book_id, para_idx, start, n_chars FROM total")
def char_starts(spark, sf_dir):
    return progress.char_starts(inputs.paragraphs(spark, sf_dir))


@query("WITH " + STARTS + """
SELECT d.doc_id AS book_id, (d.doc_id * 37) % 3000 AS char, (SELECT max(s.para_idx) FROM starts s WHERE s.book_id = d.doc_id AND s.start <= (d.doc_id * 37) % 3000) AS para_idx FROM documents d
""")
def paragraph_at(spark, sf_dir):
    positions = inputs.books(spark, sf_dir).select("book_id", (F.col("book_id") * 37 % 3000).alias("char"))
    return progress.paragraph_at(positions, progress.char_starts(inputs.paragraphs(spark, sf_dir)))


@query("WITH " + STARTS + """
SELECT d.doc_id AS book_id, (d.doc_id % 4)::INT AS page, coalesce((SELECT min(s.start) FROM starts s WHERE s.book_id = d.doc_id AND (s.start // 400) * 820.0 >= (d.doc_id % 4) * 820.0), t.start) AS char
FROM documents d JOIN total t ON t.book_id = d.doc_id
""")
def page_start(spark, sf_dir):
    starts = progress.char_starts(inputs.paragraphs(spark, sf_dir))
    layout = starts.select("book_id", "start", F.when(F.col("n_chars") > 0, F.floor(F.col("start") / 400) * 820.0).alias("offset_left"))
    pages = inputs.books(spark, sf_dir).select("book_id", (F.col("book_id") % 4).cast("int").alias("page"), F.lit(780.0).alias("width"), F.lit(40.0).alias("gap"))
    return progress.page_start(pages, layout).select("book_id", "page", "char")


def positions(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts", (F.col("value") - 2).alias("char_count"), F.when(F.col("event_type") == "error", 0.0).otherwise(500.0).alias("total_chars"))


@query("""
WITH v AS (SELECT user_id AS key, ts, value - 2 AS c FROM events WHERE value - 2 >= 0 AND event_type <> 'error')
SELECT key, arg_max(c, ts) AS char_count, 500.0 AS total_chars, max(ts) AS ts, floor(100.0 * arg_max(c, ts) / 500.0 + 0.5)::BIGINT AS percent FROM v GROUP BY key
""")
def latest_positions(spark, sf_dir):
    found = progress.latest(positions(spark, sf_dir))
    return found.withColumn("percent", progress.percent(F.col("char_count"), F.col("total_chars")))


@query("""
SELECT user_id AS key, arg_max(CASE WHEN event_type IN ('click', 'view') THEN event_type END, ts) FILTER (WHERE event_type IN ('click', 'view')) AS view, arg_max(value > 20, ts) FILTER (WHERE value <= 50) AS page_num_hidden FROM events GROUP BY user_id
""")
def merged_preferences(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events").withColumnRenamed("user_id", "key")
    fields = {"view": F.when(F.col("event_type").isin("click", "view"), F.col("event_type")), "page_num_hidden": F.when(F.col("value") <= 50, F.col("value") > 20)}
    return progress.merged_preferences(events, fields)


@query("""
WITH v AS (SELECT user_id AS key, arg_max(value - 2, ts) AS c FROM events WHERE value - 2 >= 0 AND event_type <> 'error' GROUP BY user_id)
SELECT c_custkey AS key, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, v.c, 0.0) AS value FROM customer LEFT JOIN v ON v.key = c_custkey
""")
def restored_positions(spark, sf_dir):
    wanted = inputs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("explicit"))
    return progress.restored(wanted, progress.latest(positions(spark, sf_dir)), F.lit(0.0)).select("key", "value")
