import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.operators import align, display, sentences, vectors
from twinfold.plans import align_books as plan


def e(k, dim=4):
    return [1.0 if i == k - 1 else 0.0 for i in range(dim)]


def side(spark, vecs, pair="p"):
    return spark.createDataFrame([(pair, i, v) for i, v in enumerate(vecs)], "pair_id string, global_idx int, embedding array<double>")


@pytest.mark.parametrize(("src", "tgt", "want"), [([1], [1], {"1:1": 1}), ([1, 2, 3], [1, 2, 3], {"1:1": 3}), ([1, 2], [1, 2, 3], {"1:1": 2, "0:1": 1}), ([], [1], {}), ([1], [], {})])
def test_moves(spark, src, tgt, want):
    got = align.align(side(spark, [e(k) for k in src]), side(spark, [e(k) for k in tgt]), fraction=1.0)
    assert {r["alignment_type"]: r["count"] for r in got.groupBy("alignment_type").count().collect()} == want


def best_by_hand(sim, gap, free):
    m, n = sim.shape
    d = np.zeros((m + 1, n + 1))
    for i in range(m + 1):
        for j in range(n + 1):
            if i == 0 or j == 0:
                d[i, j] = 0 if free else (i + j) * gap
            else:
                d[i, j] = max(d[i - 1, j - 1] + sim[i - 1, j - 1], d[i - 1, j] + gap, d[i, j - 1] + gap)
    return d[m, n]


@pytest.mark.parametrize("gap", [0.0, -0.2])
@pytest.mark.parametrize("free", [True, False])
def test_scores_against_plain_loops(gap, free):
    rng = np.random.default_rng(3)
    for m, n in ((1, 1), (3, 3), (5, 9), (40, 31)):
        sim = rng.uniform(-1, 1, (m, n))
        score, moves, lo = align.fill(lambda i, a, b, s=sim: s[i, a:b], m, n, 1.0, gap, free)
        assert abs(score - best_by_hand(sim, gap, free)) < 1e-9
        steps = align.path(moves, lo, m, n)
        kinds = [k for k, _, _ in steps]
        assert kinds.count(0) + kinds.count(1) == m and kinds.count(0) + kinds.count(2) == n
        assert [i for _, i, _ in steps if i >= 0] == list(range(m)) and [j for _, _, j in steps if j >= 0] == list(range(n))
        if not free:
            assert abs(sum(sim[i, j] if k == 0 else gap for k, i, j in steps) - score) < 1e-6


@pytest.mark.parametrize("cells", [1, 300, 2000, 1 << 20])
def test_moves_in_blocks_are_those_of_the_whole_table(cells):
    rng = np.random.default_rng(6)
    for m, n in ((0, 3), (1, 1), (1, 90), (90, 1), (64, 64), (130, 97), (200, 333)):
        sim = rng.uniform(-1, 1, (m, n)).round(1)
        _, moves, lo = align.fill(lambda i, a, b, s=sim: s[i, a:b], m, n, 0.15, -0.05)
        assert align.steps(lambda i, a, b, s=sim: s[i, a:b], m, n, 0.15, -0.05, cells) == align.path(moves, lo, m, n)


def test_narrow_band_reaches_the_end():
    sim = np.eye(2, 400)
    score, moves, lo = align.fill(lambda i, a, b: sim[i, a:b], 2, 400, 0.15)
    assert np.isfinite(score) and len(align.path(moves, lo, 2, 400)) in (400, 401, 402)


def test_band_candidates_match_the_kernel(spark):
    sizes = spark.createDataFrame([("a", 5, 300), ("b", 300, 5), ("c", 1, 1)], "pair_id string, m long, n long")
    for p, m, n in (("a", 5, 300), ("b", 300, 5), ("c", 1, 1)):
        lo, hi = align.limits(m, n, 0.15)
        got = [(r["lo"], r["hi"]) for r in vectors.band(sizes).where(F.col("pair_id") == p).orderBy("i").collect()]
        assert got == list(zip(lo.tolist(), hi.tolist(), strict=True))


def test_same_result_for_any_partitioning(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{k % 7}", k // 7, rng.normal(size=8).tolist()) for k in range(210)]
    df = spark.createDataFrame(rows, "pair_id string, global_idx int, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, align.align(df, df.where("global_idx < 20")).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_texts_and_swap(spark):
    texts = spark.createDataFrame([("p", 0, 0, 0, "one"), ("p", 1, 0, 1, "two")], "pair_id string, global_idx int, para_idx int, sent_idx int, text string")
    pairs = align.with_texts(align.align(side(spark, [e(1), e(4)]), side(spark, [e(1)]), fraction=1.0), texts, texts)
    got = [tuple(r) for r in pairs.orderBy("pair_seq").collect()]
    assert got == [("p", 0, "one", "one", 0, 0, 0, 0, 0, 0, "1:1", 1.0), ("p", 1, "two", "", 1, 0, 1, None, None, None, "1:0", None)]
    assert sorted(map(str, align.swapped(align.swapped(pairs)).collect())) == sorted(map(str, pairs.collect()))
    assert align.summary(pairs).first()["match_pct"] == 50


PAIR = "pair_id string, pair_seq int, src_text string, tgt_text string, src_sent_idx int, src_para_idx int, src_global_idx int, tgt_sent_idx int, tgt_para_idx int, tgt_global_idx int, alignment_type string, confidence double"


def pair(seq, src, tgt, sent=0, para=0, tpara=0):
    return ("p", seq, src, tgt, sent, para, seq, 0, tpara, seq, "1:1", None)


def test_display(spark):
    pairs = spark.createDataFrame([pair(0, "world", "x", 1), pair(1, "hello", "y", 0), pair(2, " ", "z", 2), pair(3, "b", "w", 0, 1, 3), pair(4, "", "only", None, None, 9)], PAIR)
    paragraphs = spark.createDataFrame([("p", 0, "raw0", []), ("p", 1, "raw1", ["s1"]), ("p", 2, "alone", None), ("p", 3, "", []), ("p", 4, " ", ["s4"])], "pair_id string, para_idx int, text string, image_ids array<string>")
    shown = display.displayed(pairs, paragraphs)
    got = [(r["display_idx"], r["text"], len(r["pairs"]), r["image_ids"]) for r in shown.orderBy("display_idx").collect()]
    assert got == [(0, "hello world", 2, []), (1, "b", 1, ["s1"]), (2, "alone", 0, []), (3, " ", 0, ["s4"])]
    assert [r["number"] for r in display.numbered(shown).orderBy("display_idx", "pair_idx").collect()] == [1, 2, 3]
    targets = spark.createDataFrame([("p", 0, ["t0"]), ("p", 2, ["t2"]), ("p", 3, ["t3"]), ("p", 7, ["t7"]), ("p", 8, [])], "pair_id string, para_idx int, image_ids array<string>")
    placed = {r["display_idx"]: r["tgt_images"] for r in display.placed_images(display.target_homes(shown), targets, shown).collect()}
    assert placed == {0: ["t0"], 1: ["t2", "t3"], 3: ["t7"]}
    bare = display.displayed(pairs)
    assert [r["text"] for r in bare.orderBy("display_idx").collect()] == ["hello world", "b"]
    modes = {m: display.picked_images(m, F.array(F.lit("s")), F.array(F.lit("t"))) for m in ("source", "target", "both", "none")}
    assert spark.range(1).select(*[c.alias(m) for m, c in modes.items()]).first().asDict() == {"source": ["s"], "target": ["t"], "both": ["s", "t"], "none": []}


def test_chapters(spark):
    shown = spark.range(120).select(F.lit("p").alias("pair_id"), F.col("id").alias("display_idx"))
    got = {r["chapter_id"]: (r["chapter_title"], r["count"]) for r in display.chapters(shown, F.lit("T")).groupBy("chapter_id", "chapter_title").count().collect()}
    assert got == {"ch001": ("Part 1 of 3", 50), "ch002": ("Part 2 of 3", 50), "ch003": ("Part 3 of 3", 20)}
    assert display.chapters(shown.where("display_idx < 9"), F.lit("T")).first()["chapter_title"] == "T"


def test_sentences(spark):
    df = spark.createDataFrame([(1, 0, "Hello world. How are you?"), (1, 5, "   "), (1, 10, "彼は言った。大丈夫です。"), (2, 0, "One. Two."), (2, 1, None)], "book_id int, para_idx int, text string")
    got = [tuple(r)[:5] for r in sentences.sentences(df).orderBy("book_id", "global_idx").collect()]
    assert got == [(1, 0, 0, 0, "Hello world."), (1, 0, 1, 1, "How are you?"), (1, 10, 0, 2, "彼は言った。"), (1, 10, 1, 3, "大丈夫です。"), (2, 0, 0, 0, "One."), (2, 0, 1, 1, "Two.")]
    many = spark.range(10_010).select(F.lit(1).alias("book_id"), F.col("id").cast("int").alias("para_idx"), F.format_string("Sentence %d.", "id").alias("text"))
    cut = sentences.sentences(many)
    assert cut.count() == 10_000 and cut.first()["truncated"]
    assert tuple(sentences.sentence_counts(many, cap=100).first()) == (1, 100, True)


def test_whole_books_have_all_sentences(spark):
    many = spark.range(10_010).select(F.lit(1).alias("book_id"), F.col("id").cast("int").alias("para_idx"), F.format_string("Sentence %d.", "id").alias("text"))
    sizes = lambda df: df.select(F.size("sentences")).first()[0]
    assert sizes(sentences.whole_books(many)) == 10_010 and sizes(sentences.whole_books(many, cap=7)) == 7


def test_rules(spark):
    rules = sentences.valid_rules(spark, [("(", "x"), ("", "y"), ("a+", "[$&]"), (r"(?<w>b)", "$<w>$<w>")])
    assert [p for p, _ in rules] == ["a+", "(?<w>b)"]
    df = spark.createDataFrame([(1, 0, "caab")], "book_id int, para_idx int, text string")
    assert sentences.clean(df, rules).first()["text"] == "c[aa]bb"


def test_vectors(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "")], "k int, text string")
    for r in vectors.embed_hashed(df, ["k"]).collect():
        assert abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5
    made = vectors.embed_with(df, lambda: lambda ts: [[3.0, 4.0] for _ in ts], ["k"])
    assert all(abs(r["embedding"][0] - 0.6) < 1e-6 for r in made.collect())
    pooled = vectors.mean_pool(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "k int, embedding array<double>"), ["k"]).first()["embedding"]
    assert pooled == pytest.approx([0.5**0.5] * 2)


def test_whole_pipeline(spark):
    books = [("a", 0, "The cat sat. The dog ran away."), ("b", 0, "The cat sat. A bird sang. The dog ran away.")]
    paragraphs = spark.createDataFrame(books, "book_id string, para_idx int, text string")
    jobs = spark.createDataFrame([("j", "a", "b")], "pair_id string, src_book_id string, tgt_book_id string")
    got = [(r["src_text"], r["tgt_text"]) for r in plan.align_books(jobs, paragraphs, gap=-0.1).orderBy("pair_seq").collect()]
    assert got == [("The cat sat.", "The cat sat."), ("", "A bird sang."), ("The dog ran away.", "The dog ran away.")]


def test_language_jobs(spark):
    books = [(k, "hot" if k % 3 else "s", ["en", "fr", "de"][k % 4 % 3]) for k in range(60)]
    got = {(r["src_book_id"], r["tgt_book_id"]) for r in plan.language_jobs(spark.createDataFrame(books, "book_id int, source string, lang string"), (("en", "fr"), ("en", "de"))).collect()}
    want = set()
    for source in ("hot", "s"):
        of = lambda lang: [k for k, s, x in books if (s, x) == (source, lang)]  # noqa: B023, E731
        want |= set(zip(of("en"), of("fr"), strict=False)) | set(zip(of("en"), of("de"), strict=False))
    assert got == want


def test_band_rows_are_the_full_table_within_the_band():
    rng = np.random.default_rng(4)
    for m, n in ((1, 1), (3, 200), (200, 3), (150, 170), (260, 120)):
        sims = rng.normal(size=(m, n))
        lo, hi = align.limits(m, n, 0.15)
        full = np.full((m + 1, n + 1), -np.inf)
        full[0, : hi[0] + 1] = np.arange(hi[0] + 1) * -0.1
        for i in range(1, m + 1):
            for j in range(lo[i], hi[i] + 1):
                up = i * -0.1 if j == 0 else full[i - 1, j] - 0.1
                full[i, j] = max([up, full[i - 1, j - 1] + sims[i - 1, j - 1], full[i, j - 1] - 0.1] if j else [up])
        score, moves, _ = align.fill(lambda i, a, b: sims[i, a:b], m, n, 0.15, -0.1)  # noqa: B023
        assert score == pytest.approx(full[m, n])
        assert align.fill(lambda i, a, b: sims[i, a:b], m, n, 0.15, -0.1, keep=False)[0] == score  # noqa: B023
        steps = align.path(moves, lo, m, n)
        assert sum(sims[i, j] if k == align.MATCH else -0.1 for k, i, j in steps) == pytest.approx(score)


def test_replacement_forms(spark):
    rules = [(r"(\d)(x)?", "[$$$1$9$12$]"), ("0", "$9"), (r"(?<y>q)", "$<y>$<z>\\"), ("w", "$<y>")]
    assert sentences.valid_rules(spark, rules) == rules
    assert [sentences.groups_of(p) for p in (r"(a)(?:b)(?<c>d)", r"\(a[(]", r"(?=x)(?<!y)(z)")] == [2, 0, 1]
    df = spark.createDataFrame([(1, 0, "5xqw")], "book_id int, para_idx int, text string")
    assert sentences.clean(df, rules).first()["text"] == "[$5$952$]q\\$<y>"


def test_sentence_ends(spark):
    cases = {"It is 3.14 now. Next": ["It is 3.14 now.", "Next"], "...and then": ["...and then"], "...": ["..."], "e.g. this. That": ["e.g. this.", "That"], "What?! no": ["What?!", "no"], "“Go.” He": ["“Go.”", "He"], "「行け。」と言った": ["「行け。」", "と言った"], "": [], "  ": []}
    df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(cases)], "book_id int, para_idx int, text string")
    got = {k: [] for k in range(len(cases))}
    for r in sentences.sentences(df).orderBy("book_id", "global_idx").collect():
        got[r["book_id"]].append(r["text"])
    assert list(got.values()) == list(cases.values())
    books = spark.createDataFrame([(1, "One. Two.\n\n \n\nThree"), (2, None)], "book_id int, text string")
    assert [tuple(r) for r in sentences.book_sentences(books, cap=2).orderBy("global_idx").collect()] == [(1, 0, 0, 0, "One.", True), (1, 0, 1, 1, "Two.", True)]
    long = spark.createDataFrame([(1, 0, "1.2" * 200_000 + ". " * 100_000 + "a" * 300_000)], "book_id int, para_idx int, text string")
    assert sentences.sentences(long, cap=None).count() > 0


def test_sentence_breaks_by_language(spark):
    cases = [
        ("en", "Dr. No met Mr. Bond. He left.", ["Dr. No met Mr. Bond.", "He left."]),
        ("de", "Dr. No kam. Z.B. Berlin vgl. Abb. Zwei. Ende", ["Dr. No kam.", "Z.B. Berlin vgl. Abb. Zwei.", "Ende"]),
        (None, "Dr. No met him.", ["Dr.", "No met him."]),
        ("en", '"Go." Then she went (at 9.) He slept.', ['"Go."', "Then she went (at 9.)", "He slept."]),
        ("en", "It is 3.14, e.g. the U.S.A today. Next? , no; yes", ["It is 3.14, e.g. the U.S.A today.", "Next? , no; yes"]),
        ("ja", "そうか！「行け。」彼は。。。終わり", ["そうか！", "「行け。」", "彼は。。。", "終わり"]),
        ("hi", "यह है। वह है। 3 items. 3 men came", ["यह है।", "वह है।", "3 items. 3 men came"]),
        ("en", "Wait... what? No... Yes!!", ["Wait... what?", "No...", "Yes!!"]),
    ]
    rows = spark.createDataFrame([(k, 0, t, lang) for k, (lang, t, _) in enumerate(cases)], "book_id int, para_idx int, text string, lang string")
    got = {k: [] for k in range(len(cases))}
    for r in sentences.sentences(rows, lang="lang").orderBy("book_id", "global_idx").collect():
        got[r["book_id"]].append(r["text"])
    assert list(got.values()) == [want for *_, want in cases]


def test_sentence_breaks_of_long_texts(spark):
    texts = ["a" * 500_000 + " b. C", "." * 500_000 + " x", "x. " * 100_000, " " * 500_000 + "a.", "!" * 300_000 + ")" * 300_000]
    rows = spark.createDataFrame([(k, 0, t, "en") for k, t in enumerate(texts)], "book_id int, para_idx int, text string, lang string")
    assert {r["book_id"]: r["n"] for r in sentences.sentences(rows, cap=None, lang="lang").groupBy("book_id").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1}


def test_sentence_ends_follow_the_break_table(spark):
    """The one expression ends sentences where the classes of both sides of a cut do, in SQL."""
    import duckdb

    from twinfold.functions import sentence_breaks
    from twinfold.plans import inputs

    rng = np.random.default_rng(8)
    some = [".", ".", "!", "?", "…", "。", "．", "؟", ",", "-", ")", '"', "’", " ", " ", "\t", "　", "a", "B", "7", "é", "É", "Dr", "dr", "Mr.", "núm", "NÚM", "inKl", "inKl", "St", "z.B", "Abcdefghi", "漢", "\U0001d400", "\U0001f600"]
    rows = [(k, 0, "".join(rng.choice(some, int(rng.integers(1, 25)))), lang) for k, lang in enumerate(["en", "de", "fr", "es", "it", "EN-us", "xx", None] * 150)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (book_id BIGINT, para_idx INT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"WITH {inputs.split_sql('SELECT * FROM t')} SELECT book_id, sent_idx, text FROM sentences ORDER BY 1, 2").fetchall()
    df = spark.createDataFrame(rows, "book_id long, para_idx int, text string, lang string")
    clean = lambda t: t.strip()
    got = [(r["book_id"], r["sent_idx"], clean(r["text"])) for r in sentences.sentences(df, lang="lang").orderBy("book_id", "global_idx").collect()]
    assert got == [(k, n, clean(t)) for k, n, t in want if clean(t)] and len(got) > len(rows)
    # one expression a sentence end, not one for each rule
    plan = df.select(sentence_breaks.sentence_texts(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "RLIKE" not in plan


def test_books_are_aligned_as_text(spark):
    """Pair rows agree with sentences, vectors and moves made one by one; neither vectors nor sentences are joined."""
    rng = np.random.default_rng(4)
    words = ["Alpha", "beta", "İzmir", "ΟΔΟΣ", "x", "Straße", "漢字", "don't", "😀"]
    text = lambda: " ".join(rng.choice(words, int(rng.integers(1, 9)))) + "."
    paragraphs = spark.createDataFrame([(k, p, " ".join(text() for _ in range(int(rng.integers(1, 4))))) for k in range(6) for p in range(12)] + [(6, 0, " ")], "book_id long, para_idx int, text string")
    jobs = spark.createDataFrame([("a", 0, 1), ("b", 0, 2), ("c", 3, 0), ("d", 4, 5), ("e", 6, 0), ("f", 0, 0)], "pair_id string, src_book_id long, tgt_book_id long")
    parts = sentences.sentences(paragraphs, cap=20)
    side_of = lambda rows, s: jobs.select("pair_id", F.col(f"{s}_book_id").alias("book_id")).join(rows, "book_id")
    vector = vectors.embed_hashed(parts, ["book_id", "global_idx"])
    moves = align.align(side_of(vector, "src"), side_of(vector, "tgt"), align.BAND, -0.05)
    want = align.with_texts(moves, side_of(parts, "src"), side_of(parts, "tgt"))
    got = plan.align_books(jobs, paragraphs, cap=20, gap=-0.05)
    assert got.columns == want.columns
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want) and got.select("pair_id").distinct().count() == 5
    text_plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "global_idx" not in text_plan.split("Join")[-1] and "embedding" not in text_plan
