import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from twinfold.operators import catalog, progress, search, store
from twinfold.streaming import jobs

T0 = datetime(2024, 1, 1)


def test_search(spark):
    shown = spark.createDataFrame([("p", 0, k, f"Hello {k}", "Bonjour") for k in range(5)] + [("p", 1, 0, "x", "Au REVOIR")], "pair_id string, display_idx int, pair_idx int, src_text string, tgt_text string")
    asked = spark.createDataFrame([(1, " hello "), (2, "revoir"), (3, "  "), (4, "bonjour")], "query_id int, query string")
    got = search.search_pairs(shown, asked, most=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["has_more"]) for r in got] == [(1, "0-0", True), (1, "0-1", True), (1, "0-2", True), (2, "1-0", False), (4, "0-0", True), (4, "0-1", True), (4, "0-2", True)]
    assert got[3]["snippet"] == "Au REVOIR"
    book = spark.createDataFrame([(1, 0, "a" * 60 + "Needle" + "b" * 60), (1, 1, "needle")], "book_id int, para_idx int, text string")
    found = [r["snippet"] for r in search.search_books(book, spark.createDataFrame([(1, "NEEDLE")], "query_id int, query string")).orderBy("rank").collect()]
    assert found == ["…" + "a" * 50 + "Needle" + "b" * 50 + "…", "needle"]


def test_positions(spark):
    paras = spark.createDataFrame([("b", k, "x" * n) for k, n in enumerate((11, 7, 3))], "book_id string, para_idx int, text string")
    starts = progress.char_starts(paras)
    assert [r["start"] for r in starts.orderBy("para_idx").collect()] == [0, 11, 18, 21]
    asked = spark.createDataFrame([("b", c) for c in (-5, 0, 10, 11, 17, 18, 20, 500)], "book_id string, char long")
    assert [r["para_idx"] for r in progress.paragraph_at(asked, starts).orderBy("char").collect()] == [0, 0, 0, 1, 1, 2, 2, 2]
    layout = spark.createDataFrame([("b", s, o) for s, o in zip([0, 11, 18, 21, 25], [0.0, 0.0, 820.0, 1640.0, None], strict=True)], "book_id string, start long, offset_left double")
    pages = spark.createDataFrame([("b", p, 780.0, 40.0) for p in range(4)], "book_id string, page int, width double, gap double")
    assert [r["char"] for r in progress.page_start(pages, layout).orderBy("page").collect()] == [0, 18, 21, 25]


def test_preferences_and_restore(spark):
    rows = [("k", T0, 5.0, 10.0), ("k", T0 + timedelta(1), -1.0, 10.0), ("k", T0 + timedelta(2), 7.0, 0.0), ("j", T0, float("nan"), 5.0)]
    saved = progress.latest(spark.createDataFrame(rows, "key string, ts timestamp, char_count double, total_chars double"))
    assert [(r["key"], r["char_count"]) for r in saved.collect()] == [("k", 5.0)]
    prefs = spark.createDataFrame([("k", T0, "side", None), ("k", T0 + timedelta(1), None, True), ("k", T0 + timedelta(2), "bad", None)], "key string, ts timestamp, view string, hidden boolean")
    merged = progress.merged_preferences(prefs, {"view": F.when(F.col("view").isin("side", "pop"), F.col("view")), "hidden": F.col("hidden")}).first()
    assert (merged["view"], merged["hidden"]) == ("side", True)
    wanted = spark.createDataFrame([("k", None), ("z", None), ("k2", 9.0)], "key string, explicit double")
    assert {r["key"]: r["value"] for r in progress.restored(wanted, saved, F.lit(1.0)).collect()} == {"k": 5.0, "z": 1.0, "k2": 9.0}


def test_catalog(spark, tmp_path):
    table = spark.createDataFrame([(k, "a" if k % 2 else "b", "c", T0 + timedelta(k // 2)) for k in range(6)], "id int, s string, t string, at timestamp")
    assert [r["id"] for r in catalog.page(table, "at", "id", 1, 2).collect()] == [4, 3]
    assert [r["id"] for r in catalog.of_book(table, "a", "s", "t", "at", "id").collect()] == [1, 3, 5]
    catalog.add(table.select("s").limit(2), str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.select("id").distinct().count() == 2
    catalog.remove(table, table.where("id < 5").select("id"), "id", str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 1


def test_streams(spark, tmp_path):
    schema = "event_id long, key string, ts timestamp, char_count double, total_chars double"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([(1, "k", T0, 5.0, 10.0), (2, "j", T0, 1.0, 10.0)], [(3, "k", T0 + timedelta(minutes=5), 8.0, 10.0)], [(4, "k", T0 + timedelta(minutes=1), 6.0, 10.0), (3, "k", T0 + timedelta(minutes=5), 9.0, 10.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.follow_positions(stream, out, str(tmp_path / "c")).awaitTermination()
    last = jobs.read_version(spark, out, 2)
    assert {r["key"]: r["char_count"] for r in last.collect()} == {"k": 8.0, "j": 1.0}


def test_job_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([("a", 1), ("b", 2)], [("b", 2), ("c", 3), ("c", 3)]):
        spark.createDataFrame(batch, "pair_id string, n int").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("pair_id string, n int").parquet(src)
        jobs.follow_jobs(stream, lambda d: d.withColumn("m", F.col("n") * 2), out, str(tmp_path / "c")).awaitTermination()
    assert sorted((r["pair_id"], r["m"]) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 4), ("c", 6)]


def test_latest_positions_in_the_state_store(spark, tmp_path):
    schema = "event_id long, key string, ts timestamp, char_count double, total_chars double"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, "k", T0, 5.0, 10.0), (2, "j", T0, 1.0, 10.0)], [(3, "k", T0 + timedelta(days=5), 8.0, 10.0), (9, "k", T0 + timedelta(days=9), -1.0, 10.0)], [(4, "k", T0 + timedelta(1), 6.0, 10.0), (3, "k", T0 + timedelta(days=5), 8.0, 10.0)]]
    touched = []
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.follow_latest(stream, out, str(tmp_path / "c")).awaitTermination()
        touched.append(spark.read.parquet(f"{out}/batch={n}").count())
    # a batch writes its own keys only
    assert touched == [2, 1, 1]
    assert {r["key"]: r["char_count"] for r in jobs.read_latest(spark, out).collect()} == {"k": 8.0, "j": 1.0}


def test_store(spark, tmp_path):
    import os
    from concurrent.futures import ThreadPoolExecutor

    path, schema = str(tmp_path / "s"), "id string, title string"
    titles = lambda a, b: spark.createDataFrame([(f"t{k}",) for k in range(a, b)], "title string")
    with ThreadPoolExecutor(2) as pool:
        made = [r for part in pool.map(lambda ab: store.add(titles(*ab), path).collect(), [(0, 30), (30, 60)]) for r in part]
    read = lambda p=path: store.stored(spark, p, schema)
    assert len({r["id"] for r in made}) == 60 == store.counted(read()).first()["n"]
    assert {(r["id"], r["title"]) for r in made} == {(r["id"], r["title"]) for r in read().collect()}
    one = made[7]
    assert [r["title"] for r in store.get(read(), one["id"]).collect()] == [one["title"]] and store.get(read(), "none").count() == 0
    # a lookup reads one bucket
    assert f"(bucket#" in (plan := store.get(read(), one["id"])._jdf.queryExecution().toString()) and "PartitionFilters: [isnotnull(bucket" in plan
    files = {f for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    store.remove(spark.createDataFrame([(one["id"],), ("unknown",), (None,)], "id string"), path)
    assert files < {f for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert store.get(read(), one["id"]).count() == 0 and store.counted(read()).first()["n"] == 59
    store.add(spark.createDataFrame([("own", "last")], "id string, title string"), path)
    assert store.listed(read()).first()["id"] == "own"
    store.compacted(read(), str(tmp_path / "u"))
    assert sorted(read().collect()) == sorted(read(str(tmp_path / "u")).collect())


def test_queries_of_many_wordings_read_the_texts_once(spark):
    """60 wordings in 120 queries, found as plain search does; one block, whatever their number in the old one was."""
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    texts = [(1, k, f"{words[k % 5]} {words[k % 3]} x{k} {words[k % 4]}.") for k in range(60)]
    book = spark.createDataFrame(texts, "book_id int, para_idx int, text string")
    lines = [(2 * k + c, t.upper() if c else t) for k, (_, _, t) in enumerate(texts) for c in (0, 1)] + [(900, "alpha nowhere beta"), (901, "a"), (902, "x1"), (903, " ")]
    found = search.hits(book, ["text"], spark.createDataFrame(lines, "query_id int, query string"))
    want = sorted((k, p) for k, q in lines for _, p, t in texts if q.strip() and q.strip().lower() in t)
    assert sorted((r["query_id"], r["para_idx"]) for r in found.collect()) == want
    asked = search.wordings(spark.createDataFrame(lines, "query_id int, query string"))
    assert asked.count() == 63 and "nowhere" not in {r["anchor"] for r in search.anchored(asked, spark.createDataFrame([("alpha", 9), ("x1", 1)], "word string, n long")).collect()}


def test_repeated_queries_are_ranked_once_and_answered_last(spark, monkeypatch):
    """Anchors of every kind and blocks of every size find what plain search does; queries get their wording's hits after these are ranked."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "Ab", "x"]
    texts = [(b, p, rng.choice(["", "(", "“"]) + rng.choice([" ", ", ", "-"]).join(rng.choice(words) for _ in range(rng.randint(1, 9))) + ".") for b in range(5) for p in range(9)]
    book = spark.createDataFrame(texts, "book_id int, para_idx int, text string")
    lines = [(k, t.upper() if k % 2 else t) for k, (_, _, t) in enumerate(texts)] + [(k + 100, t[rng.randint(0, 4) : rng.randint(6, 40)]) for k, (_, _, t) in enumerate(texts)]
    lines += [(200 + k, q) for k, q in enumerate(["x", "-", "lph", "a, b", " ", "eta gamm", "alpha nowhere beta", *["beta"] * 20])]
    asked = spark.createDataFrame(lines, "query_id int, query string")
    want = {}
    for k, q in lines:
        for b, p, t in texts:
            if q.strip() and q.strip().lower() in t.lower():
                want.setdefault((k, b), []).append(p)
    ranked = sorted((k, b, n + 1, p, len(ps) > 2) for (k, b), ps in want.items() for n, p in enumerate(ps[:2]))
    made = search.search_books(book, asked, most=2)
    assert sorted((r["query_id"], r["book_id"], r["rank"], r["para_idx"], r["has_more"]) for r in made.collect()) == ranked
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(_ids") < plan.index("Window")
    prepared = search.prepared(asked)
    assert {r["kind"] for r in prepared.select("kind").distinct().collect()} == {"gram", "word", "run", "none"}
    pairs = sorted((k, b, p) for (k, b), ps in want.items() for p in ps)
    for direct, short in ((0, 64), (128, 0)):
        monkeypatch.setattr(search, "DIRECT", direct)
        monkeypatch.setattr(search, "SHORT", short)
        found = search.answered(search.wording_hits(book, ["text"], prepared, block=2, numbers=20), prepared, numbers=20)
        assert sorted((r["query_id"], r["book_id"], r["para_idx"]) for r in found.collect()) == pairs
    # queries of one id are ranked together
    same = search.search_books(book, spark.createDataFrame([(1, "alpha"), (1, "beta")], "query_id int, query string"), most=100)
    both = sorted((b, p) for b, p, t in texts for q in ("alpha", "beta") if q in t.lower())
    assert sorted((r["book_id"], r["para_idx"]) for r in same.collect()) == both
    assert same.groupBy("book_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).where("m <> n").count() == 0
    # texts may have a number of their own
    shown = spark.createDataFrame([("p", 0, 0, "One two three four five.", "x", 7)], "pair_id string, display_idx int, pair_idx int, src_text string, tgt_text string, number int")
    assert [r["snippet"] for r in search.search_pairs(shown, spark.createDataFrame([(1, "one two three four five")], "query_id int, query string")).collect()] == ["One two three four five."]
