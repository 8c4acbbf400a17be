import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if pd.isna(v):
        return ""
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def cells(frame):
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


def long_books(folder, spark):
    """A source with an English book and a near version of it, and a French one; each is longer than the reference's cap of 10,000 sentences."""
    rows = []
    for k, (lang, word) in enumerate((("en", "line"), ("en", "line"), ("fr", "ligne"))):
        rows.append((k, "\n".join(f"{word} {n} of {n * 7} and {n * 11}." for n in range(10_010 + k)), lang, "s", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_split_sentences_reads_long_books_to_their_end(spark, tmp_path):
    folder, con = long_books(tmp_path, spark), duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    got, want = __spark_entry__.queries()["split_sentences"](spark, folder).toPandas(), con.execute(__spark_entry__.oracle_sql()["split_sentences"]).df()
    assert cells(got) == cells(want) and got.groupby("book_id").size().tolist() == [10_010, 10_011, 10_012] and not got["truncated"].any()


def test_align_languages_reads_long_books_to_their_end(spark, tmp_path):
    got = __spark_entry__.queries()["align_languages"](spark, long_books(tmp_path, spark))
    ends = got.agg(F.max("src_global_idx"), F.max("tgt_global_idx"), F.count("src_global_idx"), F.count("tgt_global_idx")).first()
    assert tuple(ends) == (10_009, 10_011, 10_010, 10_012)


def test_align_versions_reads_long_books_to_their_end(spark, tmp_path):
    got = __spark_entry__.queries()["align_versions"](spark, long_books(tmp_path, spark)).collect()
    assert [(r["n_src"], r["n_tgt"], r["matched"]) for r in got] == [(10_010, 10_011, 10_010)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
