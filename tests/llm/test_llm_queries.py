import duckdb
import pytest

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if k.startswith("op")}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda f: sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert name == "mixing" or docs.count() <= before
        before = docs.count()
    want = {r["doc_id"] for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.collect()} == want


def test_pipeline_drops_near_copies(spark):
    words = [f"w{k}" for k in range(200)]
    data = [(0, " ".join(words))] + [(n, " ".join([*words[: 30 * n], "other", *words[30 * n + 1 :]])) for n in range(1, 6)] + [(9, "some quite different text")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, SF).collect()} == {0, 9}
