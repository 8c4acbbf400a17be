import numpy as np

from twinfold.operators import vectors

SCHEMA = "pair_id string, global_idx int, embedding array<float>"


def test_tiles_give_every_cell_of_the_band_once(spark):
    rng = np.random.default_rng(4)
    sizes = {"p": (37, 52), "q": (1, 9), "r": (20, 3)}
    side = lambda k: {p: rng.normal(size=(n[k], 5)).astype("float32") for p, n in sizes.items()}
    a, b = side(0), side(1)
    rows = lambda x: spark.createDataFrame([(p, i, [float(c) for c in v]) for p, m in x.items() for i, v in enumerate(m)], SCHEMA)
    src, tgt = rows(a), rows(b)
    found = vectors.band_candidates(src, tgt, 0.1, 4, tile=8).collect()
    got = {(r["pair_id"], r["i"], r["j"]): r["sim"] for r in found}
    limits = vectors.band(spark.createDataFrame([(p, *n) for p, n in sizes.items()], "pair_id string, m long, n long"), 0.1, 4).where("i > 0").collect()
    want = {(r["pair_id"], r["i"] - 1, j - 1): float(a[r["pair_id"]][r["i"] - 1].astype(float) @ b[r["pair_id"]][j - 1].astype(float)) for r in limits for j in range(max(r["lo"], 1), r["hi"] + 1)}
    assert len(found) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_odd_vectors_have_null_similarities(spark):
    src = spark.createDataFrame([("p", 0, [1.0, 2.0]), ("p", 1, None), ("p", 2, [1.0, None]), ("p", 3, [2.0])], SCHEMA)
    tgt = spark.createDataFrame([("p", 0, [3.0, 4.0]), ("p", 1, [1.0])], SCHEMA)
    got = {(r["i"], r["j"]): r["sim"] for r in vectors.band_candidates(src, tgt).collect()}
    assert got == {(i, j): {(0, 0): 11.0, (3, 1): 2.0}.get((i, j)) for i in range(4) for j in range(2)}
    assert vectors.band_candidates(src.limit(0), tgt).count() == 0
