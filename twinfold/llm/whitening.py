"""Embedding whitening by spectral divide-and-conquer.

Entries become integers, so sums over any number of vectors are exact. Spark adds up the vectors,
then the products of the centred ones; a d x d covariance reaches the driver, whatever the number of
vectors. There, a polar decomposition of the covariance less a shift (QR-based dynamically weighted
Halley steps) gives the sign of that matrix, so the projector on the eigenvectors above the shift; an
orthonormal basis of its range and of the rest splits the matrix in two blocks, and each block is split
again until blocks are single components. The components go back to the workers, which project.

Only vectors of one length can be whitened together: those of the length that most vectors have (of
two such lengths the larger) are the fit list, others are dropped, as are null vectors, empty ones and
those with a null, infinite or NaN entry.

Defined results: an empty table gives an empty result; rows that repeat are vectors of their own;
equal eigenvalues have any orthonormal basis; a component without variance (to double precision) has
whitened null and an explained of 0; a deviation too large for a long is null; an entry above LARGEST
in size counts as infinite; the result has its own columns only, so others cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries stay below this size, so that their integers and products are exact.
LARGEST = float(1 << 38)
EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its sign. Halley steps, weighted by a lower bound of the singular values."""
    n = len(a)
    size = np.linalg.norm(a, 1)
    x = a / size
    low = max(1 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(n)), EPS) if np.linalg.cond(x, 1) < 1 / EPS else EPS
    for _ in range(40):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d))))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        before, x = x, wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if np.linalg.norm(x - before) <= np.cbrt(4 * EPS) and abs(low - 1) < 1e-6:
            break
    return x


def components(v: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, falling."""
    rng = np.random.default_rng(seed)
    scale = np.linalg.norm(v)

    def split(a: np.ndarray, basis: np.ndarray) -> list[tuple[float, np.ndarray]]:
        n = len(a)
        centre = np.trace(a) / n
        if n == 1 or np.linalg.norm(a - centre * np.eye(n)) <= 2 * EPS * scale:
            return [(a[k, k], basis[:, k]) for k in range(n)]
        if n == 2:
            angle = 0.5 * np.arctan2(2 * a[0, 1], a[0, 0] - a[1, 1])
            turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
            return [(turn[:, k] @ a @ turn[:, k], basis @ turn[:, k]) for k in range(2)]
        # the mean of the eigenvalues has one on each side; the median of the diagonal divides more evenly
        for shift in (np.median(np.diag(a)), centre):
            sign = polar(a - shift * np.eye(n))
            above = int(round((np.trace(sign) + n) / 2))
            if 0 < above < n:
                break
        else:
            return [(a[k, k], basis[:, k]) for k in range(n)]
        projector = (sign + np.eye(n)) / 2
        # twice through the projector, so that the first columns are its range to full precision
        q, _ = np.linalg.qr(projector @ rng.standard_normal((n, n)))
        first, _ = np.linalg.qr(projector @ q[:, :above])
        q, _ = np.linalg.qr(np.hstack([first, (np.eye(n) - projector) @ q[:, above:]]))
        made = []
        for part in (q[:, :above], q[:, above:]):
            inner = part.T @ a @ part
            made += split((inner + inner.T) / 2, basis @ part)
        return made

    found = sorted(split(v, np.eye(len(v))), key=lambda x: -x[0])
    vectors = np.column_stack([x for _, x in found])
    # what rounding left between blocks is turned away, once
    rest = vectors.T @ v @ vectors
    e = np.diag(rest).copy()
    gap = e[None, :] - e[:, None]
    small = np.abs(gap) <= np.sqrt(EPS) * scale
    vectors = vectors @ (np.eye(len(v)) + np.where(small, 0.0, rest / np.where(small, 1.0, gap)))
    vectors, r = np.linalg.qr(vectors)
    vectors = vectors * np.sign(np.diag(r))
    e = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-e, kind="stable")
    return e[order], vectors[:, order]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): integers of the vectors that have finite entries only, of the most usual length."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", finite))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return rows.where(F.size("v") == d).select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def summed(rows: DataFrame, make, whole: bool = False) -> np.ndarray | None:
    """The sum over all batches of ``make(matrix)``, itself a matrix: added up in each task, then cell by cell. ``whole``: exact integers of any size."""

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                got = make(matrix(batch.column(0)))
                got = got.astype(object) if whole else got
                total = got if total is None else total + got
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype("int32")), pa.array(j.ravel().astype("int32")), pa.array([str(x) for x in total.ravel()] if whole else total.ravel())], ["i", "j", "s"])

    cells = rows.select("x").mapInArrow(run, f"i int, j int, s {'string' if whole else 'double'}")
    got = cells.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)") if whole else "s").alias("s")).collect()
    if not got:
        return None
    out = np.zeros((max(r["i"] for r in got) + 1, max(r["j"] for r in got) + 1), dtype=object if whole else float)
    for r in got:
        out[r["i"], r["j"]] = int(r["s"]) if whole else r["s"]
    return out


def matrix(column) -> np.ndarray:
    """Vectors of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


class Whitening:
    """Mean, components and their variances, from the rows (id, x); None if there are none."""

    def __init__(self, rows: DataFrame):
        # the last column counts the vectors
        sums = summed(rows, lambda m: np.append(m.sum(axis=0), len(m))[None, :], whole=True)
        self.n = 0 if sums is None else sums[0, -1]
        if not self.n:
            return
        self.sums = [int(s) for s in sums[0, :-1]]
        mean = self.mean = np.array([float(s // self.n) for s in self.sums]), np.array([(s % self.n) / self.n for s in self.sums])
        v = summed(rows, lambda m: centred(m, mean).T @ centred(m, mean)) / self.n
        self.total = float(np.trace(v))
        values, vectors = components((v + v.T) / 2)
        some = slice(0, COMPONENTS)
        self.values, self.vectors = values[some], vectors[:, some]
        self.real = self.values > len(v) * EPS * max(self.values[0], 0.0)
        self.scale = np.where(self.real, np.sqrt(np.where(self.real, self.values, 1.0)), np.inf)

    def project(self, m: np.ndarray) -> np.ndarray:
        return centred(m, self.mean) @ self.vectors / self.scale


def centred(m: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Integers less the mean, whose whole part goes first, exactly."""
    return (m - mean[0].astype(np.int64)).astype(float) - mean[1]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: (id, component, n, deviation, whitened, explained, identity_error)."""
    rows = usable(vectors, id_col, vector_col)
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = Whitening(rows)
    if not fit.n:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums = fit.n, fit.sums
    centre = summed(rows, lambda m: fit.project(m).sum(axis=0)[None, :])[0] / n
    made = summed(rows, lambda m: (fit.project(m) - centre).T @ (fit.project(m) - centre)) / n
    error = float(np.abs(made - np.eye(len(made)))[np.ix_(fit.real, fit.real)].max(initial=0.0))
    explained = np.where(fit.real, fit.values / fit.total if fit.total else 0.0, 0.0)

    def run(batches):
        import pyarrow as pa

        k = len(fit.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            white = fit.project(x)
            deviations = [d if d < 1 << 63 else None for d in deviation(x, n, sums)]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype="int32"), len(x))), pa.array(np.full(len(x) * k, n)), pa.array(deviations, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(white.ravel(), mask=np.tile(~fit.real, len(x))), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
            ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums of (n x - S) squared over the dimensions, exact whatever their size."""
    largest = max(max(abs(int(x.max())), abs(int(x.min()))) * n, max(map(abs, sums))) * 2
    if largest**2 * x.shape[1] < 1 << 63:
        d = n * x - np.array(sums)
        return (d * d).sum(axis=1).tolist()
    # the part of n x - S that the whole mean leaves is small again
    whole = [s // n for s in sums]
    near, rest = x - np.array(whole), np.array([s % n for s in sums])
    most = (int(np.abs(near).max()) + 1) * n
    if most**2 * x.shape[1] < 1 << 63:
        d = n * near - rest
        return (d * d).sum(axis=1).tolist()
    d = near.astype(object) * n - rest.astype(object)
    return (d * d).sum(axis=1).tolist()


def op13_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
