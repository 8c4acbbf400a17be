"""Sentence vectors and similarities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.operators.shared import text_batches

DIM, GRAM, BATCH = 64, 3, 32
#: N-grams that a task remembers.
KNOWN = 1 << 19
#: Rows and columns of a tile of similarities.
TILE = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Of length one; a zero vector stays. The length is bound once, not found again for each element."""
    made = F.array(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("n")))
    return F.transform(made, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x.cast("double"))))[0]


def gram_counts(rows: DataFrame, keys: list[str], text: str = "text", dim: int = DIM, gram: int = GRAM) -> DataFrame:
    """(keys, d, n): how many character n-grams of the lower-cased text fall in each dimension."""
    padded = F.concat(F.lit(" "), F.lower(F.col(text)), F.lit(" "))
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.char_length("_t") - (gram - 1), F.lit(1))))
    grams = rows.select(*keys, padded.alias("_t")).select(*keys, "_t", at.alias("_k")).select(*keys, F.md5(F.substring("_t", F.col("_k"), F.lit(gram)).cast("binary")).alias("_h"))
    return grams.select(*keys, (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % dim).cast("int").alias("d")).groupBy(*keys, "d").agg(F.count("*").alias("n"))


def embed_hashed(rows: DataFrame, keys: list[str], text: str = "text", dim: int = DIM, gram: int = GRAM) -> DataFrame:
    """(keys, embedding): hashed character n-gram counts, of length one. No model needed."""
    counts = gram_counts(rows, keys, text, dim, gram)
    found = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (F.coalesce(F.element_at("m", d), F.lit(0)) / F.col("length")).cast("float"))
    return found.select(*keys, vector.alias("embedding"))


class Dimensions(dict):
    """The dimension of each n-gram, as in ``gram_counts``; those seen last are remembered."""

    def __init__(self, dim: int = DIM, gram: int = GRAM):
        self.dim, self.gram = dim, gram

    def __missing__(self, gram: str) -> int:
        import hashlib

        if len(self) >= KNOWN:
            self.clear()
        found = self[gram] = int.from_bytes(hashlib.md5(gram.encode()).digest()[:4], "big") % self.dim
        return found

    def matrix(self, texts: list[str]):
        """A row for each lower-cased text: the vectors of ``embed_hashed``."""
        import numpy as np

        out, width = np.zeros((len(texts), self.dim), dtype=np.float32), self.gram
        for k, text in enumerate(texts):
            t = f" {text} "
            found = [self[t[i : i + width]] for i in range(max(len(t) - width + 1, 1))]
            n = np.bincount(found, minlength=self.dim).astype(np.float64)
            out[k] = n / np.sqrt(n @ n)
        return out


def embed_with(rows: DataFrame, load: Callable, keys: list[str], text: str = "text", batch: int = BATCH) -> DataFrame:
    """(keys, embedding) by a model: ``load()`` is called once per task and gives a function from a list of texts to a matrix.

    Rows of the matrix are brought to length one.
    """

    def run(frames):
        import numpy as np

        model = load()
        for f in frames:
            out = []
            for low in range(0, len(f), batch):
                m = np.asarray(model(f[text].iloc[low : low + batch].tolist()), dtype="float32")
                out.extend(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))
            made = f[keys].copy()
            made["embedding"] = [x.tolist() for x in out]
            yield made

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*keys, text).mapInPandas(run, ", ".join(f"{k} {fields[k]}" for k in keys) + ", embedding array<float>")


def mean_pool(tokens: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """(keys, embedding): the mean of each dimension over the vectors of a key, brought to length one."""
    by_dim = tokens.select(*keys, F.posexplode(vector).alias("d", "x")).groupBy(*keys, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pooled = by_dim.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    return pooled.select(*keys, normalised(F.col("v")).alias("embedding"))


def similarities(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """(pair_id, i, j, sim): all pairs of two sequences (pair_id, global_idx, embedding), by pair."""
    s = src.select("pair_id", F.col("global_idx").alias("i"), F.col("embedding").alias("a"))
    t = tgt.select("pair_id", F.col("global_idx").alias("j"), F.col("embedding").alias("b"))
    return s.join(t, "pair_id").select("pair_id", "i", "j", dot(F.col("a"), F.col("b")).alias("sim"))


def band(sizes: DataFrame, fraction: float = 0.15, least: int = 50) -> DataFrame:
    """(pair_id, i, lo, hi) for i in 0..m, from (pair_id, m, n)."""
    width = F.greatest(F.lit(least), F.ceil(F.lit(fraction) * F.greatest("m", "n")), F.ceil(F.col("n") / F.greatest("m", F.lit(1)))).cast("long")
    rows = sizes.select("pair_id", "m", "n", width.alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long"))).alias("i"))
    centre = F.floor(F.col("i") * F.col("n") / F.greatest("m", F.lit(1)) + 0.5)
    return rows.select("pair_id", "i", F.greatest(F.lit(0), centre - F.col("w")).cast("long").alias("lo"), F.least(F.col("n"), centre + F.col("w")).cast("long").alias("hi"))


def band_candidates(src: DataFrame, tgt: DataFrame, fraction: float = 0.15, least: int = 50, tile: int = TILE) -> DataFrame:
    """(pair_id, i, j, sim) for pairs within the band, in tiles of ``tile`` rows and columns that overlap it.

    A block of vectors is sent once for each tile and a tile is one matrix product, so no vector is
    sent per cell. ``sim`` is null where a vector is null, holds nulls or NaN, or is of another length.
    """
    sizes = src.groupBy("pair_id").agg(F.count("*").alias("m")).join(tgt.groupBy("pair_id").agg(F.count("*").alias("n")), "pair_id")
    limits = band(sizes, fraction, least).where("i > 0 and hi > 0").select("pair_id", (F.col("i") - 1).alias("i"), (F.greatest("lo", F.lit(1)) - 1).alias("lo"), (F.col("hi") - 1).alias("hi"))
    rows = src.select("pair_id", F.col("global_idx").cast("long").alias("i"), F.col("embedding").alias("a")).join(limits, ["pair_id", "i"])
    block = lambda c: F.floor(F.col(c) / tile)
    left = rows.groupBy("pair_id", block("i").alias("_row")).agg(F.collect_list(F.struct("i", "lo", "hi", "a")).alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    tiles = left.select("pair_id", "rows", F.explode(F.sequence(block("lo"), block("hi"))).alias("_col"))
    cols = tgt.select("pair_id", F.col("global_idx").cast("long").alias("j"), F.col("embedding").alias("b"))
    right = cols.groupBy("pair_id", block("j").alias("_col")).agg(F.collect_list(F.struct("j", "b")).alias("cols"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def matrix(vectors: list, dim: int) -> np.ndarray:
            out = np.zeros((len(vectors), dim))
            for k, v in enumerate(vectors):
                out[k, : len(v or [])] = np.array(v or [], dtype=float)
            return out

        def lengths(vectors: list) -> np.ndarray:
            return np.array([np.nan if v is None else len(v) for v in vectors])

        for batch in batches:
            key = batch.column(0)
            for k in range(len(batch)):
                rows, cols = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                a, b = [r["a"] for r in rows], [c["b"] for c in cols]
                dim = max(len(v or []) for v in (*a, *b))
                sims = matrix(a, dim) @ matrix(b, dim).T
                sims[lengths(a)[:, None] != lengths(b)] = np.nan
                i, lo, hi = (np.array([r[n] for r in rows]) for n in ("i", "lo", "hi"))
                j = np.array([c["j"] for c in cols])
                at, to = np.nonzero((j >= lo[:, None]) & (j <= hi[:, None]))
                sim = sims[at, to]
                found = [key.take(pa.array(np.full(len(at), k))), pa.array(i[at]), pa.array(j[to]), pa.array(sim, mask=np.isnan(sim))]
                yield pa.RecordBatch.from_arrays(found, ["pair_id", "i", "j", "sim"])

    made = tiles.join(right, ["pair_id", "_col"]).select("pair_id", "rows", "cols")
    return text_batches(made).mapInArrow(run, f"pair_id {src.schema['pair_id'].dataType.simpleString()}, i long, j long, sim double")
