"""Banded global alignment of two sentence sequences, for every pair of books at once.

Each pair of books is one group of a cogrouped job; within it a row of the score table is one
matrix product and one running maximum. Only the moves are kept, a byte per cell of the band; of long
texts those of a block of rows at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.operators import vectors

BAND, GAP, EPS = 0.15, 0.0, 1e-5
MATCH, SRC_ONLY, TGT_ONLY = 0, 1, 2
TYPES = ("1:1", "1:0", "0:1")
#: Cells of the score table whose moves are in memory at once, a byte each.
CELLS = 1 << 26
SCHEMA = "pair_id string, pair_seq int, src_global_idx int, tgt_global_idx int, alignment_type string, confidence double"


def limits(m: int, n: int, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    width = max(50, int(np.ceil(fraction * max(m, n))), -(-n // max(m, 1)))
    centre = np.floor(np.arange(m + 1) * (n / max(m, 1)) + 0.5).astype(int)
    return np.maximum(0, centre - width), np.minimum(n, centre + width)


def part_of(row: np.ndarray, at: int, a: int, b: int) -> np.ndarray:
    """Columns a..b of a row that begins at column ``at``; minus infinity where it has none."""
    out = np.full(b - a + 1, -np.inf)
    low, high = max(a, at), min(b, at + len(row) - 1)
    if low <= high:
        out[low - a : high - a + 1] = row[low - at : high - at + 1]
    return out


def fill(row_sim, m: int, n: int, fraction: float = BAND, gap: float = GAP, free_edges: bool = False, keep: bool = True):
    """(score, moves, lo): ``row_sim(i, a, b)`` gives similarities of source i with targets a..b-1.

    Rows are as wide as the band; without ``keep`` no moves are stored.
    """
    lo, hi = limits(m, n, fraction)
    edge = 0.0 if free_edges else gap
    prev = np.arange(hi[0] + 1) * edge
    moves = np.full((m + 1, int((hi - lo).max()) + 1), TGT_ONLY, dtype=np.int8) if keep else None
    for i in range(1, m + 1):
        prev, kind = next_row(row_sim, prev, i, lo, hi, gap, edge, keep)
        if keep:
            moves[i, : len(kind)] = kind
    return float(prev[n - lo[m]]), moves, lo


def next_row(row_sim, prev: np.ndarray, i: int, lo: np.ndarray, hi: np.ndarray, gap: float, edge: float, keep: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Row i of the table from the row before it, and its moves."""
    a, b = int(lo[i]), int(hi[i])
    up = part_of(prev, int(lo[i - 1]), a, b) + gap
    if a == 0:
        up[0] = i * edge
    diag = part_of(prev, int(lo[i - 1]), a - 1, b - 1)
    first = max(a, 1)
    if b >= first:
        diag[first - a :] += row_sim(i - 1, first - 1, b)
    step = np.arange(a, b + 1) * gap
    row = np.maximum.accumulate(np.maximum(diag, up) - step) + step
    if not keep:
        return row, None
    kind = np.where(diag >= row - EPS, MATCH, np.where(up >= row - EPS, SRC_ONLY, TGT_ONLY))
    if a == 0:
        kind[0] = SRC_ONLY
    return row, kind


def path(moves: np.ndarray, lo: np.ndarray, m: int, n: int, top: int = 0) -> list[tuple[int, int, int]]:
    """(move, source, target) in reading order; -1 for a missing side. ``moves`` begins at row ``top``, where the path ends if it is not the first."""
    out, i, j = [], m, n
    while i > top or (j and not top):
        kind = TGT_ONLY if i == 0 else SRC_ONLY if j == 0 else moves[i - top, j - lo[i]]
        if kind == MATCH:
            i, j = i - 1, j - 1
            out.append((MATCH, i, j))
        elif kind == SRC_ONLY:
            i -= 1
            out.append((SRC_ONLY, i, -1))
        else:
            j -= 1
            out.append((TGT_ONLY, -1, j))
    return out[::-1]


def steps(row_sim, m: int, n: int, fraction: float = BAND, gap: float = GAP, cells: int = CELLS) -> list[tuple[int, int, int]]:
    """``path`` of ``fill``, with the moves of a block of rows in memory at a time, so that books of any length are aligned.

    The first way down keeps the row before each block; the way back fills the blocks again from these.
    A table of up to ``cells`` cells is one block and filled once.
    """
    lo, hi = limits(m, n, fraction)
    width = int((hi - lo).max()) + 1
    # a kept row of scores is as large as eight rows of moves
    block = max(cells // width, math.isqrt(8 * m), 1)
    row, kept = np.arange(hi[0] + 1) * gap, []
    for i in range(max(m - 1, 0) // block * block + 1):
        if i:
            row, _ = next_row(row_sim, row, i, lo, hi, gap, gap, keep=False)
        if i % block == 0:
            kept.append(row)
    parts, end = [], n
    for top in range(len(kept) - 1, -1, -1):
        row, low, bottom = kept.pop(), top * block, min((top + 1) * block, m)
        moves = np.full((bottom - low + 1, width), TGT_ONLY, dtype=np.int8)
        for i in range(low + 1, bottom + 1):
            row, kind = next_row(row_sim, row, i, lo, hi, gap, gap)
            moves[i - low, : len(kind)] = kind
        parts.append(path(moves, lo, bottom, end, low))
        end -= sum(kind != SRC_ONLY for kind, _, _ in parts[-1])
    return [move for part in reversed(parts) for move in part]


def by_pair(side: DataFrame):
    """Grouped by pair_id, under names of its own: both sides may come from one table."""
    return side.select(F.col("pair_id").cast("string").alias("pair_id"), *[F.col(c).alias(c) for c in ("global_idx", "embedding")]).groupBy("pair_id")


def align(src: DataFrame, tgt: DataFrame, fraction: float = BAND, gap: float = GAP, free_edges: bool = False) -> DataFrame:
    """Moves of each pair, from (pair_id, global_idx, embedding) of both sides. A pair with an empty side has no rows."""

    def run(s, t):
        import pandas as pd

        if not len(s) or not len(t):
            return pd.DataFrame({k: pd.Series(dtype=v) for k, v in (("pair_id", str), ("pair_seq", "int32"), ("src_global_idx", "Int32"), ("tgt_global_idx", "Int32"), ("alignment_type", str), ("confidence", float))})
        s, t = s.sort_values("global_idx"), t.sort_values("global_idx")
        a, b = (np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in (s, t))
        _, moves, lo = fill(lambda i, x, y: b[x:y] @ a[i], len(a), len(b), fraction, gap, free_edges)
        found = path(moves, lo, len(a), len(b))
        si, ti = s["global_idx"].to_numpy(), t["global_idx"].to_numpy()
        return pd.DataFrame({
            "pair_id": s["pair_id"].iloc[0],
            "pair_seq": np.arange(len(found), dtype="int32"),
            "src_global_idx": pd.array([si[i] if i >= 0 else None for _, i, _ in found], dtype="Int32"),
            "tgt_global_idx": pd.array([ti[j] if j >= 0 else None for _, _, j in found], dtype="Int32"),
            "alignment_type": [TYPES[k] for k, _, _ in found],
            "confidence": [float(a[i] @ b[j]) if k == MATCH else None for k, i, j in found],
        })

    return by_pair(src).cogroup(by_pair(tgt)).applyInPandas(run, SCHEMA)


def text_moves(src: Column, tgt: Column, fraction: float = BAND, gap: float = GAP) -> Column:
    """Moves (src, tgt, kind, confidence) of two arrays of sentences with a ``text``, by their hashed vectors; kind is a place in ``TYPES``."""
    known = vectors.Dimensions()

    @F.arrow_udf("array<struct<src int, tgt int, kind int, confidence double>>")
    def moves(s: pa.Array, t: pa.Array) -> pa.Array:
        ends, parts = [0], []
        for x, y in zip(s, t, strict=True):
            a, b = (known.matrix(v.as_py()).astype(np.float64) for v in (x, y))
            found = steps(lambda i, low, high: b[low:high] @ a[i], len(a), len(b), fraction, gap)  # noqa: B023
            ends.append(ends[-1] + len(found))
            parts += [(i, j, k, float(a[i] @ b[j]) if k == MATCH else None) for k, i, j in found]
        kind, i, j = (np.array([p[c] for p in parts], dtype=np.int32) for c in (2, 0, 1))
        fields = [pa.array(i, mask=i < 0), pa.array(j, mask=j < 0), pa.array(kind), pa.array([p[3] for p in parts], pa.float64())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["src", "tgt", "kind", "confidence"]))

    lowered = lambda c: F.transform(c, lambda x: F.lower(x["text"]))
    return moves(lowered(src), lowered(tgt))


def scores(src: DataFrame, tgt: DataFrame, gap: float = GAP, fraction: float = 1.0, free_edges: bool = True) -> DataFrame:
    """(pair_id, m, n, score): the best total of each pair, without its moves."""

    def run(s, t):
        import pandas as pd

        if not len(s) or not len(t):
            return pd.DataFrame({"pair_id": [], "m": [], "n": [], "score": []})
        s, t = s.sort_values("global_idx"), t.sort_values("global_idx")
        a, b = (np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in (s, t))
        score, _, _ = fill(lambda i, x, y: b[x:y] @ a[i], len(a), len(b), fraction, gap, free_edges, keep=False)
        return pd.DataFrame({"pair_id": [s["pair_id"].iloc[0]], "m": [len(a)], "n": [len(b)], "score": [score]})

    return by_pair(src).cogroup(by_pair(tgt)).applyInPandas(run, "pair_id string, m long, n long, score double")


def with_texts(moves: DataFrame, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Pair rows: moves with both sides' texts and indexes; a missing side has text '' and null indexes."""
    side = lambda x, p: x.select(F.col("pair_id").cast("string").alias("pair_id"), F.col("global_idx").alias(f"{p}_global_idx"), F.col("text").alias(f"{p}_text"), F.col("sent_idx").alias(f"{p}_sent_idx"), F.col("para_idx").alias(f"{p}_para_idx"))
    joined = moves.join(side(src, "src"), ["pair_id", "src_global_idx"], "left").join(side(tgt, "tgt"), ["pair_id", "tgt_global_idx"], "left")
    text = [F.coalesce(f"{p}_text", F.lit("")).alias(f"{p}_text") for p in ("src", "tgt")]
    return joined.select("pair_id", "pair_seq", *text, *[f"{p}_{k}_idx" for p in ("src", "tgt") for k in ("sent", "para", "global")], "alignment_type", "confidence")


def summary(pairs: DataFrame) -> DataFrame:
    """(pair_id, matched, src_gaps, tgt_gaps, n_src, n_tgt, match_pct, has_confidence)."""
    kind = lambda k: F.count_if(F.col("alignment_type") == k)
    pct = F.floor(100.0 * kind("1:1") / F.count("*") + 0.5).cast("long")
    return pairs.groupBy("pair_id").agg(
        kind("1:1").alias("matched"), kind("1:0").alias("src_gaps"), kind("0:1").alias("tgt_gaps"),
        (kind("1:1") + kind("1:0")).alias("n_src"), (kind("1:1") + kind("0:1")).alias("n_tgt"),
        pct.alias("match_pct"), F.bool_or((F.col("alignment_type") == "1:1") & F.col("confidence").isNotNull()).alias("has_confidence"),
    )


def swapped(pairs: DataFrame) -> DataFrame:
    """The same pairs seen from the other side."""
    other = {"src": "tgt", "tgt": "src"}
    cols = [F.col(f"{other[c[:3]]}{c[3:]}").alias(c) if c[:4] in ("src_", "tgt_") else F.when(F.col(c) == "1:0", "0:1").when(F.col(c) == "0:1", "1:0").otherwise(F.col(c)).alias(c) if c == "alignment_type" else F.col(c) for c in pairs.columns]
    return pairs.select(*cols)
