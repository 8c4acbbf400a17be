"""SimHash near-duplicates by a binary trie self-join.

Distinct fingerprints are rotated four ways so that each of their 16-bit blocks leads once: two
fingerprints within 3 bits agree in a block, so the self-join may start at trie depth 16 with equal
prefixes. Below, pairs of trie nodes are walked together, bit by bit, adding up differing bits and
dropping a pair once it exceeds the budget. A block value held by too many fingerprints is split by
its next bits into node pairs that are joined in tasks of their own. Tasks emit a spanning forest
of the links they find, never all pairs of a group; components come from repeated
largest/smallest-star rounds on those links.

Defined results: a null text is an empty text with fingerprint zero, linked like any other; rows
that repeat an id are grouped like any others and a null id counts as larger than any; an empty
table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import SPACE, broadcast_if_small, checkpointed, text_batches
from twinfold.operators.shared import components

SHINGLE, BUDGET, BLOCKS, SEEDS = 3, 3, 4, (42,)
#: Fingerprints of one block value that a task may join at once; larger groups are split.
GROUP = 200_000
#: A fingerprint of this share of documents or more is joined by broadcast.
FREQUENT = 0.001
#: Node pairs walked at once.
WALK = 1 << 18
#: Shingles hashed at once.
HASHED = 50_000


def fingerprints_of(text: str, shingle: int = SHINGLE, seeds: tuple = SEEDS) -> list[int]:
    """For each seed 64 bits: each set in more than half of the shingles' XXH64 with that seed."""
    import re

    import xxhash

    words = re.findall(f"[^{SPACE}]+", (text or "").translate(LOWER))
    if not words:
        return [0] * len(seeds)
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros((len(seeds), 64), dtype=np.int64)
    digest = xxhash.xxh64_digest
    for low in range(0, n, HASHED):
        shingles = map(" ".join, zip(*(words[low + k : low + HASHED + k] for k in range(shingle)), strict=False)) if len(words) >= shingle else [" ".join(words)]
        shingles = list(shingles)
        for k, seed in enumerate(seeds):
            raw = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
            ones[k] += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(bits.tobytes(), "big") for bits in np.packbits(2 * ones > n, axis=1)]


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seeds: tuple = SEEDS) -> DataFrame:
    """(id, f0 long, f1 long, ...), one row per document, a column for each seed."""
    names = [f"f{k}" for k in range(len(seeds))]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = np.array([fingerprints_of(t.as_py(), shingle, seeds) for t in batch.column(1)], dtype=np.uint64).view(np.int64).reshape(-1, len(seeds))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in made.T]], ["id", *names])

    return text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))


def walk(groups: np.ndarray, left: np.ndarray, keys: np.ndarray, budget: int, depth: int):
    """Pairs (i, j) of positions with keys within ``budget`` bits, in the same group.

    ``groups`` and ``keys`` are sorted together; ``left`` tells the side of a key in a split group:
    0 and 1 are joined with each other only, 2 with its own kind. Yields arrays of pairs.
    """
    order = np.lexsort((keys, left, groups))
    groups, left, keys = groups[order], left[order], keys[order]
    new = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]) | (left[1:] != left[:-1])])
    end = np.r_[new[1:], len(keys)]
    own = left[new] == 2
    cross = np.flatnonzero((left[new][:-1] == 0) & (left[new][1:] == 1) & (groups[new][:-1] == groups[new][1:]))
    a = np.r_[new[own], new[cross]], np.r_[end[own], end[cross]]
    b = np.r_[new[own], new[cross + 1]], np.r_[end[own], end[cross + 1]]
    stack = [(depth, *a, *b, np.zeros(len(a[0]), dtype=np.int8))]
    while stack:
        depth, a0, a1, b0, b1, off = stack.pop()
        # node pairs of few keys are compared key by key
        small = (a1 - a0) * (b1 - b0) <= 16
        for i, j in compared(a0[small], a1[small], b0[small], b1[small], keys, budget):
            yield order[i], order[j]
        big = ~small
        if depth == 64 or not big.any():
            if depth == 64 and big.any():
                for i, j in compared(a0[big], a1[big], b0[big], b1[big], keys, budget):
                    yield order[i], order[j]
            continue
        a0, a1, b0, b1, off = a0[big], a1[big], b0[big], b1[big], off[big]
        am, bm = split(keys, a0, a1, depth), split(keys, b0, b1, depth)
        same = (a0 == b0) & (a1 == b1)
        kids = [(a0, am, b0, bm, off), (am, a1, bm, b1, off), (a0, am, bm, b1, off + 1)]
        other = ~same
        kids.append((am[other], a1[other], b0[other], bm[other], off[other] + 1))
        p0, p1, q0, q1, o = (np.concatenate(x) for x in zip(*kids, strict=True))
        alive = (p1 > p0) & (q1 > q0) & (o <= budget)
        p0, p1, q0, q1, o = p0[alive], p1[alive], q0[alive], q1[alive], o[alive]
        for k in range(0, len(p0), WALK):
            stack.append((depth + 1, p0[k : k + WALK], p1[k : k + WALK], q0[k : k + WALK], q1[k : k + WALK], o[k : k + WALK]))


def split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """For each node [lo, hi) at ``depth``, where its keys with a set bit begin."""
    bit = np.uint64(63 - depth)
    want = ((keys[lo] >> bit) | np.uint64(1)) << bit
    while (going := lo < hi).any():
        mid = (lo + hi) >> 1
        less = going & (keys[np.minimum(mid, len(keys) - 1)] < want)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(going & ~less, mid, hi)
    return lo


def compared(a0, a1, b0, b1, keys, budget):
    """Pairs within the budget among all of each node pair, in slices."""
    width = b1 - b0
    size = (a1 - a0) * width
    for part in slices(size, WALK * 4):
        s = size[part]
        at = np.repeat(np.arange(len(s)), s)
        k = np.arange(len(at)) - np.repeat(np.cumsum(s) - s, s)
        w = width[part][at]
        i, j = a0[part][at] + k // w, b0[part][at] + k % w
        near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
        near &= (i < j) | ((a0[part] != b0[part])[at])
        yield i[near], j[near]


def slices(size: np.ndarray, most: int):
    if len(size):
        cut = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + most, most), side="right")
        edges = np.unique(np.r_[0, cut, len(size)])
        yield from (slice(x, y) for x, y in itertools.pairwise(edges))


class Forest:
    """Union-find that keeps only the links that join two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def links(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        for _ in range(64):  # most pairs of a dense group have one root by now
            i, j = self.up[i], self.up[j]
            if (self.up[i] == i).all() and (self.up[j] == j).all():
                break
        apart = i != j
        up, out = self.up, []
        for x, y in np.unique(np.stack([i[apart], j[apart]], axis=1), axis=0).tolist():
            a, b = x, y
            while up[a] != a:
                up[a] = up[up[a]]
                a = up[a]
            while up[b] != b:
                up[b] = up[up[b]]
                b = up[b]
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((x, y))
        return out


def spanning_links(groups, sides, keys, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Positions (i, j) of linked keys, enough of them to connect all that are linked."""
    forest = Forest(len(keys))
    return [pair for i, j in walk(groups, sides, keys, budget, 64 // BLOCKS) for pair in forest.links(i, j)]


def rotated(column, bits: int):
    return column if not bits else F.shiftleft(column, bits).bitwiseOR(F.shiftrightunsigned(column, 64 - bits))


def links(prints: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """(a, b) fingerprints within ``budget`` bits of each other, spanning every linked set.

    ``prints`` has distinct values in the column fingerprint. ``budget`` is below the number of blocks.
    """
    spark = prints.sparkSession
    width = 64 // BLOCKS
    blocks = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), rotated(F.col("fingerprint"), b * width).alias("key")) for b in range(BLOCKS)]))
    rows = prints.select("fingerprint", blocks.alias("b")).select("fingerprint", "b.key", (F.col("b.block") * (1 << width) + F.shiftrightunsigned("b.key", 64 - width)).cast("long").alias("group"))
    # at most BLOCKS * 2^16 groups, however many fingerprints
    bits = F.least(F.lit(16), F.ceil(F.log2(F.col("count") / group))).cast("int")
    hot = rows.groupBy("group").count().where(F.col("count") > group).select("group", bits.alias("bits"))
    rows = rows.join(F.broadcast(hot), "group", "left")
    masks = [(e, m) for e in range(1, 17) for k in range(budget + 1) for m in (sum(1 << x for x in c) for c in itertools.combinations(range(e), k))]
    masks = spark.createDataFrame(masks, "bits int, mask long")
    own = F.expr(f"shiftrightunsigned(shiftleft(key, {width}), 64 - bits)")
    dealt = rows.where("bits is not null").join(F.broadcast(masks), "bits").withColumn("p", own).withColumn("q", F.col("p").bitwiseXOR(F.col("mask")))
    dealt = dealt.select("group", (F.least("p", "q") * 65536 + F.greatest("p", "q")).alias("pair"), F.when(F.col("p") == F.col("q"), 2).when(F.col("p") < F.col("q"), 0).otherwise(1).alias("side"), "key", "fingerprint")
    plain = rows.where("bits is null").select("group", F.lit(0).cast("long").alias("pair"), F.lit(2).alias("side"), "key", "fingerprint")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = plain.unionByName(dealt).repartition(n, "group", "pair").sortWithinPartitions("group", "pair")

    def run(batches):
        import pyarrow as pa

        held = None

        def made(table):
            group, pair, side, key, print_ = (table.column(k).to_numpy() for k in range(5))
            number = np.cumsum(np.r_[0, (group[1:] != group[:-1]) | (pair[1:] != pair[:-1])])
            found = np.array(spanning_links(number, side, key.view(np.uint64), budget), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(print_[found[:, 0]]), pa.array(print_[found[:, 1]])], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) < WALK // 4:
                continue
            g, p = held.column(0).to_numpy(), held.column(1).to_numpy()
            last = int(np.argmax((g == g[-1]) & (p == p[-1])))  # the last group may go on
            if last:
                yield made(held.slice(0, last).combine_chunks())
                held = held.slice(last)
        if held is not None and len(held):
            yield made(held.combine_chunks())

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, seeds: tuple = SEEDS, group: int = GROUP) -> DataFrame:
    """(id, fingerprint, component_id): component_id is the smallest id reachable by links.

    With several seeds documents link when any of their fingerprints do; ``fingerprint`` is the
    first seed's. More seeds find more of the near copies that differ in about ``budget`` bits.
    """
    names = [f"f{k}" for k in range(len(seeds))]
    prints = fingerprints(docs, id_col, text_col, shingle, seeds)
    # documents with the same fingerprints are one node
    prints = checkpointed(prints.withColumn("node", F.col("f0") if len(seeds) == 1 else F.xxhash64(*names)))
    nodes = checkpointed(prints.groupBy("node", *names).agg(F.min("id").alias("least"), F.count("*").alias("n")))
    if len(seeds) == 1:
        edges = links(nodes.select(F.col("f0").alias("fingerprint")), budget, group)
    else:
        edges = None
        for f in names:
            owner = checkpointed(nodes.groupBy(F.col(f).alias("fingerprint")).agg(F.min("node").alias("owner")))
            same = nodes.select("node", F.col(f).alias("fingerprint")).join(owner, "fingerprint").select(F.col("node").alias("a"), F.col("owner").alias("b")).where("a <> b")
            near = links(owner.select("fingerprint"), budget, group)
            near = near.join(owner.select(F.col("fingerprint").alias("a"), F.col("owner").alias("x")), "a").join(owner.select(F.col("fingerprint").alias("b"), F.col("owner").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            edges = same.unionByName(near) if edges is None else edges.unionByName(same).unionByName(near)
    found = components(edges)
    linked = nodes.join(found, "node")
    # at most one row per component; a component's members are distinct nodes
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(least, "root").select("node", "component")
    named = checkpointed(nodes.join(linked, "node", "left").select("node", "n", F.coalesce("component", "least").alias("component_id")))
    # fingerprints of many documents, at most 1 / FREQUENT of them, are joined where the documents are
    often = F.col("n") >= FREQUENT * prints.count()
    hot = F.broadcast(named.where(often).drop("n"))
    rest = prints.join(hot, "node", "left_anti").join(named.where(~often).drop("n"), "node")
    return prints.join(hot, "node").unionByName(rest).select(F.col("id").alias(id_col), F.col("f0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, seeds: tuple = SEEDS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id."""
    found = checkpointed(near_duplicates(docs, id_col, text_col, shingle, budget, seeds))
    lost = found.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("lost_id"))
    lost = broadcast_if_small(lost, lost.count(), 64)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"))
    return rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")), "left_anti").select("row.*")


def op6_simhash(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
