"""Near copies among whole texts: rare shingles propose pairs, the texts decide.

Texts with one set of word shingles are one node. A set of n shingles is put in one order for all
texts, rare ones first; two sets with a Jaccard similarity of t or more share one of their first
n - ceil(t * n) + 1 shingles, so each of these is a bucket and no near pair is missed. A bucket's
pair is left out when what follows the shared shingle in either set is too short for t: then another
bucket has the pair, or it is not near. How rare a shingle is comes from counts by hash cell over all texts; cells that shingles share only make the
order less sharp. What many texts share, as a passage, comes last and puts none of them together.

A set also has a bitmap of at least as many bits as shingles. Bits that only one of two bitmaps has
bound what the sets share, so most pairs that a shingle proposes by chance are left out without
their texts, and only the texts of the others are sent to a comparison.

In each round every bucket compares some heads (the first node; in later rounds the first of 8, 64,
... parts, or all once what is left has few pairs for its rows) with its others, by the exact similarity.
Heads leave the bucket, and so do nodes that are near to a head before them, until no bucket has two. So work grows with a bucket's size and the
number of its different texts, not with the square of a group of copies.

Texts that share a bucket of the caller are linked: they are near, too, when the similarity with
repeats counted is enough. What a passage repeats many times weighs more there than in a set, so
no rare shingle finds such copies.

Defined results: a null text is an empty text; texts without words are one node; a null id counts as
larger than any.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.operators.shared import broadcast_if_small, checkpointed, components, numbered, text_batches

SHINGLE, LEAST = 5, 0.8
#: Cells in which shingles are counted, and cells that are sent as one row; a task keeps one number for each cell.
CELLS, SLICE = 1 << 22, 1 << 16
#: Bits of the smallest bitmap.
BITS = 64
#: Characters between words, as a regex class body.
SPACE = r"\x20\x09-\x0D"
#: Each round has so many times the heads of the one before.
HEADS = 8
#: Bytes of a text that are hashed at once, but for longer words; comparisons of one text in a task.
CHUNK, SHARE = 1 << 20, 1000


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: For each byte, a factor of the hash of a word, the same for both cases of a letter; and whether it is between words.
FACTOR = odd_numbers(256, 6)
FACTOR[ord("A") : ord("Z") + 1] = FACTOR[ord("a") : ord("z") + 1]
GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BASE, MIX = (int(x) for x in odd_numbers(2, 9))


class Shingles:
    """Sets of shingle hashes, from the bytes of a text.

    A word's hash is a polynomial in an odd base modulo 2^64, so all words of a chunk come from one
    running sum, divided by the power at their start.
    """

    def __init__(self, shingle: int = SHINGLE):
        self.times = odd_numbers(shingle, 5)
        self.powers = self.inverses = np.empty(0, dtype=np.uint64)

    def words(self, data: np.ndarray) -> np.ndarray:
        """A hash of each word, in order."""
        n = len(data)
        if n > len(self.powers):
            self.powers, self.inverses = (np.cumprod(np.full(n, x, dtype=np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64)))
        edge = np.diff(GAP[data].astype(np.int8), prepend=1, append=1)
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(FACTOR[data] * self.powers[:n], out=sums[1:])
        h = (sums[last] - sums[first]) * self.inverses[first] + (last - first).astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(MIX)
        return h ^ (h >> np.uint64(32))

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles; all words are one if there are fewer."""
        return distinct(self.repeated(text))

    def repeated(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the shingles, each as often as it occurs."""
        import re

        data, low, parts = (text or "").encode(), 0, [np.empty(0, dtype=np.uint64)]
        gap = re.compile(f"[{SPACE}]".encode())
        while low < len(data):
            end = gap.search(data, low + CHUNK)
            high = end.start() if end else len(data)
            parts.append(self.words(np.frombuffer(data, dtype=np.uint8)[low:high]))
            low = high
        h = np.concatenate(parts)
        if not len(h):
            return h
        n = min(len(h), len(self.times))
        # a shorter text must not look like a part of a longer one
        mixed = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            mixed = mixed * self.times[k] + h[k : len(h) - n + 1 + k]
            mixed ^= mixed >> np.uint64(29)
        mixed.sort()
        return mixed


def distinct(hashes: np.ndarray) -> np.ndarray:
    return hashes[np.diff(hashes, prepend=~hashes[:1]) != 0]


def are_near(left: np.ndarray, right: np.ndarray, least: float, linked: bool) -> bool:
    """Whether sorted shingles with repeats have a Jaccard similarity of ``least`` or more: as sets or, if linked, counting repeats."""
    x, y = distinct(left), distinct(right)
    both, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if len(both) >= least * (len(x) + len(y) - len(both)) - 1e-9:
        return True
    if not linked:
        return False
    x, y = (np.diff(np.searchsorted(s, d), append=len(s)) for s, d in ((left, x), (right, y)))
    n = int(np.minimum(x[at], y[to]).sum())
    return n >= least * (len(left) + len(right) - n) - 1e-9


def cell_levels(docs: DataFrame, text_col: str, shingle: int = SHINGLE) -> np.ndarray:
    """The level of each cell: how many texts have a shingle of it, over all texts. Tasks add up their own before the shuffle."""

    def run(batches):
        import pyarrow as pa

        cut, total = Shingles(shingle), np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, cut.of(text.as_py()) % np.uint64(CELLS), 1)
        for k, part in enumerate(total.reshape(-1, SLICE)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])

    def add(batches):
        import pyarrow as pa

        sums = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(part.as_py(), dtype=np.uint32).astype(np.int64)
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([levels_of(total).tobytes()], pa.binary())], ["slice", "levels"])

    made = text_batches(docs).select(text_col).mapInArrow(run, "slice int, counts binary")
    levels = np.zeros(CELLS, dtype=np.uint8)
    for row in made.repartition("slice").mapInArrow(add, "slice int, levels binary").collect():  # at most CELLS bytes
        levels[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["levels"], dtype=np.uint8)
    return levels


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 8 bits."""
    return np.minimum(8 * np.log2(counts + 1.0), 255).astype(np.uint8)


def bitmap(hashes: np.ndarray) -> bytes:
    """Bits at the hashes, as many as a power of two that is no less than their number."""
    bits = np.zeros(max(BITS, 1 << max(0, len(hashes) - 1).bit_length()), dtype=bool)
    bits[hashes % np.uint64(len(bits))] = True
    return np.packbits(bits, bitorder="little").tobytes()


def missing(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of bitmaps, at least how many shingles of the left set are not in the right one, and the reverse."""
    out, lengths = np.zeros((2, len(left)), dtype=np.int64), np.array([[len(x), len(y)] for x, y in zip(left, right, strict=True)]).reshape(-1, 2)
    for x, y in np.unique(lengths, axis=0):
        at, n = np.flatnonzero((lengths == [x, y]).all(axis=1)), min(x, y)
        # a bitmap's halves over each other are the bitmap of half as many bits
        a, b = (np.bitwise_or.reduce(np.frombuffer(b"".join([side[k] for k in at]), dtype=np.uint8).reshape(len(at), -1, n), axis=1) for side in (left, right))
        out[0, at], out[1, at] = (np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((a, b), (b, a)))
    return out[0], out[1]


def first_keys(hashes: np.ndarray, levels: np.ndarray, least: float) -> np.ndarray:
    """The keys of a set's rarest shingles, as many as make two near sets share one. A key sorts by level, then by hash."""
    n = len(hashes)
    if not n:
        return np.empty(0, dtype=np.int64)
    keys = (levels[hashes % np.uint64(len(levels))].astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16))
    first = n - int(np.ceil(least * n - 1e-9)) + 1
    return np.unique(np.partition(keys, first - 1)[:first]).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(id, t, set, size, bits, buckets): a hash of the text; a digest, the number and a bitmap of its shingles, the keys of its rarest ones in order."""
    levels = cell_levels(docs, text_col, shingle)

    def run(batches):
        import pyarrow as pa
        import xxhash

        cut = Shingles(shingle)
        for batch in batches:
            sets = [cut.of(t.as_py()) for t in batch.column(2)]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            buckets = pa.array([first_keys(s, levels, least) for s in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            bits = pa.array([bitmap(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, sizes, bits, buckets], ["id", "t", "set", "size", "bits", "buckets"])

    rows_ = text_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    return rows_.mapInArrow(run, f"id {rows_.schema['id'].dataType.simpleString()}, t long, set binary, size long, bits binary, buckets array<long>")


def possible(pairs: DataFrame, sets: DataFrame, bytes_: int, least: float = LEAST) -> DataFrame:
    """The pairs (a, b, linked) of nodes that are linked or whose bitmaps (node, size, bits) allow a Jaccard similarity of ``least`` or more."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
            only = missing(batch.column(3).to_pylist(), batch.column(5).to_pylist())
            both = np.minimum(x - only[0], y - only[1])
            linked = batch.column(6).to_numpy(zero_copy_only=False)
            yield batch.select(["a", "b", "linked"]).filter(pa.array(linked | (both >= least * (x + y - both) - 1e-9), pa.bool_()))

    sides = [broadcast_if_small(sets.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("bits").alias(f"{c}_bits")), 1, bytes_) for c in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_size", "a_bits", "b_size", "b_bits", "linked")
    return text_batches(rows).mapInArrow(run, "a long, b long, linked boolean")


def checked(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The pairs (a, b, linked) of nodes whose texts (node, text) are near."""

    def run(batches):
        import pyarrow as pa

        cut, last, left = Shingles(shingle), None, None
        for batch in batches:
            a, near = batch.column(0).to_pylist(), []
            for k, node in enumerate(a):
                if node != last:
                    last, left = node, cut.repeated(batch.column(2)[k].as_py())
                near.append(are_near(left, cut.repeated(batch.column(3)[k].as_py()), least, batch.column(4)[k].as_py()))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    # a text of many comparisons is sent to several tasks
    parts = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / SHARE).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", "linked", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    left = texts.withColumnRenamed("node", "a").join(parts, "a").select("a", F.col("text").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    rows = dealt.join(right, "b").join(left, ["a", "part"]).select("a", "b", "x", "y", "linked")
    return text_batches(rows.sortWithinPartitions("a")).mapInArrow(run, "a long, b long")


def meeting(keys: DataFrame, least: float = LEAST) -> DataFrame:
    """The keys (node, bucket, pos, size) with another of their bucket that may belong to a near set.

    Near sets are of similar sizes, the more so the later the shared shingle comes. In order of sizes a set has a near
    one after it only if it allows the next size, and one before it only if one before allows its own size.
    """
    at = Window.partitionBy("bucket").orderBy("size", "node")
    # the largest set that shares enough of what begins at this place
    most = (F.col("size") - F.col("pos") + 1e-6) * ((1 + least) / least) - F.col("size") + 1e-6
    before, after = F.max("most").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lead("size").over(at)
    rows = keys.withColumn("most", most).select("*", before.alias("before"), after.alias("after"))
    return rows.where("before >= size or after <= most").drop("most", "before", "after")


class Candidates:
    """Nodes of the documents, the buckets that two of them share, and comparisons of nodes by their texts.

    ``made`` has (id, t, set, row) of each document, ``nodes`` (set, node, none, id, t, row) of each node's
    first document, ``sets`` (node, size, bits) the number and the bitmap of its shingles, ``shared``
    (node, bucket, pos, size, linked): the place of the shared shingle in a set of that size; ``linked``
    is true in the caller's buckets.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, more: DataFrame | None, shingle: int, least: float):
        self.shingle, self.least, self.spark = shingle, least, docs.sparkSession
        made = self.made = checkpointed(signatures(docs, id_col, text_col, shingle, least).withColumn("row", F.monotonically_increasing_id()))
        top = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t", "row")).alias("top")
        nodes = made.groupBy("set").agg(top).select("set", "top.none", "top.id", "top.t", "top.row")
        nodes = self.nodes = checkpointed(numbered(nodes, [F.col("none"), F.col("id"), F.col("t"), F.col("set")], "node"))
        # keys are shuffled once, by bucket, and few of them stay
        first = broadcast_if_small(nodes.select("row", "node"), nodes.count(), 40)
        rows = meeting(made.join(first, "row").select("node", "size", F.posexplode("buckets").alias("pos", "bucket")), least)
        shared = checkpointed(rows.select("node", "bucket", "pos", "size", F.lit(False).alias("linked")))
        if more is not None:
            more = checkpointed(more.select(F.col("id").alias("j"), F.xxhash64(F.lit("more"), "bucket").alias("bucket")))
            full = more.groupBy("bucket").count().where("count > 1").select("bucket")
            more = checkpointed(more.join(full, "bucket", "left_semi"))
            own = made.select(F.col("id").alias("i"), "set", "size").join(broadcast_if_small(more, more.count(), 64), F.col("i").eqNullSafe(F.col("j")))
            own = own.join(nodes.select("set", "node"), "set").select("node", "bucket", F.lit(0).alias("pos"), "size", F.lit(True).alias("linked"))
            shared = shared.unionByName(several(checkpointed(own.distinct())))
        self.shared = shared
        used = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", F.col("row").alias("r"))
        self.sets = checkpointed(made.join(used, F.col("row") == F.col("r")).select("node", "size", "bits"))
        self.bytes_ = self.sets.agg(F.coalesce(F.sum(F.length("bits") + 64), F.lit(0))).first()[0]
        self.docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct, checkpointed pairs that are near."""
        left = checkpointed(possible(pairs, self.sets, self.bytes_, self.least))
        used = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        need = checkpointed(self.nodes.join(used, "node").select("node", F.col("id").alias("i"), F.col("t").alias("u")))
        # the texts of the few pairs that are left are read anew, not kept
        texts = self.docs.join(broadcast_if_small(need, need.count(), 64), F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u"))).select("node", "text")
        return checkpointed(checked(left, texts.dropDuplicates(["node"]), self.shingle, self.least))

    def heads(self, some: DataFrame, parts: int | None) -> DataFrame:
        """(bucket, a, a_pos, a_size): the first node of each part of a bucket; without ``parts`` all nodes."""
        if not parts:
            return some.select("bucket", F.col("node").alias("a"), F.col("pos").alias("a_pos"), F.col("size").alias("a_size"))
        part = F.pmod(F.xxhash64("node", "bucket"), F.lit(parts))
        least = some.groupBy("bucket", part.alias("part")).agg(F.min(F.struct("node", "pos", "size")).alias("h"))
        return checkpointed(least.select("bucket", F.col("h.node").alias("a"), F.col("h.pos").alias("a_pos"), F.col("h.size").alias("a_size")))

    def met(self, first: DataFrame, some: DataFrame) -> DataFrame:
        """(bucket, a, b): pairs of heads and others of a bucket that its shingle does not rule out; linked ones all."""
        others = some.withColumnsRenamed({"node": "b", "pos": "b_pos", "size": "b_size"})
        most = F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos"))
        can = most >= self.least / (1 + self.least) * (F.col("a_size") + F.col("b_size")) - 1e-6
        return first.join(others, "bucket").where((F.col("linked") | can) & (F.col("a") != F.col("b")))

    def edges(self, open_: DataFrame) -> DataFrame:
        """Near pairs (a, b) of nodes that share a bucket of ``open_``: any two near nodes are in one, or one of them is near to a smaller node."""
        heads, edges = 1, self.spark.createDataFrame([], "a long, b long")
        while not open_.isEmpty():
            first = self.heads(open_, heads)
            # a pair of heads is compared once
            twice = first.select("bucket", F.col("a").alias("b"), F.lit(True).alias("also"))
            pairs = self.met(first, open_).join(twice, ["bucket", "b"], "left").where("a < b or also is null")
            asked = checkpointed(distinct_pairs(pairs))
            gone = first.select("bucket", F.col("a").alias("node"))
            if not asked.isEmpty():
                found = self.near(asked)
                edges = edges.unionByName(found)
                gone = gone.unionByName(pairs.where("a < b").join(found, ["a", "b"], "left_semi").select("bucket", F.col("b").alias("node")))
            left = open_.join(gone.distinct(), ["bucket", "node"], "left_anti")
            open_ = several(left.select(*open_.columns))
            heads = heads and more_heads(heads, open_, open_)
        return edges

    def against(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        """(node): the nodes of ``rows`` that are near to one of ``others`` in a bucket.

        In each round some of a bucket's others are compared, more from round to round; what is near to one leaves.
        """
        heads, gone, others = 1, self.spark.createDataFrame([], "node long"), checkpointed(others)
        while not (rows.isEmpty() or others.isEmpty()):
            first = self.heads(others, heads)
            asked = checkpointed(distinct_pairs(self.met(first, rows)))
            if not asked.isEmpty():
                near = checkpointed(self.near(asked).select(F.col("b").alias("node")).distinct())
                gone = gone.unionByName(near)
                rows = checkpointed(rows.join(near, "node", "left_anti"))
            left = others.join(first.withColumnRenamed("a", "node"), ["bucket", "node"], "left_anti").select(*others.columns)
            others = checkpointed(left.join(rows.select("bucket").distinct(), "bucket", "left_semi"))
            heads = heads and more_heads(heads, rows, others)
        return gone


def more_heads(heads: int, some: DataFrame, others: DataFrame) -> int | None:
    """The heads of the next round; None, for all nodes, if the buckets have few pairs for their rows."""
    n, m = (x.groupBy("bucket").agg(F.count("*").cast("double").alias(c)) for x, c in ((some, "n"), (others, "m")))
    pairs, rows = n.join(m, "bucket").agg(F.sum(F.col("n") * F.col("m")), F.sum(F.col("n") + F.col("m"))).first()
    return None if (pairs or 0) <= HEADS * (rows or 0) else heads * HEADS


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, linked): each pair once, linked if it is so in any bucket."""
    return pairs.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def several(some: DataFrame) -> DataFrame:
    """Those rows (node, bucket, pos, size, linked) of buckets with two nodes or more."""
    full = some.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("bucket")
    return checkpointed(some.join(full, "bucket", "left_semi"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None, across: bool = False, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(id, t, group_id, first): group_id is the smallest id that near texts connect with the row's.

    ``t`` is xxhash64 of the text; ``first`` is true for the row that stands for its group. ``more``
    (id, bucket) puts texts into further buckets, where they are also near when they are so counting repeats. Without ``across`` a text that is near to a
    group's member but not to its first is compared with the first only: of any two near texts one
    is not a first. With it such texts are compared too, where groups meet in a bucket.
    """
    some = Candidates(docs, id_col, text_col, more, shingle, least)
    made, nodes, shared = some.made, some.nodes, some.shared
    edges = some.edges(shared)
    member = components(edges)
    if across:
        rows = shared.join(member, "node", "left").withColumn("grouped", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "node"))
        mixed = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("grouped").alias("any")).where("x <> y and any").select("bucket")
        rows = checkpointed(rows.join(mixed, "bucket", "left_semi"))
        first = rows.where("grouped").select("bucket", *[F.col(c).alias(n) for c, n in (("node", "a"), ("pos", "a_pos"), ("size", "a_size"), ("root", "a_root"))])
        # two nodes that are near to none were compared when the later of them was left in the bucket
        pairs = some.met(first, rows).where("a_root <> root and (a < b or not grouped)")
        member = components(edges.unionByName(some.near(checkpointed(distinct_pairs(pairs)))))

    rooted = nodes.join(member, "node", "left").select("set", F.col("node"), F.coalesce("root", "node").alias("root"), F.col("id").alias("i"), F.col("t").alias("u"))
    heads = nodes.select(F.col("node").alias("root"), F.col("id").alias("group_id"))
    named = checkpointed(rooted.join(heads, "root"))
    here = F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")) & (F.col("node") == F.col("root"))
    return made.select("id", "t", "set").join(named, "set").select("id", "t", "group_id", here.alias("first"))


def dropped(some: Candidates) -> DataFrame:
    """(node): the nodes that are near to a node that stays. No two nodes that stay and share a bucket are near.

    A node that is near to no smaller one stays, and what is near to it goes. What is only near to
    nodes that go is open: it is compared with those that stay, and the rest anew with one another,
    until nothing is open. Chains of near texts are short, so few nodes are open after the first pass.
    """
    spark, shared = some.spark, some.shared
    gone, stay, open_ = spark.createDataFrame([], "node long"), None, shared
    while True:
        edges = checkpointed(some.edges(open_).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        nodes = checkpointed(open_.select("node").distinct())
        behind = edges.select(F.col("b").alias("node")).distinct()
        heads = checkpointed(nodes.join(behind, "node", "left_anti"))
        near = checkpointed(edges.join(heads.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct())
        gone, stay = gone.unionByName(near), heads if stay is None else stay.unionByName(heads)
        left = checkpointed(behind.join(near, "node", "left_anti"))
        if left.isEmpty():
            return gone
        # against those that stay and share a bucket
        rows = checkpointed(shared.join(left, "node", "left_semi"))
        met = checkpointed(rows.select("bucket").distinct())
        others = checkpointed(shared.join(broadcast_if_small(met, met.count(), 40), "bucket", "left_semi"))
        near = some.against(rows, others.join(stay, "node", "left_semi"))
        gone = gone.unionByName(near)
        open_ = checkpointed(rows.join(near, "node", "left_anti"))
        if open_.isEmpty():
            return gone


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """``docs`` without the texts that are near to one that stays; of texts with one set of shingles the smallest id stays.

    Texts that share a bucket of ``more`` (id, bucket) are also near when they are so counting repeats.
    """
    some = Candidates(docs, id_col, text_col, more, SHINGLE, LEAST)
    far = some.nodes.join(dropped(some).distinct(), "node", "left_anti").select("set", F.col("id").alias("i"), F.col("t").alias("u"))
    first = F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u"))
    lost = some.made.select("id", "t", "set").join(far, "set", "left")
    lost = checkpointed(lost.where(~F.coalesce(first, F.lit(False))).select(F.col("id").alias("lost_id"), F.col("t").alias("lost_t")).distinct())
    lost = broadcast_if_small(lost, lost.count(), 64)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"))
    return rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("t") == F.col("lost_t")), "left_anti").select("row.*")
