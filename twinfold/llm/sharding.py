"""K-d tree sharding of documents into shards of near equal bytes.

Points of the tree are groups of equal texts, with the metadata size, source, language and smallest
id as dimensions. Every node is split at a weighted quantile along its relatively widest dimension
until a leaf is one shard's target. The quantiles of all nodes of a level come from distributed
histograms whose boundary bucket is narrowed until the split is within TOLERANCE or between two
points; the driver only sees histograms.

A group stays in one shard; only one above a whole shard's share is cut into parts of at most a
share, its rows dealt in turn. Groups above a sixteenth of a share, or a thousandth of the rows, are
too coarse for a quantile: there are at most a few thousand of them whatever the input, so they are
placed first, the largest on the emptiest shard, and the tree's leaf targets are what is then left.

Defined results: a null text counts 8 bytes, with the CRC-32 of no bytes; null source, lang and id
count as lowest; rows that repeat are separate rows of one group; an empty table gives an empty
result. Other columns are not looked at.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.common import checkpointed

SHARDS, EXTRA = 24, 8
#: Buckets of a histogram; the share of a node's bytes that a split may miss its quantile by.
BUCKETS, TOLERANCE = 1024, 0.001
#: Groups above a shard's bytes over this, or this share of all rows, are placed before the tree.
PARTS, FREQUENT = 16, 0.001
#: Rows that one task numbers.
NUMBERED = 100_000
KEY = ("size", "crc", "h")
DIMS = ("d_size", "d_source", "d_lang", "d_id", "d_tie")


def leading_bytes(c: Column) -> Column:
    """The first 7 bytes of a string as a long, in string order."""
    return F.conv(F.substring(F.rpad(F.hex(F.coalesce(c, F.lit("")).cast("binary")), 14, "0"), 1, 14), 16, 10).cast("long")


class Node:
    """Leaves ``name`` to ``name + shards - 1``; the left child takes the share ``left`` of its bytes."""

    def __init__(self, name: int, shards: int, path: Column, left: float = 0.5):
        self.name, self.shards, self.path, self.left = name, shards, path, left


def assigned(points: DataFrame, nodes: list[Node]) -> DataFrame:
    case = None
    for n in nodes:
        case = F.when(n.path, n.name) if case is None else case.when(n.path, n.name)
    return points.withColumn("node", case).where("node is not null")


def split_level(points: DataFrame, nodes: list[Node], spread: dict[str, int]) -> list[tuple[Node, Column]]:
    """(node, condition of its left side) for nodes of more than one shard."""
    ends = [f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("min", F.min), ("max", F.max))]
    stats = {r["node"]: r for r in assigned(points, nodes).groupBy("node").agg(F.sum("weight").alias("weight"), *ends).collect()}
    work = []
    for n in nodes:
        r = stats.get(n.name)
        if r is None:
            continue
        dim = max(DIMS[:-1], key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / spread[d])
        dim = dim if r[f"max_{dim}"] > r[f"min_{dim}"] else "d_tie"
        want = r["weight"] * n.left
        work.append({"node": n, "dim": dim, "low": r[f"min_{dim}"], "high": r[f"max_{dim}"], "left": want, "slack": r["weight"] * TOLERANCE, "inside": n.path})
    done = []
    while work:
        value = bucket = None
        for w in work:
            w["width"] = (w["high"] - w["low"]) // BUCKETS + 1
            b = F.expr(f"cast(({w['dim']} - {w['low']}L) div {w['width']}L as int)")
            inside = w["inside"] & F.col(w["dim"]).between(w["low"], w["high"])
            value = F.when(inside, F.col(w["dim"])) if value is None else value.when(inside, F.col(w["dim"]))
            bucket = F.when(inside, b) if bucket is None else bucket.when(inside, b)
        found = assigned(points, [Node(w["node"].name, 1, w["inside"] & F.col(w["dim"]).between(w["low"], w["high"])) for w in work])
        found = found.select("node", "weight", value.alias("v"), bucket.alias("b")).groupBy("node", "b").agg(F.sum("weight").alias("weight"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        going = []
        for w in work:
            rows = sorted((r["b"], r["weight"], r["low"], r["high"]) for r in found if r["node"] == w["node"].name)
            before, col = 0, F.col(w["dim"])
            for _, weight, low, high in rows:
                if before + weight >= w["left"]:
                    break
                before += weight
            short, over = w["left"] - before, before + weight - w["left"]
            if min(short, over) <= w["slack"] or low == high and w["dim"] == "d_tie":
                done.append((w["node"], w["inside"] & (col <= high) | w.get("taken", F.lit(False)) if over < short else w["inside"] & (col < low) | w.get("taken", F.lit(False))))
            elif low == high:  # many points share this value: go on by the tie-breaker among them
                taken = w.get("taken", F.lit(False)) | (w["inside"] & (col < low))
                going.append(w | {"dim": "d_tie", "low": 0, "high": (1 << 60) - 1, "left": short, "inside": w["inside"] & (col == low), "taken": taken})
            else:
                going.append(w | {"low": low, "high": high, "left": short, "taken": w.get("taken", F.lit(False)) | (w["inside"] & (col < low)), "inside": w["inside"] & col.between(low, high)})
        work = going
    return done


def placed_first(groups: list[tuple[tuple, int, int]], shards: int, share: float) -> tuple[list[tuple], list[int]]:
    """((size, crc, h, shards of its parts) of each group (key, bytes, rows), bytes placed on each shard): the largest part on the emptiest shard."""
    parts = [(-(-weight // n), key, k) for key, weight, rows in groups for n in [min(rows, max(1, -(-weight // max(1, int(share)))))] for k in range(n)]
    load = [(0, s) for s in range(shards)]
    home: dict[tuple, list[int]] = {}
    for weight, key, _ in sorted(parts, reverse=True):
        held, s = heapq.heappop(load)
        home.setdefault(key, []).append(s)
        heapq.heappush(load, (held + weight, s))
    return [(*key, of) for key, of in home.items()], [held for held, _ in sorted(load, key=lambda x: x[1])]


def leaf_targets(load: list[int], rest: int) -> list[float]:
    """How ``rest`` bytes are best added to the loads: up to one level, none where the load is above it."""
    ordered = sorted(load)
    # the emptiest k are filled up to a level below the next one's load
    level = next((rest + sum(ordered[:k])) / k for k in range(1, len(ordered) + 1) if k == len(ordered) or rest + sum(ordered[:k]) <= ordered[k] * k)
    return [max(0.0, level - x) for x in load]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(id, size, text_crc32, shard, slot), one row per document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + EXTRA).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h"), leading_bytes(F.col(source_col)).alias("d_source"), leading_bytes(F.col(lang_col)).alias("d_lang"))
    base = checkpointed(base.withColumn("row", F.monotonically_increasing_id()))
    points = base.groupBy(*KEY).agg(F.sum("size").alias("weight"), F.count("*").alias("n"), F.min("d_source").alias("d_source"), F.min("d_lang").alias("d_lang"), F.coalesce(F.min("id"), F.lit(0)).cast("long").alias("d_id"))
    points = checkpointed(points.withColumn("d_size", F.col("size")).withColumn("d_tie", F.xxhash64(*KEY).bitwiseAND((1 << 60) - 1)))
    n, total = points.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share = total / shards
    large = (F.col("weight") > share / PARTS) | ((F.col("n") > n * FREQUENT) & (F.col("n") > 1))
    # at most shards * PARTS + 1 / FREQUENT groups
    groups = [(tuple(r[k] for k in KEY), r["weight"], r["n"]) for r in points.where(large).select(*KEY, "weight", "n").collect()]
    homes, load = placed_first(groups, shards, share)
    rest = total - sum(weight for _, weight, _ in groups)
    first = spark.createDataFrame(homes, "size long, crc long, h long, shards array<int>")
    split = base.join(F.broadcast(first), list(KEY), "left")
    # rows of a group are dealt in turn within each partition of the table, beginning anywhere
    where = F.shiftright("row", 33)
    turn = F.row_number().over(Window.partitionBy(*KEY, where).orderBy("row")) + F.pmod(F.xxhash64(where), F.lit(1 << 20))
    part = F.pmod(turn, F.size("shards")).cast("int")
    rows = split.where("size(shards) = 1").select("id", *KEY, "row", F.get("shards", F.lit(0)).alias("shard"))
    rows = rows.unionByName(split.where("size(shards) > 1").select("id", *KEY, "row", F.get("shards", part).alias("shard")))
    placed = kd_shards(points.where(~large), leaf_targets(load, rest))
    rows = rows.unionByName(split.where("shards is null").select("id", *KEY, "row").join(placed, list(KEY)))
    # rows are numbered by (shard, bucket); a bucket's first slot is what the buckets before it hold
    buckets = n // (shards * NUMBERED) + 1
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    rows = checkpointed(rows.select("id", "size", "crc", "shard", "bucket", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")).alias("k")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(first), ["shard", "bucket"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("k") - 1).alias("slot"))


def kd_shards(points: DataFrame, targets: list[float]) -> DataFrame:
    """(size, crc, h, shard) of the points; leaf k takes about ``targets[k]`` bytes."""
    ends = points.agg(*[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("min", F.min), ("max", F.max))]).first()
    spread = {d: max(1, (ends[f"max_{d}"] or 0) - (ends[f"min_{d}"] or 0)) for d in DIMS}
    points = points.withColumn("at", F.lit(0))
    sizes = {0: len(targets)}
    while open_ := {name: k for name, k in sizes.items() if k > 1}:
        left = {name: sum(targets[name : name + k // 2]) / max(1.0, sum(targets[name : name + k])) for name, k in open_.items()}
        nodes = [Node(name, k, F.col("at") == name, left[name]) for name, k in open_.items()]
        move = F.col("at")
        for node, side in split_level(points, nodes, spread):
            k = node.shards // 2
            move = F.when(node.path & ~side, node.name + k).otherwise(move)
        for name, k in open_.items():
            sizes[name], sizes[name + k // 2] = k // 2, k - k // 2
        # one column instead of conditions that grow with depth
        points = checkpointed(points.withColumn("at", move))
    return points.select(*KEY, F.col("at").alias("shard"))


def op2_sharding(spark, sf_dir):
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
