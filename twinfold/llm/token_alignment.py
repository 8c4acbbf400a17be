"""Alignment of two tokenizers on the same texts, by coalescing token intervals.

A's tokens and B's tokens of a text are byte intervals over the same bytes. All tokens of a batch of
texts are sorted by start (lexsort), and the running maximum of their ends is kept
(maximum.accumulate): a group of tokens ends where the next start reaches that maximum. Within a group
every token of A is linked with each token of B that its bytes overlap; the overlaps are ranges of
tokens, expanded without comparing pairs.

The texts are encoded once. Each document keeps its distinct linked id pairs with their counts, which
are then added up over the corpus. To bring a pair's total back to the documents, the pairs of the
highest counts (at most BROADCAST of them, by a histogram of powers of two) are broadcast, and the
others meet their documents by an ordinary join: those are rare, so no key is hot.

A is a byte-level BPE file and gets a space before the text, B a sentencepiece model, which adds one.
Both are loaded on the workers from paths.

Defined results: texts that are null or empty, or that one of the tokenizers does not give back byte
by byte, have no tokens: all counts are 0 and the groups are ''; rows that repeat, and rows that
share an id, count one by one; the result has its own columns only, so others cannot clash.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import checkpointed, text_batches
from twinfold.llm.packing import Encoder, byte_chars

#: Pairs that are broadcast at most (24 bytes each), and tokens that are aligned at once.
BROADCAST, TOKENS = 500_000, 1 << 18

SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


class Both:
    """Ids of space + text by A and of text by B; None if the bytes of either are not the text's."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Encoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self.a.ranks
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in some], dtype=np.int64) for some in (self.bytes_a, self.bytes_b))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        a = self.a.raw(" " + text) if len(text) < self.a.segment else self.a(" " + text)
        b = self.b.encode(text)
        # A gives any bytes back
        if b"".join(map(self.bytes_b.__getitem__, b)) != (" " + text).encode("utf-8", "surrogatepass"):
            return None
        return np.frombuffer(a, dtype="<u4"), np.array(b, dtype="<u4")


@functools.cache
def both(path_a: str, path_b: str) -> Both:
    """One per worker process, for all its tasks."""
    return Both(path_a, path_b)


def spans(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def aligned(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, A token of each link, B token of each link), of tokens over the same bytes, in order.

    Tokens have a byte at least; an A token's links are in order of the B tokens.
    """
    start_a, end_a = spans(size_a)
    start_b, end_b = spans(size_b)
    start, end, side = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b]), np.repeat([0, 1], [len(start_a), len(start_b)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(np.append(True, start[order][1:] >= reach[:-1])) - 1 if len(order) else []
    # the B tokens that overlap an A token are those from the last that starts at or before it to the last that starts before its end
    first, last = np.searchsorted(start_b, start_a, "right") - 1, np.searchsorted(start_b, end_a, "left")
    count = last - first
    a = np.repeat(np.arange(len(start_a)), count)
    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return group[: len(start_a)], group[len(start_a) :], a, b


def written(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, marked: list[str]) -> str:
    """Groups as a1,a2|b1;a3|b2,b3: ids in order. ``marked`` has each id with the four marks that may follow."""
    ids = np.concatenate([ids_a, ids_b])
    group = np.concatenate([group_a, group_b])
    side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
    order = np.lexsort((side, group))
    ids, group, side = ids[order], group[order], side[order]
    mark = np.append(np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)), 3)
    return "".join(map(marked.__getitem__, (ids.astype(np.int64) * 4 + mark).tolist()))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times): a row for each document.

    ``pairs`` are its distinct linked ids, A's times 2 ** 32 plus B's. With ``digest`` groups are the SHA-256 of their text, if there are any.
    """

    def run(batches):
        import pyarrow as pa

        tokens = both(path_a, path_b)
        marked = [f"{k}{mark}" for k in range(max(len(tokens.bytes_a), len(tokens.bytes_b))) for mark in (",", "|", ";", "")]

        def rows(some):
            """Of several documents at once: their tokens follow one another."""
            made = [x for _, x in some if x is not None]
            cut_a, cut_b = (np.cumsum([0, *(len(x[k]) for x in made)]) for k in (0, 1))
            ids_a, ids_b = (np.concatenate([np.empty(0, dtype="<u4"), *(x[k] for x in made)]) for k in (0, 1))
            group_a, group_b, a, b = aligned(tokens.size_a[ids_a], tokens.size_b[ids_b])
            links = np.searchsorted(a, cut_a)
            keys = (ids_a[a].astype(np.int64) << 32) | ids_b[b]
            k, out = 0, []
            for _, x in some:
                if x is None or not len(x[0]):
                    out.append((0, 0, 0, 0, "", [], []))
                    k += x is not None
                    continue
                here_a, here_b = slice(cut_a[k], cut_a[k + 1]), slice(cut_b[k], cut_b[k + 1])
                pairs, times = np.unique(keys[links[k] : links[k + 1]], return_counts=True)
                text = written(ids_a[here_a], ids_b[here_b], group_a[here_a], group_b[here_b], marked)
                text = hashlib.sha256(text.encode()).hexdigest() if digest else text
                out.append((len(x[0]), len(x[1]), int(group_a[here_a][-1] - group_a[here_a][0]) + 1, int(links[k + 1] - links[k]), text, pairs, times.astype("int32")))
                k += 1
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            columns = [pa.array([i for i, _ in some], id_kind), *[pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]]
            return pa.RecordBatch.from_arrays(columns, [id_col, *[f.split()[0] for f in SCHEMA.split(", ")]])

        for batch in batches:
            id_kind, held, size = batch.schema.types[0], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = tokens(text.as_py()) if text.is_valid and text.as_py() else None
                held.append((i, got))
                size += len(got[0]) + len(got[1]) if got else 0
                if size >= TOKENS:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    kind = docs.schema[id_col].dataType.simpleString()
    return text_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, {SCHEMA}")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair in all documents, and whether none of its B id has more."""
    counts = checkpointed(found.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each of B's ids at most
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, broadcast: int = BROADCAST) -> DataFrame:
    """``align`` with n_best and count_sum: links whose pair is the most linked of its B id, and the sum of the links' corpus-wide counts."""
    found = checkpointed(align(docs, path_a, path_b, id_col, text_col, digest).withColumn("_row", F.monotonically_increasing_id()))
    counts = checkpointed(pair_counts(found))
    # frequent: from a power of two on above which at most ``broadcast`` pairs are
    sizes = sorted(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect(), key=lambda r: -r["k"])
    least, total = None, 0
    for r in sizes:
        total += r["count"]
        if total > broadcast:
            break
        least = 1 << r["k"]
    frequent = F.lit(False) if least is None else F.col("n") >= least
    rows = found.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    best, sum_ = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("times")).alias("sum")
    many = rows.join(F.broadcast(counts.where(frequent)), "pair").groupBy("_row").agg(best, sum_)
    if total > broadcast:
        few = F.broadcast(counts.where(frequent).select("pair"))
        rest = rows.join(few, "pair", "left_anti").join(counts.where(~frequent), "pair").groupBy("_row").agg(best, sum_)
        many = many.unionByName(rest).groupBy("_row").agg(F.sum("best").alias("best"), F.sum("sum").alias("sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return found.join(many, "_row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", "groups", zero("best").alias("n_best"), zero("sum").alias("count_sum"))


def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scored(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
