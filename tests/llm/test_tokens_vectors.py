"""Byte-level BPE, alignment of tokenizers and whitening against plain versions."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from twinfold.llm import byte_bpe, packing, token_alignment, whitening

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, Token_IDs string, source string"
ODD = [
    None, "", " ", "a", "don't 'S can't  \n\n x\r\n", "　　wide blank", "a  b", "x<|endoftext|>y", " lead", "trail ", "▁ sep ▁x", "é中😀 𝒳", "a\u0000b", "<s> </s>", "-" * 61, "a" * 60, "e" * 385,
    "=" * 1500, "é" * 700, " " * 1500 + "x", "ab" * 900, "".join(random.Random(1).choice("abcdefgh") for _ in range(3000)), "".join(random.Random(2).choice("01 ab\n'stré中😀\t") for _ in range(4000)),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "own", "s") for k, t in enumerate(ODD)] + [(3, "a", None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})


def test_bpe_is_that_of_the_library(odd, plain):
    found = byte_bpe.decode(byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(found) == len(ODD) + 1 and found[0].asDict().keys() == {"doc_id", "text", "source", "token_ids", "decoded"}
    for r in found:
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == plain.encode_ordinary(r["text"] or ""), r["doc_id"]
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_numbers_anew(spark, plain, monkeypatch):
    monkeypatch.setattr(byte_bpe.Splitter.__init__, "__defaults__", (20,))
    texts = [" ".join(f"w{k}x{n}" for n in range(12)) for k in range(30)]
    found = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), RANKS, public_tokenizers.PATTERN, sample=3).collect()
    assert all(np.frombuffer(r["token_ids"], "<u4").tolist() == plain.encode_ordinary(r["text"]) for r in found)


def test_every_token_is_folded_to_itself(spark):
    """What the fold over open places rests on: a token's own bytes merge to it."""
    ranks = {t: k for t, k in byte_bpe.ranks_of(RANKS).items() if 1 < len(t) <= byte_bpe.SHORT}
    some = [(t.hex().upper().encode(), k) for t, k in list(ranks.items())[::7]]
    rows = spark.createDataFrame(some, "digits binary, k int").repartition(4)
    from pyspark.sql import functions as F

    every = byte_bpe.ranks_of(RANKS)
    ids = byte_bpe.let(byte_bpe.rank_map(every), lambda r: byte_bpe.let(byte_bpe.length_map(every), lambda n: byte_bpe.short_merged(r, n, F.col("digits"))))
    assert rows.where(~(ids == F.array("k"))).isEmpty()


def test_bpe_of_an_empty_table(spark):
    assert byte_bpe.encode(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN).collect() == []
    row = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x7f")), (2, None)], "k int, token_ids binary")
    assert [r["decoded"] for r in byte_bpe.decode(row, RANKS).orderBy("k").collect()] == [bytearray(b""), None]


def brute_alignment(texts):
    """A row for each text, in the columns of the query."""
    a_ids = Tokenizer.from_file(BPE)
    a_ids.encode_special_tokens = True
    b_ids, byte = sentencepiece.SentencePieceProcessor(model_file=PIECES), packing.byte_chars()
    made, counts = [], collections.Counter()
    for t in texts:
        a, b = a_ids.encode(" " + (t or ""), add_special_tokens=False).ids, b_ids.encode(t or "")
        bytes_a = [bytes(byte[c] for c in a_ids.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_ids.id_to_piece(i)[3:5], 16)]) if b_ids.is_byte(i) else b_ids.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            made.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in some]).tolist() for some in (bytes_a, bytes_b))
        groups = [[[], []] for _ in sorted(set(ends_a) & set(ends_b))]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            cuts = sorted(set(ends_a) & set(ends_b))
            for i, e in zip(ids, ends, strict=True):
                groups[next(k for k, c in enumerate(cuts) if e <= c)][side].append(str(i))
        links = [(x, y) for x, ex, lx in zip(a, ends_a, map(len, bytes_a), strict=True) for y, ey, ly in zip(b, ends_b, map(len, bytes_b), strict=True) if ex - lx < ey and ey - ly < ex]
        counts.update(links)
        made.append((len(a), len(b), len(groups), links, ";".join("|".join(",".join(s) for s in g) for g in groups)))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(counts[p] == most[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), d[4]) for d in made]


@pytest.mark.parametrize("broadcast", [500_000, 4, 0])
def test_alignment_is_brute_force(spark, broadcast):
    texts = [t for t in ODD if not t or len(t) < 100] + ["a b", "a b", None]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, Pairs int").repartition(3)
    want = brute_alignment(texts)
    for digest in (False, True):
        got = {r["doc_id"]: tuple(r[1:-3]) + (r["n_best"], r["count_sum"], r["groups"]) for r in token_alignment.scored(docs, BPE, PIECES, digest=digest, broadcast=broadcast).collect()}
        for k, w in enumerate(want):
            text = hashlib.sha256(w[6].encode()).hexdigest() if digest and w[6] else w[6]
            assert got[k] == (*w[:6], text), (k, texts[k])


def test_alignment_of_an_empty_table(spark):
    assert token_alignment.scored(spark.createDataFrame([], "doc_id long, text string"), BPE, PIECES).collect() == []


@pytest.mark.parametrize("d", [1, 2, 3, 9, 40])
def test_components_are_eigenvectors(d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    for e in (rng.exponential(1, d), 10.0 ** -rng.integers(0, 9, d), np.ones(d), np.r_[np.ones(d // 2), np.zeros(d - d // 2)]):
        v = (q * e) @ q.T
        values, vectors = whitening.components((v + v.T) / 2)
        assert np.allclose(values, np.sort(e)[::-1], atol=1e-14) and np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13) and np.allclose(v @ vectors, vectors * values, atol=1e-13)


def test_polar_is_the_sign():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    e = np.array([1e-9, -1e-7, 1, -2, 3, 4, -5, 0.1, -0.2, 7, 8, -9])
    assert np.allclose(whitening.polar((q * e) @ q.T), (q * np.sign(e)) @ q.T, atol=1e-6)


def test_whitening_is_that_of_eigh(spark):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((400, 10)) * np.arange(1, 11)).astype("float32")
    x[7] = x[8]
    bad = [None, [], [1.0] * 9, [1.0] * 9 + [None], [1.0] * 9 + [float("nan")], [float("-inf")] * 10]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(1000 + k, v, 1) for k, v in enumerate(bad)] + [(None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, Component int").repartition(5)
    got = whitening.whiten(df).toPandas()
    ints = np.floor(np.vstack([x, x[:1]]).astype(float) * 1024).astype(int) + 100_000
    n, sums = len(ints), ints.sum(axis=0)
    v = np.cov(ints.T.astype(float), bias=True)
    e, u = np.linalg.eigh(v)
    want = ((ints - sums / n) @ u[:, ::-1] / np.sqrt(e[::-1]))[:, :8]
    assert len(got) == 8 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-12
    one = got[got["vec_id"].notna()].sort_values(["vec_id", "component"])["whitened"].to_numpy().reshape(-1, 8)
    assert np.allclose(one * np.sign((one * want[:-1]).sum(axis=0)), want[:-1], atol=1e-10)
    assert {int(r["vec_id"]): int(r["deviation"]) for _, r in got.dropna(subset="vec_id").iterrows()} == {k: int(((n * ints[k] - sums) ** 2).sum()) for k in range(400)}
    assert np.allclose(got.drop_duplicates("component").sort_values("component")["explained"], e[::-1][:8] / e.sum())


def test_whitening_without_variance(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[1:] for r in whitening.whiten(same).collect()] == [(k, 2, 0, None, 0.0, 0.0) for k in (1, 2, 1, 2)]


def test_deviations_of_any_size():
    x = np.array([[1 << 40, -(1 << 40)], [5, 7]])
    sums = x.sum(axis=0).tolist()
    for n in (2, 10**9, 10**14):
        assert whitening.deviation(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
