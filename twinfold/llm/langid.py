"""Language identification with string kernels.

A text is the set of its letter n-grams (n = 1, 2, 3; blended), hashed to presence bits. The kernel
of two texts is the number of shared bits, normalised by both sizes. Nyström landmarks turn kernel
ridge regression, one language against the rest, into one small matrix: scoring a batch is a matrix
product with the landmarks' bits and one with that matrix.

Learnt from at most about PER_LANG distinct texts per language and SAMPLE in all (but one of each
language), chosen by hash of the text, outside the held-out quarter; landmarks are dealt to the
languages in turn, at least LANDMARKS and at least PER_LANDMARK of each. Every text is scored whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any labelled
text all are ``und``; texts longer than SEGMENT characters are read in overlapping segments into
the same bits; rows that repeat are scored alike; other columns pass through, but columns named
``lang_pred`` and ``lang_score`` are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import broadcast_if_small, checkpointed, held_out, text_batches, with_columns

#: Hashed presence bits for each n-gram length.
BITS = {1: 512, 2: 2048, 3: 8192}
WIDTH = sum(BITS.values())
PER_LANG, SAMPLE, LANDMARKS, PER_LANDMARK, RIDGE = 800, 40_000, 256, 4, 0.1
#: Characters and documents of one matrix product.
SEGMENT, DOCS = 1 << 19, 512
UNKNOWN = "und"


def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def presence(texts: list[str], alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, has a letter): one row of 0/1 bytes per text."""
    bits = np.zeros((len(texts), WIDTH), dtype=np.uint8)
    lettered = np.zeros(len(texts), dtype=bool)
    step = SEGMENT - max(BITS)
    parts = [(k, t[at : at + SEGMENT].lower()) for k, t in enumerate(texts) for at in range(0, max(1, len(t)), step)]
    low = 0
    while low < len(parts):
        high, size = low, 0
        while high < len(parts) and (high == low or size + len(parts[high][1]) <= SEGMENT):
            size += len(parts[high][1]) + 1
            high += 1
        code = np.frombuffer("\n".join(p for _, p in parts[low:high]).encode("utf-32-le", "replace"), dtype="<u4")
        row = np.repeat([k for k, _ in parts[low:high]], [len(p) + 1 for _, p in parts[low:high]])[: len(code)]
        is_letter = alpha[code]
        lettered[row[is_letter]] = True
        code = np.where(is_letter, code, 32)
        at = 0
        for n, width in BITS.items():
            if len(code) >= n:
                h = np.zeros(len(code) - n + 1, dtype=np.uint32)
                for k in range(n):
                    h = h * np.uint32(0x01000193) + code[k : len(code) - n + 1 + k]
                h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - width.bit_length() + 1)
                one = row[: len(h)] == row[n - 1 :]
                bits.reshape(-1)[row[: len(h)][one] * WIDTH + (at + h[one])] = 1
            at += width
        low = high
    return bits, lettered


def kernel(bits: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared bits, normalised; ``landmarks`` are float32 rows of unit length."""
    x = bits.astype(np.float32)
    return (x @ landmarks.T) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """(languages, packed landmarks, matrix), learnt from the documents that aren't held out."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"))
    distinct = rows.groupBy("lang", "h").agg(F.lit(1).alias("one"))
    by_lang = checkpointed(distinct.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("first")))
    each = max(1, min(per_lang, SAMPLE // max(1, by_lang.count())))
    share = by_lang.select("lang", (F.lit(each) / F.col("n")).alias("share"), "first")
    picked = distinct.join(share, "lang").where((F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20)) | (F.col("h") == F.col("first"))).select("lang", "h")
    n = picked.count()
    sample = rows.join(broadcast_if_small(picked, n, 32), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "h", "text")

    def packed(batches):
        import pyarrow as pa

        alpha = letters()
        for batch in batches:
            bits, ok = presence([t.as_py() for t in batch.column(2)], alpha)
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array([np.packbits(bits[k]).tobytes() for k in keep], pa.binary())], ["lang", "h", "bits"])

    found = sorted((r["h"], r["lang"], r["bits"]) for r in text_batches(sample).mapInArrow(packed, "lang string, h long, bits binary").collect())
    langs = sorted({lang for _, lang, _ in found})
    if not langs:
        return [], b"", np.zeros((1, 0))
    x = np.unpackbits(np.array([np.frombuffer(b, dtype=np.uint8) for _, _, b in found]), axis=1)[:, :WIDTH]
    y = np.array([langs.index(lang) for _, lang, _ in found])
    order = np.argsort(y, kind="stable")
    turn = np.empty(len(y), dtype=int)  # the how-manieth of its language
    turn[order] = np.arange(len(y)) - np.searchsorted(y[order], y[order])
    turns = np.lexsort((y, turn))[: min(max(landmarks, PER_LANDMARK * len(langs)), len(y))]
    unit = x[turns].astype(np.float32)
    unit /= np.sqrt(np.maximum(unit.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh((unit @ unit.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.c_[kernel(x, unit) @ root, np.ones(len(x))]
    weight = 1 / np.bincount(y)[y]
    wanted = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    coef = np.linalg.solve((z * weight[:, None]).T @ z + ridge / len(y) * np.eye(z.shape[1]), (z * weight[:, None]).T @ wanted)
    return langs, np.packbits(x[turns], axis=1), np.r_[root @ coef[:-1], coef[-1:]]


def identify(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score."""
    langs, packed, matrix = model

    def start():
        import pyarrow as pa

        alpha = letters()
        unit = np.unpackbits(packed, axis=1)[:, :WIDTH].astype(np.float32) if len(langs) else None
        if unit is not None:
            unit /= np.sqrt(np.maximum(unit.sum(axis=1, keepdims=True), 1))

        def run(text):
            names, scores = [], []
            for low in range(0, len(text), DOCS):
                bits, ok = presence([t.as_py() or "" for t in text.slice(low, DOCS)], alpha)
                if unit is None:
                    ok[:] = False
                    best, score = np.zeros(len(ok), dtype=int), np.zeros(len(ok))
                else:
                    s = np.c_[kernel(bits, unit), np.ones(len(bits))] @ matrix
                    best = s.argmax(axis=1)
                    score = np.clip((s[np.arange(len(s)), best] + 1) / 2, 0, 1)
                names += [langs[k] if o else UNKNOWN for k, o in zip(best, ok, strict=True)]
                scores.append(np.where(ok, score, 0.0))
            return pa.array(names, pa.string()), np.concatenate(scores) if scores else np.zeros(0)

        return run

    return with_columns(docs, text_col, start, {"lang_pred": "string", "lang_score": "double"})


def op4_langid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
