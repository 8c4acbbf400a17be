"""Harmonic packing of token sequences.

A document's ids are cut into full sequences and reciprocal pieces: class k holds pieces of
capacity // k ids, and a sequence of class k takes exactly k of them. Each worker fills the bins of
each class by itself while it streams its documents; only the pieces of bins still open at its end
(fewer than k per class) are packed together, first fit by falling length, and its last open
sequence is cut at powers of two, where a sequence needs no padding. Nothing is shuffled.

Defined results: a null text is an empty text, whose only id is the end id; an empty table gives an
empty result; rows that repeat an id are separate documents; other columns of the input are not
looked at. Ids are emitted as little-endian unsigned 32-bit binaries.
"""

from __future__ import annotations

import functools
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import text_batches

CAPACITY = 2048
END_ID = 1
#: Rests of at most this length are not cut again.
SMALL = 64
#: How byte-level BPE cuts a text before merging (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern means it, as a regex class body (a fixed value).
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters encoded at once; longer texts are encoded in segments, longer words in chunks of as many bytes.
SEGMENT, CHUNK = 1 << 18, 1 << 16
#: Bytes on each side of a cut that must encode alike when joined.
JOINT = 256
#: Distinct space-separated words whose ids a worker remembers.
REMEMBERED = 100_000
#: Pieces that a worker holds before it emits them.
EMIT = 4000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def byte_chars() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of whole texts by the byte-level BPE of a tokenizer file, remembering frequent words.

    Byte-level BPE splits a text before any space that stands between two visible characters; ids
    of a text are the ids of its space-led words in turn. Texts with other runs of white space are
    encoded whole. The file's vocabulary is run by ``tiktoken``, which gives the ids that
    ``tokenizers`` gives for it several times as fast. With ``special`` the strings of the file's added
    tokens have these tokens' ids, and what is between them is encoded by itself; else they are ordinary text.

    A text of more than ``segment`` characters is encoded in segments that end where a piece of the
    pattern ends, and a piece of more than ``chunk`` bytes (a run of blanks, a word without end) in
    chunks, so memory does not depend on what a text is made of.
    """

    def __init__(self, path: str, segment: int = SEGMENT, chunk: int = CHUNK, special: bool = False):
        import json

        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        added = {t["content"]: t["id"] for t in made["added_tokens"]}
        byte = byte_chars()
        ranks = {bytes(byte[c] for c in token): n for token, n in made["model"]["vocab"].items() if token not in added}
        self.encode = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ranks = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        if [ranks[token] for token in self.ranks] != list(range(len(ranks))):
            raise ValueError("ids of the vocabulary have gaps")
        self.piece = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))
        self.segment, self.chunk = segment, chunk
        self.added = {token: packed([n]) for token, n in added.items()} if special else {}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words: dict[str, bytes] = {}

    @functools.cached_property
    def merge(self):
        """Ids of a text taken as one piece; only long pieces need it."""
        import tiktoken

        return tiktoken.Encoding("one piece", pat_str="(?s).+", mergeable_ranks={token: n for n, token in enumerate(self.ranks)}, special_tokens={}).encode_ordinary

    @functools.cached_property
    def size(self) -> np.ndarray:
        return np.array([len(token) for token in self.ranks])

    def raw(self, text: str) -> bytes:
        return packed(self.encode(text))

    def new(self, word: str) -> bytes:
        ids = self.raw(" " + word)
        if len(self.words) < REMEMBERED:
            self.words[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if self.marks and self.marks.search(text):
            return b"".join([self.added.get(part) or self.plain(part) for part in self.marks.split(text) if part])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        return self.short(text) if len(text) <= self.segment else b"".join(self.long(text))

    def short(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        got = list(map(self.words.get, rest))
        if not first or first[-1].isspace() or any(not w or w[0].isspace() or w[-1].isspace() for w, ids in zip(rest, got, strict=True) if ids is None):
            return self.raw(text)
        return self.raw(first) + b"".join([self.new(w) if ids is None else ids for w, ids in zip(rest, got, strict=True)])

    def long(self, text: str) -> Iterator[bytes]:
        """Ids of the text's segments: cut before a single space between words, else piece by piece."""
        at = 0
        while len(text) - at > self.segment:
            if found := BETWEEN.search(text, at + self.segment // 2, at + self.segment):
                yield self.short(text[at : found.start()])
                at = found.start()
                continue
            ids, stop = [], at + self.segment // 2
            for m in self.piece.finditer(text, at):
                at = m.end()
                if at - m.start() > self.chunk:
                    yield packed(ids)
                    yield from self.chunks(m.group().encode("utf-8", "replace"))
                    ids = []
                else:
                    ids += self.merge(m.group())
                if at >= stop:
                    break
            yield packed(ids)
        yield self.short(text[at:])

    def chunks(self, piece: bytes) -> Iterator[bytes]:
        """Ids of one piece of the pattern.

        Tokens are those of the whole piece when each neighbouring pair is: so a cut between two
        tokens is right when the tokens around it come out again from their joined bytes.
        """
        at, width = 0, self.chunk
        ids, end = self.merged(piece, at, width)
        while end < len(piece):
            for k in reversed(self.cuts(piece, at, ids)[: -width // 64 or None][-64:]):
                cut = at + int(self.size[ids[: k + 1]].sum())
                next_, next_end = self.merged(piece, cut, width)
                if self.joined(piece, ids[: k + 1], cut, next_):
                    yield packed(ids[: k + 1])
                    at, ids, end = cut, next_, next_end
                    break
            else:
                width *= 2
                ids, end = self.merged(piece, at, width)
        yield packed(ids)

    def merged(self, piece: bytes, at: int, width: int) -> tuple[list[int], int]:
        """Ids of about ``width`` bytes from ``at``, and where they end."""
        end = min(len(piece), at + width)
        while end < len(piece) and piece[end] & 0xC0 == 0x80:
            end += 1
        return self.merge(piece[at:end].decode()), end

    def cuts(self, piece: bytes, at: int, ids: list[int]) -> list[int]:
        """Tokens of ``ids`` after which a character ends."""
        ends = at + np.cumsum(self.size[ids])
        return [k for k, e in enumerate(ends.tolist()) if e == len(piece) or piece[e] & 0xC0 != 0x80]

    def joined(self, piece: bytes, left: list[int], cut: int, right: list[int]) -> bool:
        sizes = np.cumsum(self.size[left[::-1]])
        before = next((k for k in range(len(left)) if sizes[k] >= JOINT and piece[cut - sizes[k]] & 0xC0 != 0x80), len(left) - 1)
        after = next((k for k in self.cuts(piece, cut, right) if self.size[right[: k + 1]].sum() >= JOINT), len(right) - 1)
        some = piece[cut - int(sizes[before]) : cut + int(self.size[right[: after + 1]].sum())]
        return self.merge(some.decode()) == left[len(left) - before - 1 :] + right[: after + 1]


#: A single space between two words.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process, for all its tasks."""
    return Encoder(path, special=True)


def cuts(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(class, length) of the pieces of ``n`` ids, in order."""
    for _ in range(n // capacity):
        yield 1, capacity
    n %= capacity
    while n > SMALL:
        k = -(-capacity // n)
        yield k, capacity // k
        n -= capacity // k
    if n:
        yield capacity // n, n


class Bins:
    """The bins of one worker. Pieces are [doc_id, start, ids, doc_tokens]."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.open, self.next = capacity, {}, worker << 40

    def sequence(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, ids, total, self.next, at
            at += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) // 4, 0
        for k, n in cuts(total, self.capacity):
            held = self.open.setdefault(k, [])
            held.append((doc, at, ids[4 * at : 4 * (at + n)], total))
            at += n
            if len(held) == k:
                yield from self.sequence(self.open.pop(k))

    def close(self) -> Iterator[tuple]:
        """Pack what is left: fewer than k pieces per class, whatever the input's size."""
        rest = sorted((p for held in self.open.values() for p in held), key=lambda p: -len(p[2]))
        bins: list[list] = []
        room: list[int] = []
        for p in rest:
            n = len(p[2]) // 4
            k = next((k for k, r in enumerate(room) if r >= n), None)
            if k is None:
                bins.append([])
                room.append(self.capacity)
                k = len(bins) - 1
            bins[k].append(p)
            room[k] -= n
        for held, r in zip(bins, room, strict=True):
            if r <= self.capacity // 32:
                yield from self.sequence(held)
            else:
                for part in at_powers(held, self.capacity - r):
                    yield from self.sequence(part)


def at_powers(pieces: list, total: int) -> Iterator[list]:
    """The pieces dealt to sequences whose lengths are the powers of two that make up ``total``."""
    pieces = list(reversed(pieces))
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        part = []
        while want:
            doc, start, ids, all_ = pieces.pop()
            n = min(want, len(ids) // 4)
            part.append((doc, start, ids[: 4 * n], all_))
            if 4 * n < len(ids):
                pieces.append((doc, start + n, ids[4 * n :], all_))
            want -= n
        yield part


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, start and ids, its sequence and offset there.

    ``tokenizer`` is the path, on every worker, of a byte-level BPE file.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, bins, out = encoder(tokenizer), Bins(TaskContext.get().partitionId(), capacity), []
        end = end_id.to_bytes(4, "little")
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def table():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in bins.add(doc, encode(text.as_py() or "") + end):
                    out.append(row)
                    if len(out) >= EMIT:
                        yield table()
        out.extend(bins.close())
        if out:
            yield table()

    return text_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)


def op5_packing(spark, sf_dir):
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
