"""Byte-level BPE: words are folded to tokens by Spark's higher-order functions, ids decode to bytes.

A text is split into words by the pattern of its vocabulary. Each task sends a word to the fold the
first time that it meets it and remembers its ids; a document is then the ids of its words, one
after the other. Words that are frequent in a bounded sample of texts are folded before, once for
all tasks, which only saves time.

The fold starts from a word's bytes. A word that is a token has its rank for id. Of any other word,
the parts that are tokens are found by a literal rank map (an array of small maps; the hash of some
bytes tells the map) and folded in the order of rank and place over the places where tokens may end:
a part whose two ends are still open is merged, which closes the places inside it. That gives the
tokens of merging, again and again, the leftmost neighbours of the smallest rank: what is merged
inside a part with open ends depends on that part only, so it has become one token when its rank's
turn comes. The places are the bits of one long; words of more than 60 bytes keep an array of tokens
and of the ranks of neighbours, and merge the leftmost smallest. Bytes are written as hexadecimal
digits, so that to join two tokens is to join their strings.

A word above LONG bytes is cut into overlapping chunks that are folded alone; two neighbours are
joined at a place where both have a token's end and the tokens on both sides stay apart when folded
together, which makes them the tokens of the whole word. A word without such a place is folded whole.

Nothing but the sample is shuffled. Decoding puts the bytes of the ids one after the other.

Defined results: a null text is an empty text, without ids; null ids decode to null, and an id that
the vocabulary has not decodes to no bytes; rows that repeat are encoded alike; other columns pass
through, but columns with the names of the new ones are replaced.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from twinfold.llm.common import text_batches, with_columns, without

#: White space as the pattern of the vocabularies means it, as a regex class body (a fixed value).
SPACES = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Maps of a literal; a power of two.
BUCKETS = 1 << 14
#: Texts of the sample of words, how many of their words are kept, and how many more a task remembers.
SAMPLE, FREQUENT, REMEMBERED = 5000, 1 << 17, 400_000
#: Bytes of a word whose places are the bits of a long; the first bytes of a token that tell how long tokens with them get.
SHORT, FIRST = 60, 4
#: Bits below a rank: a part's place and its number of digits.
PLACE = 14
#: Bytes between the starts of two chunks, which are twice as long; longer words are cut.
STRIDE = 192
LONG = 2 * STRIDE
#: Stands at both ends of a word while its tokens are an array: no token has this digit.
END = "z"


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a line each, base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def spaced(pattern: str) -> str:
    """The pattern with white space spelt out: what \\s means differs between libraries."""
    return pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")


def look(table: Column, key: Column) -> Column:
    """The key's value in an array of maps, null if it has none."""
    return table[F.xxhash64(key).bitwiseAND(BUCKETS - 1)][key]


def literal(values: dict[str, int]) -> Column:
    """An array of maps that Spark folds into one literal."""
    import xxhash

    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for key, value in values.items():
        maps[xxhash.xxh64_intdigest(key.encode(), 42) % BUCKETS][key] = value
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>").cast("array<map<binary,int>>")


def rank_map(ranks: dict[bytes, int]) -> Column:
    """Ranks, times 2 ** PLACE, by the hexadecimal digits of tokens."""
    if max(ranks.values(), default=0) >= 1 << 31 - PLACE:
        raise ValueError(f"ranks must be below {1 << 31 - PLACE}")
    return literal({token.hex().upper(): rank << PLACE for token, rank in ranks.items()})


def length_map(ranks: dict[bytes, int]) -> Column:
    """How many digits tokens get that begin with some FIRST bytes, by their digits."""
    found: dict[str, int] = {}
    for token in ranks:
        if len(token) >= FIRST:
            key = token[:FIRST].hex().upper()
            found[key] = max(found.get(key, 0), 2 * len(token))
    return literal(found)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once and, however often it is named, stands once in the plan: the end of a fold over nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda s, _: s, body)


def part(digits: Column, start: Column, length: Column) -> Column:
    """``length`` digits from byte ``start``; digits are ASCII in a binary, which is cut without looking for characters."""
    return F.substring(digits, 2 * start + 1, length)


def shifted(x: Column, n: int | Column, way: str) -> Column:
    return F.call_function(f"shift{way}", x, F.lit(n) if isinstance(n, int) else n)


def rank_of(found: Column) -> Column:
    return shifted(found, PLACE, "right")


def short_merged(ranks: Column, lengths: Column, digits: Column) -> Column:
    """Ids of a word of 2 to SHORT bytes."""
    size = F.length(digits)

    def parts_from(at: Column) -> Column:
        first = F.substring(digits, at, F.lit(2 * FIRST))
        most = F.least(size - at + 1, F.coalesce(look(lengths, first), F.lit(2 * FIRST - 2)))
        # a part is its rank, its first digit's place and its number of digits in one integer, so that parts sort by rank and place
        here = shifted(at, 7, "left")
        return F.transform(F.sequence(here + 4, here + most, F.lit(2)), lambda x: look(ranks, F.substring(digits, at, x.bitwiseAND(127))) + x)

    found = F.flatten(F.transform(F.sequence(F.lit(1), size - 3, F.lit(2)), parts_from))
    found = F.sort_array(F.array_except(found, F.array(F.lit(None).cast("int"))))
    one = F.lit(1).cast("long")

    def merge(places: Column, x: Column) -> Column:
        begin = shifted(one, shifted(x, 8, "right").bitwiseAND(63), "left")

        def closed(start: Column, end: Column) -> Column:
            both = start.bitwiseOR(end)
            return F.when(places.bitwiseAND(both) == both, places.bitwiseAND(F.bitwise_not(end - start - start))).otherwise(places)

        return let(begin, lambda start: let(shifted(start, shifted(x, 1, "right").bitwiseAND(63), "left"), lambda end: closed(start, end)))

    def ids(places: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), shifted(size, 1, "right")), lambda k: F.getbit(places, k) == 1)
        return let(ends, lambda e: F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda a, k: rank_of(look(ranks, part(digits, a, 2 * (e[k + 1] - a))))))

    return F.aggregate(found, shifted(one, shifted(size, 1, "right") + 1, "left") - 1, merge, ids)


def merged(ranks: Column, digits: Column) -> Column:
    """Tokens, as digits, of a word of any length."""
    n = (F.length(digits) / 2).cast("int")
    ends = F.array(F.lit(END).cast("binary"))
    parts = F.concat(ends, F.transform(F.sequence(F.lit(0), n - 1), lambda k: part(digits, k, F.lit(2))), ends)
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda k: look(ranks, F.concat(F.element_at(t, k), F.element_at(t, k + 1))))
    begin = let(parts, lambda t: F.struct(t.alias("t"), pairs(t).alias("r")))

    def merge(s: Column, at: Column) -> Column:
        t, r = s["t"], s["r"]

        def joined(x: Column) -> Column:
            beside = F.array(look(ranks, F.concat(F.element_at(t, at - 1), x)), look(ranks, F.concat(x, F.element_at(t, at + 2))))
            return F.struct(
                F.concat(F.slice(t, F.lit(1), at - 1), F.array(x), F.slice(t, at + 2, F.size(t))).alias("t"),
                F.concat(F.slice(r, F.lit(1), at - 2), beside, F.slice(r, at + 2, F.size(r))).alias("r"),
            )

        return let(F.concat(F.element_at(t, at), F.element_at(t, at + 1)), joined)

    def step(s: Column, _: Column) -> Column:
        return let(F.array_min(s["r"]), lambda least: F.when(least.isNull(), s).otherwise(let(F.array_position(s["r"], least).cast("int"), lambda at: merge(s, at))))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), begin, step, lambda s: F.slice(s["t"], F.lit(2), F.size(s["t"]) - 2))


def chunked(ranks: Column, digits: Column) -> Column:
    """Tokens, as digits, of a long word: those of its chunks, joined where two chunks agree; null if two don't."""
    n = (F.length(digits) / 2).cast("int")
    last = F.greatest(F.ceil(n / STRIDE).cast("int") - 2, F.lit(0))

    def chunk(k: Column) -> Column:
        tokens = merged(ranks, part(digits, k * STRIDE, 2 * F.least(F.lit(2 * STRIDE), n - k * STRIDE)))

        def ends(t: Column) -> Column:
            sizes = F.transform(t, lambda x: (F.length(x) / 2).cast("int"))
            return F.aggregate(sizes, F.array(k * STRIDE), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

        return let(tokens, lambda t: F.struct(t.alias("t"), ends(t).alias("e")))

    def meet(a: Column, b: Column) -> Column:
        """A place after which the second chunk's tokens may follow the first one's."""

        def fits(at: Column) -> Column:
            left, right = F.element_at(a["t"], F.array_position(a["e"], at).cast("int") - 1), F.element_at(b["t"], F.array_position(b["e"], at).cast("int"))
            return F.size(merged(ranks, F.concat(left, right))) == 2

        inner = F.filter(F.array_intersect(a["e"], b["e"]), lambda at: (at > F.element_at(a["e"], 1)) & (at < F.element_at(a["e"], -1)) & (at < F.element_at(b["e"], -1)))
        # in the middle of what both have; a few are tried
        return F.get(F.filter(F.slice(inner, F.greatest(F.size(inner) / 2, F.lit(1)).cast("int"), F.lit(8)), fits), F.lit(0))

    def joined(chunks: Column) -> Column:
        between = F.transform(F.sequence(F.lit(1), F.size(chunks)), lambda k: F.when(k < F.size(chunks), meet(F.element_at(chunks, k), F.element_at(chunks, F.least(k + 1, F.size(chunks))))).otherwise(n))

        def tokens(cut: Column) -> Column:
            def own(c: Column, k: Column) -> Column:
                first = F.when(k == 0, F.lit(1)).otherwise(F.array_position(c["e"], F.element_at(cut, F.greatest(k, F.lit(1)))).cast("int"))
                return F.slice(c["t"], first, F.array_position(c["e"], F.element_at(cut, k + 1)).cast("int") - first)

            return F.when(~F.exists(cut, F.isnull), F.flatten(F.transform(chunks, own)))

        return let(between, tokens)

    return let(F.transform(F.sequence(F.lit(0), last), chunk), joined)


def ids_of(ranks: Column, lengths: Column, word: Column) -> Column:
    """Ids of a word, an array."""

    def ids(digits: Column, whole: Column) -> Column:
        size = F.length(digits) / 2
        tokens = F.when(size <= LONG, merged(ranks, digits)).otherwise(let(chunked(ranks, digits), lambda t: F.coalesce(t, merged(ranks, digits))))
        return F.when(whole.isNotNull(), F.array(rank_of(whole))).when(size <= SHORT, short_merged(ranks, lengths, digits)).otherwise(F.transform(tokens, lambda t: rank_of(look(ranks, t))))

    return let(F.hex(word.cast("binary")).cast("binary"), lambda digits: let(look(ranks, digits), lambda whole: ids(digits, whole)))


def folded(rows: DataFrame, words: str, ranks: dict[bytes, int], name: str = "ids") -> DataFrame:
    """``rows`` with the ids of each word of the array ``words``."""
    made = let(rank_map(ranks), lambda r: let(length_map(ranks), lambda n: F.transform(F.col(words), lambda w: ids_of(r, n, w))))
    return rows.withColumn(name, made)


class Numbers(dict):
    """Numbers of words; a word that is asked for the first time gets the next one and is listed in ``new``."""

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


class Splitter:
    """Words of texts by a pattern, as numbers; new words are told apart.

    Words are numbered from 0 as they are met, after the ``frequent`` ones.
    """

    def __init__(self, pattern: str, frequent: list[str], most: int = REMEMBERED):
        import regex

        self.find = regex.compile(spaced(pattern)).findall
        self.frequent, self.most = frequent, most
        self.clear()

    def clear(self) -> None:
        self.number = Numbers(zip(self.frequent, range(len(self.frequent)), strict=True))

    def __call__(self, text: str) -> tuple[bytes, list[str], bool]:
        """Numbers of the text's words, the words met for the first time, and whether numbering began anew."""
        anew = len(self.number) - len(self.frequent) >= self.most
        if anew:
            self.clear()
        self.number.new = new = []
        words = self.find(text)
        return np.fromiter(map(self.number.__getitem__, words), "<u4", len(words)).tobytes(), new, anew


def frequent_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", sample: int = SAMPLE, most: int = FREQUENT) -> tuple[list[str], list[bytes]]:
    """The most frequent words of about ``sample`` texts, at most ``most``, and their ids."""
    share = min(1.0, sample / max(1, docs.count()))
    some = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))))
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(spaced(pattern)), F.lit(0))).alias("w")).where(F.octet_length("w") <= SHORT)
    kept = words.groupBy("w").count().where("count > 1").orderBy(F.desc("count"), "w").limit(most).select("w")
    rows = folded(kept.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism, "w").select("w", F.array("w").alias("one")), "one", ranks).select("w", F.get("ids", F.lit(0)).alias("ids")).collect()
    return [r["w"] for r in rows], [np.array(r["ids"], dtype="<u4").tobytes() for r in rows]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", keep_text: bool = True, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with the ids of each whole text, as little-endian unsigned 32-bit integers in one binary.

    ``path`` is a rank file on the driver, ``pattern`` the one that its vocabulary splits texts by.
    """
    ranks = ranks_of(path)
    words, ids = frequent_words(docs, ranks, pattern, text_col, sample)
    known = docs.sparkSession.sparkContext.broadcast((words, ids))  # at most FREQUENT words of at most SHORT bytes
    rows = without(docs, [ids_col])
    at = [c.lower() for c in rows.columns].index(text_col.lower())
    kept = [k for k in range(len(rows.columns)) if keep_text or k != at]
    inner = StructType([rows.schema.fields[k] for k in kept])
    split_schema = StructType().add("row", inner).add("numbers", "binary").add("new", ArrayType(StringType())).add("anew", "boolean")

    def split(batches):
        import pyarrow as pa

        splitter = Splitter(pattern, known.value[0])
        for batch in batches:
            made = [splitter(t.as_py() or "") for t in batch.column(at)]
            row = pa.StructArray.from_arrays([batch.column(k) for k in kept], [batch.schema.names[k] for k in kept])
            numbers, new, anew = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([row, pa.array(numbers, pa.binary()), pa.array(new, pa.list_(pa.string())), pa.array(anew, pa.bool_())], ["row", "numbers", "new", "anew"])

    def join(batches):
        import pyarrow as pa

        table = list(known.value[1])
        first = len(table)
        for batch in batches:
            out = []
            offsets, values = batch.column(3).offsets.to_numpy().tolist(), batch.column(3).values
            ends, flat = values.offsets.to_numpy().tolist(), values.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            for k, (numbers, anew) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                if anew:
                    del table[first:]
                table.extend(flat[4 * ends[j] : 4 * ends[j + 1]] for j in range(offsets[k], offsets[k + 1]))
                out.append(b"".join(map(table.__getitem__, np.frombuffer(numbers.as_py(), dtype="<u4").tolist())))
            row = batch.column(0)
            yield pa.RecordBatch.from_arrays([*row.flatten(), pa.array(out, pa.binary())], [*inner.names, ids_col])

    pieces = folded(text_batches(rows).mapInArrow(split, split_schema), "new", ranks).select("row", "numbers", "anew", "ids")
    return pieces.mapInArrow(join, StructType([*inner.fields]).add(ids_col, "binary"))


def decode(docs: DataFrame, path: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of the ids, one after the other."""
    ranks = ranks_of(path)
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def start():
        table = shared.value

        def pieces(ids: bytes) -> bytes:
            some = np.frombuffer(ids, dtype="<u4")
            return b"".join(map(table.__getitem__, some[some < len(table)].tolist()))

        return lambda ids: [[None if x is None else pieces(x) for x in ids.to_pylist()]]

    return with_columns(docs, ids_col, start, {bytes_col: "binary"})


def op11_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decode(encode(docs, path, public_tokenizers.PATTERN, keep_text=False), path)
    return found.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
