"""The corpus operators against plain Python, on small awkward tables."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinfold.llm import exact_dedup, langid, license_scan, mixing, packing, quality, sharding, simhash, toxicity, url_filter
from twinfold.llm.common import held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def rows(seed=1, n=300):
    """Documents with nulls, empties, long texts, copies, near copies and a hot source."""
    rng = np.random.default_rng(seed)
    vocab = [a + b for a in ("la", "ti", "mor", "ent", "sy", "quo") for b in ("ne", "dar", "vi", "lop", "st", "x")]
    out, made = [], []
    for k in range(n):
        kind = k % 10
        if kind == 0 and made:
            text = made[int(rng.integers(len(made)))]
        elif kind == 1 and made:
            w = made[int(rng.integers(len(made)))].split(" ")
            w[int(rng.integers(len(w)))] = "changed"
            text = " ".join(w)
        elif k % 37 == 5:
            text = None
        elif k % 37 == 6:
            text = ["", " \t\n", "x", "Two words"][k % 4]
        elif k % 97 == 7:
            text = " ".join(rng.choice(vocab, 9000))
        else:
            text = " ".join(rng.choice(vocab, int(rng.integers(3, 120)))) + [".", "\nAgain\nAgain\n", " ###", "  end"][k % 4]
        if text:
            made.append(text)
        out.append((k, text, ["en", "de", None][k % 3], "hot" if k % 3 == 0 else None if k % 11 == 0 else f"s{k % 5}", 0))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("support", [0.001, 0.02, 0.3])
def test_exact_groups(docs, support):
    groups = collections.defaultdict(list)
    for k, t in texts(docs).items():
        groups[normal(t)].append(k)
    want = {k: (min(g), len(g), k == min(g)) for g in groups.values() for k in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.duplicate_groups(docs, support=support).collect()}
    assert got == want
    assert {r["doc_id"] for r in exact_dedup.drop_duplicates(docs, support=support).collect()} == {min(g) for g in groups.values()}


def test_exact_odd_tables(spark, none):
    assert exact_dedup.duplicate_groups(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (None, "a", "z"), (None, None, "q"), (None, "", "r")], "doc_id long, text string, digest string")
    assert exact_dedup.duplicate_groups(df).where("kept").count() == 2
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in exact_dedup.drop_duplicates(df).collect()) == [(0, ""), (1, "a")]


def plain_print(text, seed=42):
    w = WORD.findall((text or "").translate(simhash.LOWER))
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(x, seed) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s))


def plain_components(prints, budget=3):
    up = {k: k for k in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= budget:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {k: root(k) for k in prints}


@pytest.mark.parametrize("group", [200_000, 2])
def test_simhash(docs, group):
    prints = {k: plain_print(t) for k, t in texts(docs).items()}
    got = {r["doc_id"]: (r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs, group=group).collect()}
    assert {k: v[0] for k, v in got.items()} == prints
    assert {k: v[1] for k, v in got.items()} == plain_components(prints)


@pytest.mark.parametrize("group", [100_000, 50])
def test_links_lose_nothing(spark, group):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) for b in base for k in (1, 2, 3, 4, 6)], dtype=np.uint64)
    ball = np.array([base[0] ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for i in range(64) for j in range(i)], dtype=np.uint64)
    every = np.unique(np.concatenate([base, near, ball, [np.uint64(0), np.uint64(2**64 - 1)]]))
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fingerprint long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, group=group)).collect()}
    want = plain_components({int(x): int(x) for x in every})
    as_set = lambda m: {frozenset(g) for g in groups(m) if len(g) > 1}
    assert as_set({k % (1 << 64): v for k, v in found.items()}) == as_set(want)


def groups(member):
    out = collections.defaultdict(set)
    for k, v in member.items():
        out[v].add(k)
    return out.values()


def test_more_seeds_link_more(spark):
    rng = np.random.default_rng(11)
    data = []
    for k in range(40):
        w = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        data.append((2 * k, " ".join(w)))
        w[70] = "other"
        data.append((2 * k + 1, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    prints = {s: {k: plain_print(t, s) for k, t in data} for s in (42, 43, 44)}
    for seeds in ((42,), (42, 43, 44)):
        up = {k: k for k, _ in data}
        for a, b in itertools.combinations(up, 2):
            if any(bin(prints[s][a] ^ prints[s][b]).count("1") <= 3 for s in seeds):
                low, high = sorted((up[a], up[b]))
                up = {k: low if v == high else v for k, v in up.items()}
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, seeds=seeds).collect()}
        assert got == up
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(df, seeds=(42, 43, 44)).collect()} == set(up.values())


def test_chain_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_simhash_odd_tables(spark, none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0
    df = spark.createDataFrame([(3, None, "c"), (1, "", "d"), (2, "\t", "e"), (None, " ", "f"), (9, "lone text here", "g"), (9, "lone text here", "h")], "doc_id long, text string, fingerprint string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (3, 1), (9, 9), (9, 9)]


def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def test_mixing(docs):
    sizes = collections.Counter()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    words = {k: len(WORD.findall(t or "")) for k, t in texts(docs).items()}
    for k, n in words.items():
        sizes[source[k]] += n
    want = plain_targets(sizes)
    got_rows, plan, _ = mixing.mixing_plan(docs)
    got = {r["id"]: r for r in got_rows.join(plan, "key").withColumn("n", mixing.times(F.col("hash"))).collect()}
    taken = collections.Counter()
    for k, r in got.items():
        assert r["size"] == words[k] and r["target"] == pytest.approx(want[source[k]]) and r["n"] <= 3
        taken[source[k]] += r["n"] * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(n for k, n in words.items() if source[k] == s)
    mixed = collections.Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert mixed == collections.Counter({k: r["n"] for k, r in got.items() if r["n"]})


def test_mixing_is_nested_and_odd_tables(spark, none):
    assert mixing.mix(none).count() == 0
    df = spark.createDataFrame([(None, "a b", None, 1), (None, "a b", None, 2), (1, None, "s", 3), (2, "", "s", 4)], "doc_id long, text string, source string, key int")
    assert mixing.mix(df).columns == df.columns and mixing.mix(df).where("source = 's'").count() == 0


def test_packing(docs):
    model = Tokenizer.from_file(BPE)
    ids = {k: [*model.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts(docs).items()}
    got = packing.pack(docs.coalesce(1), BPE).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        piece = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(piece) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], piece))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: [x for _, p in sorted(v) for x in p] for k, v in by_doc.items()} == ids
    padding = 0
    for v in by_seq.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * sum(map(len, ids.values()))


def test_encoder_gives_the_tokenizers_ids():
    import random

    model, encode = Tokenizer.from_file(BPE), packing.Encoder(BPE, special=True)
    rnd = random.Random(0)
    some = ["".join(rnd.choice("ab'st ve,.\n\t1²Ⅷ_é日本\u3000 \xa0\x1f\x85\u0301ll 'm😀") for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    some += ["", " ", "  a", "it's 's", "<|endoftext|> a<|endoftext|>", "x" * 5000, "a  b   c\n\n d"]
    for text, want in zip(some, model.encode_batch(some, add_special_tokens=False), strict=True):
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == want.ids, text


def test_encoder_cuts_long_texts_where_ids_allow():
    import random

    model, encode = Tokenizer.from_file(BPE), packing.Encoder(BPE, segment=64, chunk=512, special=True)
    rnd = random.Random(1)
    part = lambda: rnd.choice([" ", "\n", "x", "ab", "日本", "é", "\t ", "the ", "1", "=", "😀", "\u3000", "'s", " \n"]) * rnd.randint(1, 400)
    some = ["".join(part() for _ in range(rnd.randint(1, 6))) for _ in range(500)]
    some += ["".join(rnd.choice(chars) for _ in range(5000)) + end for chars in ("abcdefghijklmnopqrstuvwxyzé日本", "\n\t \u3000\xa0", "ab1!") for end in ("", "x", " x")]
    for text, want in zip(some, model.encode_batch(some, add_special_tokens=False), strict=True):
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == want.ids, text


def test_packing_long_runs(spark):
    model = Tokenizer.from_file(BPE)
    data = [(k, t) for k, t in enumerate([" " * 2_000_000, "\n" * 1_000_000, " \n\t" * 400_000 + "x", "y" * 300_000 + " z"])]
    got = collections.defaultdict(list)
    for r in packing.pack(spark.createDataFrame(data, "doc_id int, text string"), BPE).orderBy("doc_id", "start").collect():
        got[r["doc_id"]].append(r["ids"])
    for k, t in data:
        assert np.frombuffer(b"".join(got[k]), dtype="<u4").tolist() == [*model.encode(t, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 1024, 1025, 2047, 2048, 2049, 9999])
def test_cuts(n):
    cuts = list(packing.cuts(n))
    assert sum(x for _, x in cuts) == n and all(k * x <= 2048 < (k + 1) * x or x == 2048 // k for k, x in cuts)


def test_packing_odd_tables(spark, none):
    assert packing.pack(none, BPE).count() == 0
    df = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (None, "", "z")], "doc_id long, text string, ids string")
    assert [(r["length"], r["doc_tokens"]) for r in packing.pack(df, BPE).collect()] == [(1, 1)] * 3


def plain_quality(text):
    t = text or ""
    w = WORD.findall(t)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    n, covered, seen, dups = collections.Counter(windows), set(), set(), 0
    for k, x in enumerate(windows):
        if n[x] > 1:
            covered |= {k, k + 1, k + 2}
    for line in t.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dups, len(covered)


def test_quality(docs):
    kept = quality.ledger(docs)
    m = F.col("measures")
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = kept.select("doc_id", *[m[c].alias(c) for c in cols], "failures").collect()
    for r in got:
        want = plain_quality(texts_of(docs)[r["doc_id"]])
        assert tuple(r[c] for c in cols) == want
        assert bool(r["failures"] & quality.mask("base-1")) == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    table = {r["rule"]: r for r in quality.ablations(kept, "web-1").collect()}
    masks = [r["failures"] & quality.mask("web-1") for r in got]
    for name, row in table.items():
        bit = 1 << [n for n, _ in quality.RULES].index(name)
        assert (row["failed"], row["only"], row["kept_without"]) == (sum(bool(x & bit) for x in masks), masks.count(bit), masks.count(0) + masks.count(bit))


TEXTS = {}


def texts_of(docs):
    if not TEXTS:
        TEXTS.update(texts(docs))
    return TEXTS


def test_quality_odd_tables(spark, none):
    assert quality.ledger(none).count() == 0 and quality.ablations(quality.ledger(none), "web-1").count() == 8
    df = spark.createDataFrame([(1, None, 5, "x"), (1, "a b c a b c", 6, "y")], "doc_id long, text string, measures int, _t string")
    assert quality.ledger(df).columns == ["doc_id", "text", "_t", "measures", "failures"]
    got = quality.ledger(df).orderBy("_t").collect()
    assert [r["measures"]["n_repeat_words"] for r in got] == [0, 6] and got[0]["_t"] == "x"


def test_sharding(docs):
    got = sharding.shard(docs).collect()
    want = texts(docs)
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        raw = (want[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(want) and set(load) <= set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def spark_hash(*values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v, seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_tree(points, targets, first=0, spread=None):
    """Leaf of each point (key, weight, dimensions, tie): sorted lists instead of histograms."""
    n = len(targets)
    if n == 1 or not points:
        return {key: first for key, *_ in points}
    spread = spread or [max(1, max(p[2][d] for p in points) - min(p[2][d] for p in points)) for d in range(4)]
    width = [(max(p[2][d] for p in points) - min(p[2][d] for p in points)) / spread[d] for d in range(4)]
    dim = width.index(max(width))
    points = sorted(points, key=lambda p: (p[2][dim] if max(width) else 0, p[3]))
    want, total = sum(p[1] for p in points) * sum(targets[: n // 2]) / sum(targets), 0
    for k, p in enumerate(points):
        if total + p[1] >= want:
            k += total + p[1] - want < want - total
            break
        total += p[1]
    return plain_tree(points[:k], targets[: n // 2], first, spread) | plain_tree(points[k:], targets[n // 2 :], first + n // 2, spread)


def leading(s):
    return int.from_bytes((s or "").encode()[:7].ljust(7, b"\0"), "big")


def test_sharding_is_the_tree(docs):
    data = [(r["doc_id"], (r["text"] or "").encode(), r["source"], r["lang"]) for r in docs.collect()]
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(docs).collect()}
    group = collections.defaultdict(list)
    for k, raw, source, lang in data:
        group[raw].append((k, leading(source), leading(lang)))
    total = sum((len(raw) + 8) * len(v) for raw, v in group.items())
    is_large = lambda raw, v: (len(raw) + 8) * len(v) > total / 24 / 16 or len(v) > max(1, len(data) / 1000)
    load, points = [0] * 24, []
    for raw, v in group.items():
        homes = {got[k] for k, *_ in v}
        assert len(homes) <= max(1, -(-(len(raw) + 8) * len(v) // int(total / 24)))
        if is_large(raw, v):
            for k, *_ in v:
                load[got[k]] += len(raw) + 8
        else:
            key = (len(raw) + 8, zlib.crc32(raw), signed(spark_hash(raw)))
            dims = (key[0], min(x[1] for x in v), min(x[2] for x in v), min(x[0] for x in v))
            points.append((raw, key[0] * len(v), dims, spark_hash(*key) & ((1 << 60) - 1)))
    assert points
    want = plain_tree(points, sharding.leaf_targets(load, sum(p[1] for p in points)))
    wrong = sum(p[1] for p in points if want[p[0]] != got[group[p[0]][0][0]])
    assert wrong <= 0.02 * sum(p[1] for p in points), wrong  # a split may miss its quantile by a thousandth


def test_leaf_targets():
    assert sharding.leaf_targets([0, 0, 0], 9) == [3, 3, 3] and sharding.leaf_targets([5, 0, 1], 3) == [0, 2, 1]
    assert sharding.leaf_targets([4, 4], 0) == [0, 0] and sum(sharding.leaf_targets([9, 1, 4, 0], 7)) == pytest.approx(7)
    homes, load = sharding.placed_first([(("a",), 250, 9), (("b",), 60, 2), (("c",), 60, 1)], 4, 100)
    assert sorted((k, len(of)) for k, of in homes) == [("a", 3), ("b", 1), ("c", 1)] and sum(load) >= 370 and max(load) <= 144


def test_sharding_balances_hot_rows(spark):
    rng = np.random.default_rng(2)
    data = [(k, "same text " * 20 if k % 3 == 0 else "" if k % 7 == 0 else "y" * int(rng.integers(50, 400)), "en", "hot" if k % 2 else "s", 0) for k in range(6000)]
    load, homes = collections.Counter(), collections.defaultdict(set)
    for r in sharding.shard(spark.createDataFrame(data, SCHEMA)).collect():
        load[r["shard"]] += r["size"]
        homes[r["size"], r["text_crc32"]].add(r["shard"])
    mean = sum(load.values()) / 24
    assert len(load) == 24 and max(load.values()) < 1.03 * mean and min(load.values()) > 0.97 * mean
    # only the group above a shard's share is in several
    assert [k for k, v in homes.items() if len(v) > 1] == [(208, zlib.crc32(b"same text " * 20))]


def test_sharding_odd_tables(spark, none):
    assert sharding.shard(none).count() == 0
    df = spark.createDataFrame([(1, None, None, None, "a"), (1, None, None, None, "b"), (None, "x", None, None, "c")], "doc_id long, text string, lang string, source string, shard string")
    assert sharding.shard(df).count() == 3
    same = spark.createDataFrame([(None, "x", None, None), (7, "x", None, None)] * 3000, "doc_id long, text string, lang string, source string")
    got = sharding.shard(same).collect()
    assert {(r["shard"], r["slot"]) for r in got} == {(s, k) for s in {r["shard"] for r in got} for k in range(sum(r["shard"] == s for r in got))}
    assert {sum(r["shard"] == s for r in got) for s in range(24)} <= set(range(200, 301))


def test_language(spark, none):
    rng = np.random.default_rng(4)
    parts = {"aa": ["the", "shing", "ould", "ther"], "bb": ["ßen", "ich", "ung", "ätz"], "cc": ["ción", "ñar", "llo", "ida"]}
    data = [(k, " ".join("".join(rng.choice(parts[g], 2)) for _ in range(30)), g, "s", 0) for k in range(240) for g in [list(parts)[k % 3]]]
    data += [(1000, None, "aa", "s", 0), (1001, "123 ...", "aa", "s", 0), (1002, "the shing " * 100_000, None, "s", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df)).collect()}
    truth = {k: g for k, _, g, _, _ in data}
    out = [k for k in range(240) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert out and all(got[k]["lang_pred"] == truth[k] for k in out)
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1002]["lang_pred"] == "aa"
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    unlearnt = langid.identify(df, langid.fit(none))
    assert unlearnt.where("lang_pred <> 'und'").count() == 0 and langid.identify(none, langid.fit(df)).count() == 0


def test_kernel_is_the_shared_grams_of_texts():
    """The hashed kernel against sets of letter n-grams, on texts of common lengths."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefghij éß.,"), int(n))) for n in rng.integers(20, 400, 60)]

    def grams(t):
        clean = "".join(c if c.isalpha() else " " for c in t.lower())
        return {clean[k : k + n] for n in (1, 2, 3) for k in range(len(clean) - n + 1)}

    bits, _ = langid.presence(texts, langid.letters())
    unit = bits / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1))
    got = langid.kernel(bits, unit.astype(np.float32))
    sets = [grams(t) for t in texts]
    want = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert np.abs(got - want).max() < 0.12 and np.abs(got - want).mean() < 0.03


def test_language_odd_tables(spark):
    data = [(k, f"the shing {k % 7} ould" if k % 2 else f"ßen ung {k % 5} ätz", "aa" if k % 2 else "bb", "x") for k in [*range(60), *range(60)]] + [(1, None, None, None), (None, "ung", "bb", "y")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, Lang_Pred string")
    model = langid.fit(df, per_lang=3)
    got = langid.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score"] and model[0] == ["aa", "bb"]
    assert got.where("text is not null and lang_pred <> lang").count() == 0 and got.count() == len(data)


def test_language_segments():
    alpha = langid.letters()
    text = "abc défg " * 80_000
    whole, _ = langid.presence([text], alpha)
    short, _ = langid.presence(["abc défg abc défg "], alpha)
    assert (whole == short).all()


def test_held_out(spark):
    got = [r[0] for r in spark.range(200).select(held_out(F.col("id"))).collect()]
    assert got == [zlib.crc32(str(k).encode()) % 4 == 2 for k in range(200)]


def test_grammar():
    s = toxicity.Scorer({})
    clause = lambda t: s.clause(toxicity.WORD.findall(t))
    assert clause("you are an idiot") > clause("an idiot") > toxicity.MATCH > 0 > clause("not an idiot")
    assert clause("she said you are an idiot") < toxicity.MATCH < clause("you are an idiot")
    assert clause("i will kill you") > toxicity.MATCH > clause("i will kill time") and clause("a fine day") == 0
    assert clause("idiot and moron") > 2 * clause("idiot") and s.matches("not an idiot. an idiot")[1] == 2


def plain_arc(kind, before, symbol):
    """The weight that one transducer gives a symbol, from the symbols before it."""
    w, reach = toxicity.WEIGHTS, toxicity.REACH
    recent = lambda s, n: s in before[max(0, len(before) - n) :]
    strong = symbol in (toxicity.INSULT, toxicity.THREAT)
    if kind in ("target", "negation", "report"):
        mark = {"target": toxicity.TARGET, "negation": toxicity.NEGATION, "report": toxicity.REPORT}[kind]
        return w[{"target": "target", "negation": "negated", "report": "reported"}[kind]] if strong and recent(mark, reach[kind]) else 0.0
    own = toxicity.INSULT if kind == "insult" else toxicity.THREAT
    last = max((k for k, s in enumerate(before) if s == own), default=None)
    waits = last is not None and len(before) - last <= reach[kind] and toxicity.TARGET not in before[last:]
    if symbol == toxicity.TARGET:
        return w[f"{kind}_target"] if waits else 0.0
    return 0.0 if symbol != own else w["threat"] if kind == "threat" else w["again"] if waits else 0.0


def test_composed_grammar_adds_up_its_parts():
    rng = np.random.default_rng(8)
    parts, whole = toxicity.transducers(), toxicity.grammar()
    assert set(parts) == {"insult", "threat", "target", "negation", "report"}
    for _ in range(400):
        symbols = rng.choice(6, int(rng.integers(1, 30)), p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1]).tolist()
        each = {k: sum(plain_arc(k, symbols[:i], s) for i, s in enumerate(symbols)) for k in parts}
        assert {k: t.path(symbols) for k, t in parts.items()} == pytest.approx(each)
        assert whole.path(symbols) == pytest.approx(sum(each.values()))


def test_grammar_flips_predictions(spark):
    """A word of every text that is only toxic with a target near, and neither negated nor reported: its clause decides."""
    rng = np.random.default_rng(3)
    plain = ["lana", "mortis", "quondam", "senti", "verbatim"]
    data, labels = [], []
    frames = {"you idiot": 1, "idiot": 0, "never idiot": 0, "she said you idiot": 0}
    for k in range(800):
        frame, toxic = list(frames.items())[k % 4]
        lead = " ".join(rng.choice(plain, 10))
        data.append((k, f"{lead}. {frame} near lana. {lead}. {frame} near."))
        labels.append((k, toxic))
    df, known = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
    wrong = lambda w: sum((r["toxicity"] >= 0.5) != dict(labels)[r["doc_id"]] for r in toxicity.score(df, model, weights=w).collect() if held(r))
    assert wrong(toxicity.WEIGHTS) == 0
    assert wrong({k: 0.0 for k in toxicity.WEIGHTS}) > 40


def test_toxicity_odd_tables(spark):
    known = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    data = [(k, f"plain words {k}. a gruffle one" if k % 2 else f"plain words {k}.", 0.25) for k in [*range(100), *range(100)]] + [(7, None, None), (None, "x", 1.0)]
    df = spark.createDataFrame(data, "doc_id long, text string, Toxicity double")
    first, again = toxicity.fit(df, known), toxicity.fit(df.orderBy(F.rand(1)), known)
    assert first[0] == again[0] and first[1] == pytest.approx(again[1])
    got = toxicity.score(df, first)
    assert got.columns == ["doc_id", "text", "toxicity"] and got.count() == len(data)
    kept = toxicity.drop_toxic(df, first)
    assert kept.columns == df.columns and kept.where("text like '%gruffle%'").count() == 0 and kept.count() == 102


def test_toxicity(spark, none):
    rng = np.random.default_rng(6)
    plain = ["lana", "mortis", "quondam", "senti", "verbatim", "longer", "words"]
    data, labels = [], []
    for k in range(600):
        w = list(rng.choice(plain, 60))
        if k % 6 == 0:
            for p in rng.integers(0, 60, 4):
                w[p] = ["grubwort", "grubling", "grubnix", "snarkle"][int(rng.integers(4))]
        data.append((k, " ".join(w) + ".", "en", "s", 0))
        labels.append((k, int(k % 6 == 0)))
    data += [(1000, None, None, None, 0), (1001, "", None, None, 0)]
    df, known = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(df, toxicity.fit(df, known)).collect()}
    out = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all((got[k] >= 0.3) == (k % 6 == 0) for k in out)
    assert got[1000] == got[1001] == min(got.values()) and all(0 <= x <= 1 for x in got.values())
    assert toxicity.score(none, toxicity.fit(none, known)).count() == 0
    unlearnt = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(df, unlearnt).count() == len(data)


def plain_scan(text, templates=license_scan.TEMPLATES, least=0.8):
    """(template, dice, start) of the best window of each template that matches, all windows tried."""
    w = license_scan.words_of(text or "")
    out = []
    for k, (_, t) in enumerate(templates):
        n, own = len(license_scan.words_of(t)), set(license_scan.bigrams(t))
        best = (0.0, 0)
        for start in range(max(0, len(w) - 1)):
            seen = set(zip(w[start : start + n], w[start + 1 : start + n], strict=False))
            seen = {f"{a} {b}" for a, b in seen}
            dice = 2 * len(own & seen) / (len(own) + len(seen))
            # of equal windows the first that begins with a bigram of the template
            if dice > best[0] or (dice == best[0] > 0 and best[1] is None):
                best = dice, start if f"{w[start]} {w[start + 1]}" in own else None
        if best[0] >= least:
            out.append((k, best[0], best[1]))
    return out


def license_texts():
    """Each template whole, wrapped, inside a longer line, and with words changed, dropped and added."""
    rng = np.random.default_rng(12)
    out = []
    for k, (_, t) in enumerate(license_scan.TEMPLATES):
        w = t.split()
        out.append("intro words " + t + " and more words after it")
        out.append("# a header\n" + "\n".join(" * " + " ".join(w[i : i + 7]) for i in range(0, len(w), 7)) + "\nclosing line")
        edited = list(w)
        for _ in range(1 + len(w) // 20):
            at = int(rng.integers(len(edited)))
            edited[at : at + int(rng.integers(2))] = ["other"] * int(rng.integers(1, 3))
        out.append("before it " + " ".join(edited) + " behind it")
    return [*out, None, "", " ", "license", "no licence in this text at all", "released   UNDER the MIT license!", license_scan.TEMPLATES[0][1] * 40]


def test_licenses_are_the_best_windows(spark, none):
    data = list(enumerate(license_texts()))
    got = {r["doc_id"]: [(x["template"], x["dice"], x["start"]) for x in r["licenses"]] for r in license_scan.scan(spark.createDataFrame(data, "doc_id int, text string")).collect()}
    edited = 0
    for k, t in data:
        want = plain_scan(t)
        assert [x[0] for x in got[k]] == [x[0] for x in want], k
        for (_, d, s), (_, e, z) in zip(got[k], want, strict=True):
            assert d == pytest.approx(e) and s == z, k
            edited += d < 1
    assert edited > 30
    length = lambda k: len(license_scan.words_of(license_scan.TEMPLATES[k][1]))
    names = [license_scan.TEMPLATES[-max((d, length(k), -k) for k, d, _ in got[3 * n])[2]][0] for n in range(len(license_scan.TEMPLATES))]
    assert names == [n for n, _ in license_scan.TEMPLATES]
    assert license_scan.scan(none).count() == 0


def test_licenses_against_sql(spark):
    import duckdb
    import pyarrow as pa

    data = [(k, t) for k, t in enumerate(license_texts())]
    df = spark.createDataFrame(data, "doc_id long, text string")
    documents = pa.table({"doc_id": [k for k, _ in data], "text": [t for _, t in data]})  # noqa: F841
    want = {r[0]: r[1:] for r in duckdb.sql(license_scan.OP1_SQL).fetchall()}
    got = {r["doc_id"]: (r["license"], r["dice"], r["start"], r["n_matches"]) for r in license_scan.best_license(license_scan.scan(df)).collect()}
    assert got == want


def test_licenses_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "x", 2.0), (1, None, "y", None)], "doc_id int, text string, Licenses string, `w.t` double")
    got = license_scan.scan(df)
    assert got.columns == ["doc_id", "text", "w.t", "licenses"] and sorted(len(r["licenses"]) for r in got.collect()) == [0, 2]


def test_license_bounds_prune_no_match():
    for a in range(1, 60):
        most = lambda m: max(2 * m / (a + b) for b in range(m, 200))  # noqa: B023, E731
        assert license_scan.least_shared(a, 0.8) == min(m for m in range(1, a + 1) if most(m) >= 0.8 - 1e-12)


RULES = [("http://x.NET/a", "x.net", "/a", "net/", "block"), ("http://x.net", "x.net", "", None, None), ("https://a.example.net/en/1?q", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.com/de/#x", "example.com", "/de/", "example.com/de/", "block"), ("x://w.org/fr/", "w.org", "/fr/", "org/fr/", "allow"), ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("nothing", "", "", None, None), (None, "", "", None, None)]


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u, None) for k, (u, *_) in enumerate(RULES)], "page_id int, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(RULES):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule) and got[k]["verdict"] == (verdict or "allow")


def test_link_propagation(spark, none):
    a = lambda h: f'<a href="http://{h}/">x</a>'
    data = [(1, "http://bad.net/p", ""), (2, "http://near.com/", a("bad.net")), (3, "http://far.com/", a("near.com")), (4, "http://good.org/fr/x", a("fine.com") + a("Both.com")), (5, "http://fine.com/", a("other.com")), (6, "http://other.com/", ""), (7, "http://both.com/q", a("bad.net") + a("other.com") * 9)]
    df = spark.createDataFrame(data, "page_id int, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge(df, rounds=4).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    assert url_filter.judge(none.selectExpr("doc_id page_id", "text url", "lang html")).count() == 0


def plain_rank(edges, seeds, rounds, damping=0.85):
    """Personalised PageRank over weighted edges, without the seeds' own part; dangling rank goes to the seeds."""
    out = collections.Counter()
    for (x, _), n in edges.items():
        out[x] += n
    rank, got = dict(seeds), {}
    for _ in range(rounds):
        got = collections.Counter()
        for (x, y), n in edges.items():
            got[y] += damping * rank.get(x, 0.0) * n / out[x]
        left = 1 - sum(got.values())
        rank = {h: got[h] + left * seeds.get(h, 0.0) for h in {*got, *seeds}}
    return got


@pytest.mark.parametrize("bound,rounds", [(32 << 20, 5), (0, 2)])
def test_trust_and_distrust(spark, monkeypatch, bound, rounds):
    import twinfold.operators.shared as shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", bound)
    rng = np.random.default_rng(7)
    hosts = [f"h{k}.{'net' if k % 5 == 0 else 'org' if k % 5 == 1 else 'com'}" for k in range(25)]
    pages, edges, said = [], collections.Counter(), collections.defaultdict(list)
    for k in range(200):
        h = hosts[int(rng.integers(25)) if k % 3 else 2]
        path = ["/fr/x", "/x"][int(rng.integers(2))]
        links = [hosts[int(x)] for x in rng.integers(0, 25, int(rng.integers(0, 3)))] if h not in hosts[20:] else []
        html = "".join(f"<a class='q' href='http://{x}/'>x</a>" for x in links) + "<!-- <a href='http://h1.org/'> --><script src='//h1.org/a.js'></script><img src='http://h1.org/'>"
        pages.append((k, f"http://{h}{path}", html))
        edges.update((h, x) for x in links if x != h)
        said[h].append("block" if h.endswith(".net") else "allow" if h.endswith(".org") and path == "/fr/x" else None)
    pages += [(200, None, None), (201, "none", "")]
    seeds = {}
    for verdict in ("allow", "block"):
        part = {h: v.count(verdict) / len(v) for h, v in said.items() if verdict in v}
        seeds[verdict] = {h: x / sum(part.values()) for h, x in part.items()}
    trust, distrust = plain_rank(edges, seeds["allow"], rounds), plain_rank({(y, x): n for (x, y), n in edges.items()}, seeds["block"], rounds)
    got = url_filter.judge(spark.createDataFrame(pages, "page_id int, url string, html string"), rounds=rounds).collect()
    assert len(got) == len(pages)
    for r in got:
        if r["rule"] is None and r["host"]:
            assert r["trust"] == pytest.approx(trust.get(r["host"], 0.0), abs=1e-9) and r["distrust"] == pytest.approx(distrust.get(r["host"], 0.0), abs=1e-9)
            assert r["verdict"] == ("block" if r["distrust"] > r["trust"] else "allow")
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


def test_propagation_converges(spark):
    edges = spark.createDataFrame([("t", "a", "b", 1), ("t", "b", "c", 3), ("t", "b", "a", 1), ("u", "a", "c", 1)], "kind string, src string, dst string, n long")
    seeds = spark.createDataFrame([("t", "a", 0.5), ("t", "b", 0.5), ("u", "a", 1.0)], "kind string, host string, seed double")
    got = {(r["kind"], r["host"]): r["inherited"] for r in url_filter.propagate(edges, seeds, tolerance=0.01).collect()}
    far = plain_rank({("a", "b"): 1, ("b", "c"): 3, ("b", "a"): 1}, {"a": 0.5, "b": 0.5}, 200)
    assert {h: got["t", h] for h in "abc"} == pytest.approx({h: far[h] for h in "abc"}, abs=0.02)
    assert got["u", "c"] == pytest.approx(0.85 / 1.85, abs=0.02)


def test_other_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "a b", "s", "q", 1, 2, 3), (1, "a b", "s", "r", 3, 4, 5), (2, "c d e", "t", "z", 5, 6, 7)], "doc_id long, text string, source string, row string, key int, hash int, id int")
    assert sorted(map(tuple, exact_dedup.drop_duplicates(df).drop("row", "key", "hash", "id").collect())) == [(1, "a b", "s"), (2, "c d e", "t")]
    assert set(map(tuple, mixing.mix(df).collect())) <= set(map(tuple, df.collect()))
    assert sorted(map(tuple, quality.ledger(df).select(df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, license_scan.scan(df).select(df.columns).collect())) == sorted(map(tuple, df.collect()))
