import itertools

import numpy as np
import pytest

from twinfold.operators import near
from twinfold.plans import align_books as plan


def plain_sets(data):
    out = {}
    for k, text in data:
        w = (text or "").lower().split()
        out[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def similarity(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


@pytest.fixture(scope="module")
def data():
    """Texts, copies with up to six changed words, a large group of copies, a chain and odd texts."""
    rng = np.random.default_rng(3)
    out = []
    for base in range(30):
        w = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(30, 250)))]
        out.append(" ".join(w))
        for changes in (1, 2, 4, 6):
            v = list(w)
            for at in rng.integers(0, len(v), changes):
                v[at] = f"c{rng.integers(1000)}"
            out.append(" ".join(v))
    w = [f"h{x}" for x in range(150)]
    out += [" ".join([*w[:k], "other", *w[k + 1 :]]) for k in range(0, 150, 2)]
    w = [f"k{x}" for x in range(200)]
    out += [" ".join(w[k : k + 120]) for k in range(0, 80, 8)]
    out += [None, "", " \t", "one", "One", "one two three four", "one two three four five"]
    rng.shuffle(out)
    return list(enumerate(out))


def test_no_two_near_texts_stay(spark, data):
    sets = plain_sets(data)
    kept = {r["doc_id"] for r in near.drop_near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if similarity(sets[a], sets[b]) >= 0.8]
    assert len(pairs) > 1000 and not [p for p in pairs if set(p) <= kept]
    # none is lost that is near to a lost one only
    assert all(any(similarity(sets[k], sets[j]) >= 0.8 for j in kept) for k in set(sets) - kept)


def test_a_chain_keeps_what_is_far_from_its_first(spark):
    w = [f"k{x}" for x in range(200)]
    chain = [(k, " ".join(w[8 * k : 8 * k + 120])) for k in range(7)]
    sets = plain_sets(chain)
    assert similarity(sets[0], sets[1]) >= 0.8 > similarity(sets[0], sets[2])
    kept = {r["doc_id"] for r in near.drop_near_copies(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert kept == {0, 2, 4, 6}


def test_groups_across_are_the_components(spark, data):
    sets = plain_sets(data)
    root = {k: k for k in sets}
    for a, b in itertools.combinations(sets, 2):
        if similarity(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    got = {r["id"]: r["group_id"] for r in near.groups(spark.createDataFrame(data, "doc_id long, text string"), across=True).collect()}
    assert got == root


def test_far_texts_of_one_bucket_stay(spark):
    texts = [(k, " ".join(f"a{k}x{i}" for i in range(40))) for k in range(5)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    same = spark.createDataFrame([(k, 1) for k in range(5)], "id long, bucket long")
    assert near.drop_near_copies(df, more=same).count() == 5
    assert near.drop_near_copies(df.limit(0)).count() == 0


def test_word_hashes_follow_the_words(monkeypatch):
    texts = ["", " \n", "a", "A b", "one two", "onetwo", "\u00c4 \u00e4 x\u0000y", " Long" * 3000, "w" * 9000 + " end", *(" ".join(f"W{k % m}" for k in range(4000)) for m in (7, 3999))]
    cut = near.Shingles()
    whole = [cut.of(t) for t in texts]
    seen = {}
    for t, h in zip(texts, whole, strict=True):
        plain = plain_sets([(0, "".join(c.lower() if c.isascii() else c for c in t))])[0]
        assert len(h) == len(plain)
        seen.setdefault(frozenset(plain), h.tobytes())
    assert len(set(seen.values())) == len(seen)
    monkeypatch.setattr(near, "CHUNK", 100)
    assert all((near.Shingles().of(t) == h).all() for t, h in zip(texts, whole, strict=True))


def test_first_keys_of_near_sets_meet():
    """Any two near sets share a key that the length filter keeps, whatever the counts."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        levels = near.levels_of(rng.integers(0, 50, 64))
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 80)), dtype=np.uint64))
        other = np.unique(np.concatenate([base[: max(1, int(len(base) * rng.uniform(0.8, 1)))], rng.integers(0, 1 << 63, int(rng.integers(0, 10)), dtype=np.uint64)]))
        x, y = set(base.tolist()), set(other.tolist())
        if similarity(x, y) < 0.8:
            continue
        a, b = (near.first_keys(s, levels, 0.8).tolist() for s in (base, other))
        rest = [min(len(base) - a.index(k), len(other) - b.index(k)) for k in set(a) & set(b)]
        assert max(rest) >= 0.8 / 1.8 * (len(base) + len(other)) - 1e-6


def test_a_shared_passage_puts_no_texts_together(spark):
    """Texts that share half their words meet in no bucket; copies of one of them still do."""
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([*passage, *(f"a{k}x{i}" for i in range(60))]) for k in range(40)]
    texts.append(texts[7] + " more")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = near.Candidates(df, "doc_id", "text", None, near.SHINGLE, near.LEAST)
    assert {r["node"] for r in some.shared.select("node").distinct().collect()} == {7, 40}
    assert near.drop_near_copies(df).count() == 40


def test_versions_are_near_copies_of_whole_texts(spark):
    w = [f"w{k}" for k in range(100)]
    rest = " ".join(w)
    books = [(1, "Title\n" + rest), (2, "Another title\n" + rest), (3, "Title\nsomething else"), (4, "Title\n" + rest), (5, "Title\n" + rest.upper()), (6, None)]
    found = plan.near_version_jobs(spark.createDataFrame(books, "book_id int, text string"))
    assert sorted(tuple(r) for r in found.collect()) == [("1-2", 1, 2), ("1-5", 1, 5)]


def test_bitmaps_bound_what_sets_share():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 63, int(n), dtype=np.uint64)) for n in rng.integers(0, 3000, 30)]
    sets += [np.unique(np.concatenate([s[: int(0.9 * len(s))], rng.integers(0, 1 << 63, len(s) // 20, dtype=np.uint64)])) for s in sets]
    pairs = list(itertools.product(range(len(sets)), repeat=2))
    maps = [near.bitmap(s) for s in sets]
    only = near.missing([maps[a] for a, _ in pairs], [maps[b] for _, b in pairs])
    exact = np.array([[len(np.setdiff1d(sets[a], sets[b])), len(np.setdiff1d(sets[b], sets[a]))] for a, b in pairs]).T
    assert (only[0] <= exact[0]).all() and (only[1] <= exact[1]).all()


def test_far_texts_of_one_bucket_are_not_sent(spark, monkeypatch):
    """Forty texts with one rare shingle meet in a bucket; no text of them goes to a comparison, in either way of grouping."""
    texts = [" ".join([*(f"a{k}x{i}" for i in range(60)), "one", "rare", "turn", "of", "phrase"]) for k in range(40)]
    texts.append(texts[7] + " more")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sent, checked = [], near.checked

    def counted(pairs, *args):
        sent.extend((r["a"], r["b"]) for r in pairs.select("a", "b").collect())
        return checked(pairs, *args)

    monkeypatch.setattr(near, "checked", counted)
    monkeypatch.setattr(near, "first_keys", lambda hashes, levels, least: np.unique(hashes >> np.uint64(16)).view(np.int64))
    assert near.drop_near_copies(df).count() == 40
    assert near.groups(df, across=True).select("group_id").distinct().count() == 40
    assert set(sent) == {(7, 40)}


def test_simhash_links_reach_copies_by_repeats(spark):
    """One long passage again and again, with different ends: sets of shingles are far, SimHash and the shingles with repeats are near."""
    import corpus_pipeline

    passage = " ".join(f"p{k}" for k in range(21))
    texts = [" ".join([passage] * 200 + [f"e{k}x{i}" for i in range(40)]) for k in range(3)]
    texts += [" ".join(f"f{k}x{i}" for i in range(40)) for k in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = plain_sets(enumerate(texts))
    assert similarity(sets[0], sets[1]) < 0.5
    assert near.drop_near_copies(df).count() == 6
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == {0, 3, 4, 5}


def test_keys_of_sets_that_cannot_be_near_go_first(spark):
    """A key stays when a set of its bucket may be near to its own, in either order of sizes; of far sizes it goes."""
    rng = np.random.default_rng(4)
    rows = []
    for bucket in range(300):
        sizes = rng.integers(5, 60, int(rng.integers(1, 7)))
        rows += [(len(rows) + k, bucket, int(rng.integers(0, n // 4 + 1)), int(n)) for k, n in enumerate(sizes)]
    can = lambda x, y: min(x[3] - x[2], y[3] - y[2]) >= 0.8 / 1.8 * (x[3] + y[3]) - 1e-6
    need = {x[0] for x in rows if any(x[1] == y[1] and x[0] != y[0] and can(x, y) for y in rows)}
    kept = {r["node"] for r in near.meeting(spark.createDataFrame(rows, "node long, bucket long, pos int, size long")).collect()}
    assert need and need <= kept and len(kept) < len(rows) / 1.2


def test_a_rare_phrase_puts_no_texts_of_far_sizes_together(spark, monkeypatch):
    """Texts of 20, 40, 80, ... words with one rare phrase have no bucket, copies of one of them do."""
    phrase = "one rare turn of phrase"
    texts = [" ".join([phrase, *(f"a{k}x{i}" for i in range(20 << k))]) for k in range(6)]
    texts.append(texts[3] + " more")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near, "first_keys", lambda hashes, levels, least: np.unique(hashes >> np.uint64(16)).view(np.int64))
    some = near.Candidates(df, "doc_id", "text", None, near.SHINGLE, near.LEAST)
    assert {r["node"] for r in some.shared.select("node").distinct().collect()} == {3, 6}
    assert near.drop_near_copies(df).count() == 6


def test_rounds_end_at_once_when_few_pairs_are_left(spark):
    few = spark.createDataFrame([(b, n) for b in range(50) for n in range(3)], "bucket long, node long")
    many = spark.createDataFrame([(0, n) for n in range(200)], "bucket long, node long")
    assert near.more_heads(1, few, few) is None
    assert near.more_heads(8, many, many) == 8 * near.HEADS
