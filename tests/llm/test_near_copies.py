import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import near_copies, simhash
from quire.session import Scratch


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """The ids of rows (doc_id, text) that stay, by comparing all pairs."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            shared = len(sets[i] & sets[j])
            if i < j and 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(i for i in root if find(i) == i)


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def test_the_stage_catches_edited_copies(spark):
    rng, rows = random.Random(3), []
    for length, changed in ((500, 4), (500, 8), (200, 1), (200, 4), (200, 12)) * 12:
        words = [f"w{rng.randrange(5000)}" for _ in range(length)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, edited(rng, words, changed))]
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert got == kept(rows) and len(got) < 0.65 * len(rows)


def test_great_groups_and_hard_rows(spark, hard_docs, hard_rows):
    rng = random.Random(4)
    words, passage = [f"w{rng.randrange(5000)}" for _ in range(200)], " ".join(f"p{i}" for i in range(20))
    rows = [(i, edited(rng, words, 3)) for i in range(60)]
    rows += [(i, passage + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(100))) for i in range(60, 120)]
    got = near_copies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)
    got = near_copies.deduplicate(hard_docs)
    assert got.columns == hard_docs.columns
    wordless = [r[0] for r in hard_rows if not (r[1] or "").encode().split()]
    assert sorted(r.doc_id for r in got.collect()) == sorted([wordless[0]] + kept([(r[0], r[1]) for r in hard_rows if r[0] not in wordless]))


def test_frequent_shingles_and_small_sets(spark):
    """Documents mostly of shared passages, in clusters and not: short of rare shingles, so that their whole sets decide."""
    rng = random.Random(8)
    passages = [[f"q{k}x{i}" for i in range(40)] for k in range(4)]
    rows = []
    for i in range(90):
        words = [w for k in rng.sample(range(4), 3) for w in passages[k]] + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice((2, 8, 20, 60)))]
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(rng.choice(passages)[: rng.randint(3, 9)])) for i in range(60)]
    got = near_copies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(9)
    for n, changed in ((0, 0), (5, 1), (200, 10), (200, 190), (4000, 700)):
        base = rng.integers(-(2**62), 2**62, n)
        other = np.concatenate((base[: n - changed], rng.integers(-(2**62), 2**62, changed)))
        a, b = near_copies._unique(base), near_copies._unique(other)
        bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in near_copies.signature(a) ^ near_copies.signature(b))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))
        assert not changed or bits > 0


def test_near_misses_give_no_rows(spark):
    """A group whose texts share half of their words: every pair shares shingles, none is alike, and the join lets none through."""
    rng = np.random.default_rng(4)
    common = [f"c{i}" for i in range(100)]
    rows = [(i, " ".join(common + [f"w{x}" for x in rng.integers(0, 10**9, 60)])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables = Scratch(spark, "misses")
    sets = near_copies.shingle_sets(docs).groupBy("name").agg(*[F.first(c).alias(c) for c in ("id", "_k", "n", "least", "fp", "sig")])
    shared = near_copies.prefix_rows(docs, sets, tables)
    none = spark.createDataFrame([], "a binary, b binary")
    assert near_copies.apart(sets, shared, simhash.components(none)).count() == 0
    assert near_copies.deduplicate(docs).count() == 120


def test_signatures_of_long_sets_tell_near_misses_apart():
    """Sets of 4,000 shingles of which a quarter differ: 512 bits are the same as chance, one to two bits a shingle prove it."""
    rng = np.random.default_rng(10)
    base = rng.integers(-(2**62), 2**62, 4000)
    other = np.concatenate((base[:3000], rng.integers(-(2**62), 2**62, 1000)))
    a, b = (near_copies.signature(near_copies._unique(x)) for x in (base, other))
    bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in a ^ b)
    assert 9 * bits > 8000


def test_pairs_of_unlike_lengths_keep_their_links(spark):
    """Chains around the lengths at which signatures double, in groups where the least set is unlike the rest; the join gives few rows a pair."""
    rng, rows = random.Random(11), []
    for length in (505, 512, 1024, 1030):
        words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        for k in range(10):
            cut = rng.randrange(0, length // 12)
            rows.append((len(rows), " ".join(edited(rng, words, rng.choice((0, 3, 9))).split()[cut:])))
        rows += [(len(rows) + k, " ".join(words[: length // 3] + [f"v{rng.randrange(10**6)}" for _ in range(length // 3)])) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.deduplicate(docs).collect()) == kept(rows)
    tables = Scratch(spark, "few-rows")
    sets = near_copies.shingle_sets(docs).groupBy("name").agg(*[F.first(c).alias(c) for c in ("id", "_k", "n", "least", "fp", "sig")])
    shared = tables.keep(near_copies.prefix_rows(docs, sets, tables), "s")
    none = spark.createDataFrame([], "a binary, b binary")
    found = {(r.a, r.b) for r in near_copies.apart(sets, shared, simhash.components(none)).union(near_copies.starred(shared)).collect()}
    ids = {i: near_copies._id(near_copies._name(near_copies.shingle_set(t.encode()))) for i, t in rows}
    for i, t in rows:
        for j, u in rows:
            x, y = shingles(t), shingles(u)
            if i < j and ids[i] != ids[j] and 5 * len(x & y) >= 4 * len(x | y):
                assert tuple(sorted((ids[i], ids[j]))) in found  # by the least set or by the join, whatever the components
