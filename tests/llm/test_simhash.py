import random
import re

import numpy as np
import xxhash

from quire.llm import simhash


def brute(text):
    text = (text or "").encode()
    text = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def expected(rows):
    fps = {i: brute(t) for i, t in rows}
    of = classes(set(fps.values()))
    low = {}
    for i in sorted(fps, reverse=True):
        low[of[fps[i]]] = i
    return {i: (f"{f:016x}", low[of[f]]) for i, f in fps.items()}


def test_hard_rows_against_brute_force(hard_docs, hard_rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(hard_docs).collect()}
    assert got == expected([(r[0], r[1]) for r in hard_rows])


def test_chains_of_links_are_whole(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(25):  # chains in which each next value differs by one or two bits, and lone values
        value = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            values.add(value)
            for _ in range(rng.randint(1, 2)):
                value ^= 1 << rng.randrange(64)
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    got = {np.int64(r.node).astype(np.uint64).item(): r.root for r in simhash.components(edges).collect()}
    want = classes(values)
    together = {}
    for v in values:
        together.setdefault(want[v], []).append(v)
    for group in together.values():
        if len(group) > 1:
            assert len({got.get(v, int(np.uint64(v).astype(np.int64))) for v in group}) == 1
        else:
            assert group[0] not in got
    assert len(set(got.values())) == sum(len(g) > 1 for g in together.values())


def test_radius_one(spark):
    edges = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(0,), (1,), (3,), (8,)], "fp long"), 1).collect()}
    assert edges == {(0, 1), (1, 3), (0, 8)}


def test_deduplicate_keeps_one_of_each_group(spark, hard_docs, hard_rows):
    kept = simhash.deduplicate(hard_docs)
    assert kept.columns == hard_docs.columns
    want = {c for _, c in expected([(r[0], r[1]) for r in hard_rows]).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_nulls_copies_and_clashing_names(spark, no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    rows = [(None, "a b c d", 1), (None, "a b c d", 1), (4, "a b c d", 2), (4, "a b c d", 2), (None, "q r s t u v", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k int")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 4), (-1, 4), (4, 4), (4, 4)]
    assert sorted((r.doc_id or -1, r.text, r._k) for r in simhash.deduplicate(docs).collect()) == [(-1, "q r s t u v", 3), (4, "a b c d", 2)]
