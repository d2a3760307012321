import hashlib
import random
import re

import pytest

from quire.llm import substring_dedup


def brute(texts, window):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    starts = {}
    for d, ws in enumerate(words):
        for i in range(len(ws) - window + 1):
            starts.setdefault(tuple(ws[i : i + window]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    kept = [[w for i, w in enumerate(ws) if i not in gone[d]] for d, ws in enumerate(words)]
    return [(len(ws), len(gone[d]), hashlib.sha256(b" ".join(kept[d])).hexdigest()) for d, ws in enumerate(words)]


def planted(seed):
    """Documents that share passages of many lengths at many places, with small edits, in repetition and at the ends."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz ") .strip() + str(rng.randrange(40))
    passages = [[word() for _ in range(n)] for n in (20, 34, 35, 36, 40, 52, 70, 120)]
    texts = []
    for _ in range(70):
        ws = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            p = p if rng.random() < 0.5 else p[a:b]
            if p and rng.random() < 0.4:
                p[rng.randrange(len(p))] = word()
            at = rng.randint(0, len(ws))
            ws[at:at] = p
        texts.append(rng.choice((" ", "\n", " \t ")).join(ws))
    texts += [" ".join(["und"] * 90), " ".join(["a", "b"] * 30), texts[3], texts[3], None, "", " ".join(passages[2]), " ".join(passages[2][:34])]
    return texts


@pytest.mark.parametrize("window,first", [(35, 9), (12, 4)])
def test_planted_passages_against_brute_force(spark, window, first):
    texts = planted(window)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removals(docs, window, first).collect()}
    for i, want in enumerate(brute(texts, window)):
        assert got[i] == want, i


def test_hard_rows(hard_docs, hard_rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removals(hard_docs).collect()}
    assert got == {r[0]: w for r, w in zip(hard_rows, brute([r[1] for r in hard_rows], 35))}


def test_text_is_cut_and_columns_stay(spark, no_docs):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"first  line\n{passage}\n\nlast", 7, "x"), (None, passage, None, "y"), (2, "short", 1, None), (3, None, 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k int, _hits string")
    got = {r.doc_id: tuple(r) for r in substring_dedup.deduplicate(docs).collect()}
    assert got == {1: (1, "first  line\nlast", 7, "x"), None: (None, "", None, "y"), 2: (2, "short", 1, None), 3: (3, None, 2, "z")}
    assert substring_dedup.deduplicate(no_docs).count() == 0 == substring_dedup.removals(no_docs).count()
    same = spark.createDataFrame([(5, passage), (5, passage)], "doc_id long, text string")
    assert [(r.n_words, r.n_removed) for r in substring_dedup.removals(same).collect()] == [(40, 40)] * 2


def test_large_groups_of_copies(spark):
    rng = random.Random(21)
    passage = [f"c{i}" for i in range(50)]
    copy = " ".join(f"k{i}" for i in range(80))
    texts = [copy] * 300 + [" ".join([f"u{n}x{i}" for i in range(rng.randint(0, 30))] + passage + [f"v{n}x{i}" for i in range(rng.randint(0, 30))]) for n in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removals(docs).collect()}
    assert got == dict(enumerate(brute(texts, 35)))
