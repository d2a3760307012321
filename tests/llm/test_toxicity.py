"""Restoration against all readings of a token, features and scores, and accuracy on held-out labels."""

import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import deobfuscation as d
from quire.llm import queries, toxicity

WORDS = ["idiot", "stupid", "loser", "hello", "little", "letter", "boot", "and", "the", "good", "assist"]


@pytest.fixture(scope="module")
def restorer():
    return d.Restorer(d.gram_counts(WORDS, np.arange(20, 20 + len(WORDS))))


def test_grams_are_counted_in_their_cells():
    words, counts = ["abba", "é", "aaaaaa"], np.array([2, 3, 5])
    want = np.zeros(d.BUCKETS, dtype=np.int64)
    for w, n in zip(words, counts):
        marked = f"^{w}$"
        for k in range(1, d.ORDER + 1):
            for i in range(len(marked) - k + 1):
                want[d._cell(marked[i : i + k])] += n
    assert (d.gram_counts(words, counts) == want).all()


@pytest.mark.parametrize("written", ["1d10t", "l0ser", "st*pid", "he11o", "booot", "b.o.o.t", "i d i o t", "le++er", "a$$ist", "the-and", "g00d7", "l!ttle!"])
def test_the_cheapest_of_all_paths_is_decoded(restorer, written):
    steps = [d._readings(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", written, re.S)]
    best = {}
    for path in itertools.product(*steps):
        emitted, price = "".join(e for e, _ in path), sum(p for _, p in path)
        emitted = re.sub(r"\$+", "$", emitted).lstrip("$")
        total, context = price, "^"
        for c in emitted if emitted.endswith("$") or not emitted else emitted + "$":
            total += restorer.cost(context, c)
            context = "^" if c == "$" else (context + c)[1 - d.ORDER :]
        words = tuple(w for w in emitted.split("$") if w)
        best[words] = min(total, best.get(words, math.inf))
    least = min(best.values())
    assert restorer.decode(written) in [w for w, t in best.items() if t < least + 1e-9]


@pytest.mark.parametrize("word", ["booot", "letter", "idiiot", "sstupid", "good", "lloosseerr", "ooo", "assist", "aabbccddeeff"])
def test_spelling_agrees_with_decoding(restorer, word):
    assert restorer.spelt(word) == restorer.decode(word)


def test_disguises(restorer):
    seen = restorer.words
    for text in ("1d10t", "IDIOT!!", "id1ot###", "i d i o t", "i.d.i.o.t", "i-d-i-o-t", "idiiiiot", "id!ot", "«idiot»"):
        assert "idiot" in seen(f"and {text} the")
    assert seen("little letter good") == {"little", "letter", "good"}
    assert seen("555-6268 +1 (980) 12") == set() and seen("") == set() and seen("  \n") == set()
    assert "stupid" in seen("x\ns  t  u  p  i  d\nthe") and "the" in seen("x\ns  t  u  p  i  d\nthe")


def test_hostile_texts_are_linear(restorer):
    for text in ("1" * 200_000 + "a", "a " * 100_000, "@!" * 20_000 + "a", "x" * 300_000, "a1" * 20_000):
        assert restorer.words(text) is not None


def frames(spark):
    plain = ["the good letter and", "hello the little boot", "and assist the good", "letter letter hello"]
    bad = ["you stupid the", "the l0ser and", "and idiot hello", "i d i o t the", "stupid loser"]
    rows = [(i, plain[i % 4] + f" w{i}") for i in range(60)] + [(100 + i, bad[i % 5] + f" v{i}") for i in range(40)]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(40)]
    extra = [(200, None), (201, ""), (None, "you idiot"), (202, "you idiot"), (202, "you idiot"), (203, "1d1ot " * 30_000)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "'x' as toxic", "1 as score", "2 as held_out").repartition(3)
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int"), rows + extra


def test_scores_of_every_row(spark):
    docs, labels, rows = frames(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[200] == by[201] and by[202][0] == by[202][1] == by[None][0] == by[203][0] > 0.5
    told = {r.doc_id: r.predicted for r in got if r.doc_id is not None and r.doc_id < 200}
    assert sum(told[i] == (i >= 100) for i in told) >= 97


def test_no_labels_of_both_kinds_and_empty_tables(spark):
    docs, labels, rows = frames(spark)
    assert {r.score for r in toxicity.score(docs, labels.where("toxic = 1")).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).collect() == []


def test_labels_of_held_out_rows_are_not_looked_at(spark):
    docs, labels, _ = frames(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - labels.toxic).otherwise(labels.toxic))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    assert sorted(toxicity.score(docs, labels).collect(), key=key) == sorted(toxicity.score(docs, turned).collect(), key=key)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op11_toxicity(spark, sf).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == 10_000
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    toxic, told = both.toxic == 1, both.predicted == 1
    assert (toxic == told).mean() >= 0.975 and (toxic & told).sum() >= 0.9 * toxic.sum() and (toxic & told).sum() >= 0.9 * told.sum()
