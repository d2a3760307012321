import math
import re

import numpy as np

from quire.llm import quality
from quire.session import Scratch


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


def test_base_counts_against_brute_force(hard_docs, hard_rows):
    got = {r.doc_id: r for r in quality.judge(hard_docs, None).collect()}
    for doc_id, text, *_ in hard_rows:
        want, row = brute(text), got[doc_id]
        assert [row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words] == want, doc_id
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert row.kept == (not row.base_failed)  # without labels there is no cut


def test_held_out_labels_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trained_on = labels.where("doc_id % 2 = 0")
    held = labels.where("doc_id % 2 = 1").join(quality.judge(docs, trained_on), "doc_id").where("not base_failed").toPandas()
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.1 and len(bad) > 5


def test_forest_isolates_outliers_and_is_deterministic():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(500, 3))
    a, b = (quality.IsolationForest(points, trees=50) for _ in range(2))
    odd = np.array([[6.0, 6.0, 6.0]])
    assert a.score(odd)[0] > a.score(points).max() - 0.02
    assert (a.score(points) == b.score(points)).all()


def test_calibration_keeps_the_good():
    scores, good = np.array([0.1, 0.2, 0.3, 0.7, 0.8]), np.array([1, 1, 1, 0, 0], dtype=bool)
    assert quality.calibrate(scores, good) == 0.5
    assert quality.calibrate(scores, np.ones(5, dtype=bool)) == float("inf")


def test_filter_keeps_columns_and_takes_clashing_names(spark, no_docs):
    assert quality.keep_good(no_docs, None).columns == no_docs.columns and quality.keep_good(no_docs, None).count() == 0
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "x", 5), (1, text, "x", 5), (None, text, None, None), (2, None, "y", 1)], "doc_id long, text string, _kept string, n_words int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in quality.keep_good(docs, labels).orderBy("doc_id").collect()] == [(None, text, None, None), (1, text, "x", 5), (1, text, "x", 5)]


def test_kept_follows_from_path_lengths_walked_by_hand(spark):
    """The query's verdicts on every document, from each tree walked node by node in plain Python."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    size = model.forest.subsample

    def unsuccessful(n):
        return 0.0 if n <= 1 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n

    trees = [[x.tolist() for x in tree] for tree in model.forest.trees]

    def score(point):
        total = 0.0
        for feature, cut, left, right, depth in trees:
            at, steps = 0, 0
            while feature[at] >= 0:
                at, steps = (left[at] if point[feature[at]] < cut[at] else right[at]), steps + 1
            assert depth[at] >= steps - 1e-12  # a leaf's length is its depth and what its rows would still need
            total += depth[at]
        return 2 ** (-(total / len(trees)) / unsuccessful(size))

    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    some = docs.where("doc_id % 7 = 0").collect()
    verdicts = []
    for r in some:
        counts, features = quality.statistics((r.text or "").encode())
        scaled = [min(4.0, max(-3.0, (x - low) / span)) for x, low, span in zip(features, model.low.tolist(), model.span.tolist())]
        want, row = score(scaled), got[r.doc_id]
        assert abs(want - row.score) < 1e-9
        if abs(want - model.threshold) > 1e-9:
            assert row.kept == (not row.base_failed and want <= model.threshold)
            verdicts.append((row.base_failed, row.kept))
    assert {(True, False), (False, True), (False, False)} <= set(verdicts)


def test_quantiles_and_cut_are_those_of_all_rows(spark):
    """Rows of many equal values, more than one range: as numpy has them over the whole."""
    rng = np.random.default_rng(5)
    points = np.round(rng.normal(size=(3001, len(quality.FEATURES))) * rng.choice([1, 5, 100], len(quality.FEATURES)), 1)
    points[:, 3] = 7.0
    frame = spark.createDataFrame([(x.tolist(),) for x in points], "features array<double>").repartition(7)
    assert np.allclose(quality.quantiles(frame, (0.01, 0.5, 0.99), Scratch(spark, "quantiles")), np.quantile(points, (0.01, 0.5, 0.99), axis=0), rtol=0, atol=1e-12)
    for shift, rare in ((0.2, 0.1), (0.05, 0.5), (-0.2, 0.1)):
        good = rng.random(3001) > rare
        scores = np.round(rng.normal(0.4, 0.05, 3001) + np.where(good, 0, shift), 3)
        frame = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(scores, good)], "score double, good boolean").repartition(5)
        assert quality.calibrated(frame, Scratch(spark, "cut"), 0.9) == quality.calibrate(scores, good, 0.9)


def test_every_labelled_row_counts(spark):
    """5,000 labelled rows: each good row of the fitted half is in a tree, and what only the last ids show moves the cut."""
    rng = np.random.default_rng(6)

    def text(i, odd):
        words = [f"w{rng.integers(10**6)}" for _ in range(60)]
        return " ".join(w.upper() + "!" if odd else w for w in words)

    rows = [(i, text(i, i >= 4700)) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 4700)) for i in range(5000)], "doc_id long, quality int")
    dealt = []
    plain = quality.forest_of
    quality.forest_of = lambda rows, count, scale: dealt.append((rows.count(), count)) or plain(rows, count, scale)
    try:
        model = quality.train(docs, labels)
    finally:
        quality.forest_of = plain
    assert dealt[0][0] == dealt[0][1] > 2200  # half of all the good, whatever their number
    assert len(model.forest.trees) == quality.TREES and model.forest.subsample >= quality.SUBSAMPLE
    assert max(len(t[0]) for t in model.forest.trees) < 2 ** (math.ceil(math.log2(quality.SUBSAMPLE)) + 1)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    assert len([i for i in kept if i < 4700]) > 0.98 * 4700 and not [i for i in kept if i >= 4700]
