"""Vector codes and clusters against exact brute force in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from quire.llm import delta_lloyd, queries, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


LARGEST = (1 << 63) - 1


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def whole(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def plain_codes(rows, parts, entries, rounds, factor):
    kept = sorted(((i, [math.floor(factor * float(x)) for x in v], label) for i, v, label in rows if whole(v)), key=lambda r: (r[0] is None, r[0], r[1]))
    step = len(kept[0][1]) // parts
    cut = [[r[1][p * step : (p + 1) * step] for p in range(parts)] for r in kept]
    books = [[list(cut[e][p]) for e in range(min(entries, len(kept)))] for p in range(parts)]

    def assign(part, book):
        scored = [sum((a - b) ** 2 for a, b in zip(part, c)) for c in book]
        return scored.index(min(scored)), min(scored)

    for _ in range(rounds):
        for p in range(parts):
            owner = [assign(c[p], books[p])[0] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, owner) if o == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    out, labels = [], {}
    for (i, _, label), c in zip(kept, cut):
        found = [assign(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), label))
        labels[label] = labels.get(label, 0) + out[-1][2]
    mark = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((i, code, min(error, LARGEST), min(labels[label], LARGEST), mark) for i, code, error, label in out)


def plain_clusters(rows, k, rounds, factor, width, seed):
    kept = [(i, [math.floor(factor * float(x)) for x in v], v) for i, v in rows if whole(v) and len(v) == width]
    at = [r[1] for r in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[2]))[:k]]

    def assign(v):
        scored = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in at]
        return scored.index(min(scored)), min(scored)

    for _ in range(rounds):
        owner = [assign(v)[0] for _, v, _ in kept]
        for c in range(len(at)):
            mine = [v for (_, v, _), o in zip(kept, owner) if o == c]
            if mine:
                at[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, c, min(d, LARGEST)) for i, v, _ in kept for c, d in [assign(v)]]
    sums = {}
    for _, c, d in found:
        sums[c] = sums.get(c, 0) + d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return in_order((i, c, d, min(sums[c], LARGEST), min(sum(sums.values()), LARGEST), marks[c]) for i, c, d in found)


def table_of(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    return [(int(i), list(map(float, v)), int(x)) for i, v, x in zip(frame.vec_id, frame.embedding, frame.label)]


def test_codes_query_equals_brute_force(spark, sf_dir):
    got = queries.op12_vector_codes(spark, sf_dir)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == plain_codes(table_of(spark, sf_dir), 16, 64, 2, 256)


def test_clusters_query_equals_brute_force(spark, sf_dir):
    got = queries.op13_delta_lloyd(spark, sf_dir)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == plain_clusters([r[:2] for r in table_of(spark, sf_dir)], 8, 10, 1024, 64, 3)


def hard_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 8) / 4).tolist(), int(i % 3) if i % 5 else None) for i in range(70)]  # coarse: many ties
    rows += [(7, rows[0][1], 1), (7, rows[1][1], 1), (200, rows[0][1], None), (201, rows[0][1], None)]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0] * 7 + [None], 1), (303, [1.0] * 7 + [math.nan], 1), (304, [math.inf] + [0.0] * 7, 2)]
    rows += [(400, [1e5, -1e5] * 4, 4), (401, [3e7, 2.0] * 4, 4), (402, [-0.0] * 8, 5), (403, [-1e-12] * 8, 5)]
    return rows


@pytest.mark.parametrize("entries", [1, 5, 64, 256])
def test_codes_with_nulls_ties_copies_and_great_values(spark, entries):
    rows = hard_vectors()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as text", "1 as codes_", "2 as _v2").repartition(3)
    found = vector_codes.compress(frame, parts=4, entries=entries, rounds=3)
    got = vector_codes.with_label_error(found.rows).selectExpr("vec_id", "lower(hex(codes)) as code", "error", "label_error").collect()
    want = plain_codes(rows, 4, entries, 3, 256)
    assert sorted((*r, found.fingerprint()) for r in got) == want
    back = found.reconstructed().where("vec_id = 5").collect()[0]
    books = found.codebooks
    assert back.vector == [float(x) / 256 for p in range(4) for x in books[p][back.codes[p]]]


def test_many_labels_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "LABELS_SENT", 0)
    rows = hard_vectors()
    found = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), parts=4)
    got = vector_codes.with_label_error(found.rows).selectExpr("vec_id", "lower(hex(codes)) as code", "error", "label_error").collect()
    assert sorted((*r, found.fingerprint()) for r in got) == plain_codes(rows, 4, 64, 2, 256)


def test_screening_keeps_what_intervals_leave_open():
    rng = np.random.default_rng(8)
    for scale in (3, 1 << 12, 1 << 23, 1 << 28, 1 << 40):  # beyond 2**12 products round, beyond 2**30 squares overflow a long
        rows, entries = rng.integers(-scale, scale + 1, (200, 4)), rng.integers(-scale, scale + 1, (64, 4))
        entries[40:] = entries[:24]  # equal entries: the lower index
        rows[:64] = entries + rng.integers(-1, 2, (64, 4))
        code, distance = vector_codes.nearest_entries(rows, entries)
        for r, c, d in zip(rows.tolist(), code, distance):
            exact = [sum((a - b) ** 2 for a, b in zip(r, e)) for e in entries.tolist()]
            assert d == min(exact) and c == exact.index(min(exact))


@pytest.mark.parametrize("k", [1, 3, 8, 500])
def test_clusters_with_nulls_ties_copies_and_great_values(spark, k):
    rows = [r[:2] for r in hard_vectors()] + [(900, [0.5] * 9), (None, [0.25] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "3 as owner", "'c' as cluster", "1L as v").repartition(3)
    found = delta_lloyd.cluster(frame, centroids=k, width=8)
    got = found.with_inertia().select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert in_order(got) == plain_clusters(rows, k, 10, 1024, 8, 3)
    assert found.with_inertia().where("vec_id is null").count() == 1


def test_only_changed_centroids_and_their_vectors_are_compared(monkeypatch):
    rng = np.random.default_rng(5)
    x, at = rng.integers(-50, 50, (300, 6)), rng.integers(-50, 50, (7, 6))
    owner, distance = delta_lloyd.reassigned(x, np.full(300, -1), np.zeros(300, dtype=np.int64), at, np.arange(7))
    moved = at.copy()
    moved[[2, 5]] += rng.integers(-9, 10, (2, 6))
    compared = []
    plain = delta_lloyd.squared
    monkeypatch.setattr(delta_lloyd, "squared", lambda a, b: compared.append(len(a)) or plain(a, b))
    again = delta_lloyd.reassigned(x, owner, distance, moved, np.array([2, 5]))
    fresh = delta_lloyd.reassigned(x, np.full(300, -1), distance, moved, np.arange(7))
    assert all((a == b).all() for a, b in zip(again, fresh))
    theirs = int(np.isin(owner, [2, 5]).sum())
    assert sum(compared[:9]) == 7 * theirs + 2 * (300 - theirs) < 7 * 300


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_codes.with_label_error(vector_codes.compress(none).rows).collect() == []
    found = delta_lloyd.cluster(none)
    assert found.rows.collect() == [] and found.with_inertia().columns == ["cluster", "vec_id", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert delta_lloyd.cluster(spark.createDataFrame([(1, [1.0], 2)], SCHEMA)).rows.collect() == []
