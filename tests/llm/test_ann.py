import numpy as np
import pytest

from quire.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    out = {}
    for qid, q in queries:
        scored = sorted((-float(np.dot(q, v) / np.sqrt(np.dot(q, q) * np.dot(v, v))), i) for i, v in rows if i != qid)
        out[qid] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    frame = table.toPandas()
    rows = [(int(i), np.array(v, dtype=float)) for i, v in zip(frame.vec_id, frame.embedding)]
    queries = [r for r in rows if r[0] % 50 == 0]
    want = brute(rows, queries, 5)
    got = ann.nearest(table, table.where("vec_id % 50 = 0"), block_rows=150, chunk_visits=25).toPandas()
    assert got.groupby("query_id").size().eq(5).all() and set(got.query_id) == set(want)
    hits = sum(len(set(part.vec_id) & {i for i, _ in want[q]}) for q, part in got.groupby("query_id"))
    assert hits / (5 * len(want)) >= 0.93
    exact = dict(rows)
    for r in got.itertuples():
        q, v = exact[r.query_id], exact[r.vec_id]
        assert r.score == pytest.approx(np.dot(q, v) / np.sqrt(np.dot(q, q) * np.dot(v, v)), abs=1e-12)
    for _, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == [1, 2, 3, 4, 5] and part.score.is_monotonic_decreasing


def test_cells_hold_every_point_and_reach_them():
    rng = np.random.default_rng(2)
    points = np.concatenate((rng.normal(size=(3000, 8)), np.zeros((500, 8)), rng.normal(size=(40, 8)).repeat(30, axis=0)))
    cells = ann.Cells(points[::3], 30)
    home = cells.of(points)
    assert 2 < cells.count <= 30 and set(home) <= set(range(cells.count)) and np.bincount(home).max() < 900
    queries, reach = rng.normal(size=(20, 8)), rng.uniform(0.1, 4, size=20)
    row, cell = cells.reached(queries, reach)
    met = set(zip(row.tolist(), cell.tolist()))
    assert len(met) == len(row) < 20 * cells.count
    for q in range(20):  # every point within reach lies in a cell that was reached
        near = ((points - queries[q]) ** 2).sum(axis=1) <= reach[q]
        assert {(q, c) for c in home[near].tolist()} <= met
    assert {(q, cells.of(queries)[q]) for q in range(20)} <= met
    row, _ = cells.reached(queries, np.full(20, np.inf))
    assert len(row) == 20 * cells.count
    assert ann.Cells(np.zeros((50, 8)), 4).count == 1


def test_clusters_visit_few_cells(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 32))
    data = centres[rng.integers(0, 200, 4000)] + 0.02 * rng.normal(size=(4000, 32))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)] + [(4000 + i, data[0].tolist(), 0) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = ann.nearest(table, table.where("vec_id % 50 = 0"), block_rows=100, chunk_visits=10).toPandas()
    vectors = [(i, np.array(v)) for i, v, _ in rows]
    want = brute(vectors, [v for v in vectors if v[0] % 50 == 0], 5)
    assert sum(len({i for i, _ in want[q]} & set(part.vec_id)) for q, part in got.groupby("query_id")) >= 0.98 * 5 * len(want)
    copies = got[got.query_id == 4000].sort_values("rank")  # 1,501 rows share this vector
    assert copies.vec_id.tolist() == [0, 4001, 4002, 4003, 4004]
    tree = ann.Cells((data / np.linalg.norm(data, axis=1)[:, None]) @ ann.projection(32), 40)
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    kth = np.sort(unit[:100] @ unit.T, axis=1)[:, -6]
    row, _ = tree.reached(unit[:100] @ ann.projection(32), ann.within(kth, ann.chi_square_quantile(ann.CONFIDENCE, ann.PROJECTIONS)))
    assert len(row) < 100 * 40 / 4


def test_stopping_test_reads_less_than_all():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 32))
    vectors = centres[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 32))
    read = []
    plain = ann.KdTree.distances
    tree = ann.KdTree((vectors / np.linalg.norm(vectors, axis=1)[:, None]) @ ann.projection(32))
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(4000))
    for q in vectors[:20]:
        unit = q / np.linalg.norm(q)
        far = plain(tree, (unit @ ann.projection(32))[None])[0]
        near = np.sort(2 - 2 * (vectors @ unit) / np.linalg.norm(vectors, axis=1))[5]
        read.append((far <= ann.chi_square_quantile(ann.CONFIDENCE, ann.PROJECTIONS) * near).mean())
    assert np.mean(read) < 0.5


def test_points_are_verified_until_the_test_stops(spark):
    """Production parameters over the given table in one cell: fewer vectors than all are verified, recall stays over nine tenths."""
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, data = frame.vec_id.to_numpy(), np.stack(frame.embedding.to_numpy()).astype(float)
    asked = np.flatnonzero(ids % 50 == 0)
    block = ann.Block(ids, data)
    best = block.search(ids[asked], data[asked], 5)
    want = brute(list(zip(ids.tolist(), data)), [(int(ids[i]), data[i]) for i in asked], 5)
    hits = sum(len(set(ids[best.rows[j]].tolist()) & {i for i, _ in want[int(ids[q])]}) for j, q in enumerate(asked))
    assert hits >= 0.92 * 5 * len(asked)
    assert block.verified < 0.85 * len(asked) * len(ids)


def test_recall_over_several_cells_at_production_parameters(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(300, 16))
    data = centres[rng.integers(0, 300, 26_000)] + 0.3 * rng.normal(size=(26_000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.nearest(table, table.where("vec_id % 500 = 0")).toPandas()
    want = brute(list(enumerate(data)), [(i, data[i]) for i in range(0, 26_000, 500)], 5)
    assert got.groupby("query_id").size().eq(5).all()
    assert sum(len(set(part.vec_id) & {i for i, _ in want[q]}) for q, part in got.groupby("query_id")) >= 0.92 * 5 * len(want)


@pytest.mark.parametrize("block_rows", [12_000, 7])
def test_rows_of_one_id_push_out_no_other(spark, block_rows):
    rng = np.random.default_rng(6)
    rows = [(0, [1.0, 0.0, 0.0])] + [(7, [1.0, 0.01 * i, 0.0]) for i in range(6)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(table, table.where("vec_id = 0"), confidence=1 - 1e-12, block_rows=block_rows).orderBy("rank").collect()
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -2), v[0] / float(np.linalg.norm(v)))
    assert [r.vec_id for r in got] == sorted(best, key=lambda i: (-best[i], i))[:5] and got[0].vec_id == 7 and got[0].score == 1.0


def test_more_cells_than_the_sample_has(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 60)  # three cells at most
    rng = np.random.default_rng(5)
    data = rng.normal(size=(900, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    trees, lots = ann.fit_cells(ann.usable(table), 50)
    assert lots == 6 and trees[8].count <= 3
    got = ann.nearest(table, table.where("vec_id % 90 = 0"), confidence=1 - 1e-12, block_rows=50, chunk_visits=7).toPandas()
    want = brute(list(enumerate(data)), [(i, data[i]) for i in range(0, 900, 90)], 5)
    assert {q: part.sort_values("rank").vec_id.tolist() for q, part in got.groupby("query_id")} == {q: [i for i, _ in r] for q, r in want.items()}


def test_chi_square():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    sample = (np.random.default_rng(1).normal(size=(20000, 8)) ** 2).sum(axis=1)
    assert (sample <= ann.chi_square_quantile(0.9, 8)).mean() == pytest.approx(0.9, abs=0.01)


def test_ties_copies_and_unfit_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 0.0], 0) for i in range(0, 9)] + [(9, None, 0), (10, [], 0), (11, [0.0, 0.0], 0), (12, [1.0, None], 0), (13, [nan, 1.0], 0), (14, [inf, 1.0], 0), (None, [1.0, 0.0], 0), (15, [0.0, 1.0], 1), (15, [0.0, 1.0], 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = ann.nearest(table, table.where("vec_id % 3 = 0")).toPandas()
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [1, 2, 3, 4, 5]
    assert got[got.query_id == 6].sort_values("rank").vec_id.tolist() == [0, 1, 2, 3, 4]
    assert set(got.query_id) == {0, 3, 6, 15} and 15 not in set(got[got.query_id == 15].vec_id)
    few = table.where("vec_id in (0, 1, 15)")
    assert sorted(r.vec_id for r in ann.nearest(few, few.where("vec_id = 0")).collect()) == [1, 15]
    assert ann.nearest(table.limit(0), table).collect() == []
