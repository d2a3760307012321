"""Approximate nearest neighbours by cosine: low-dimensional stable projections in a kd-tree, with a chi-square
stopping test.

Vectors are normalised, so that the nearest by cosine are the nearest by Euclidean distance. PROJECTIONS
Gaussian (2-stable) projections map them to a few dimensions. A kd-tree of cells over the projected space, fitted
on a sample of at most SAMPLE_ROWS rows (the least hashes of vec_id), deals every row to a cell of about BLOCK_ROWS
rows, and each cell has a finer kd-tree of its own, built once by the task that holds it. A query takes leaves, and
then cells, by projected distance, and verifies at full length the points of each that its stopping test still leaves
by their own projected distance. The squared projected distance of a vector at true distance d is d**2 times a chi-square variable
of PROJECTIONS degrees of freedom; where the next point, leaf or cell lies so far off that a vector nearer than the K-th best
so far would be nearer in projection with probability CONFIDENCE, the query stops.

Two rounds: each query searches its own cell, then only the cells that the stopping test leaves. A candidate is
shuffled once a round, and once more for every CHUNK_VISITS queries that visit its cell beyond the first, so the rows
shuffled grow with the rows and the visits, not with their product. A task reads a cell's candidates first and then
its queries batch by batch, so its memory is one cell and one batch. Tables with more rows than the sample's cells
can hold deal each cell's rows to lots by their hash, and its queries go to all of them.

Equal vectors: a query needs at most the K + 1 smallest ids of one vector, so only these are kept, picked before the
shuffle; a vector that a third of all rows share is no hot cell.

Results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
vec_id; a query has every row but its own as candidate (rows of equal id are its own), all of them if there are
fewer than K. Equal scores are ordered by the smaller vec_id. Rows of one vec_id are one neighbour, the nearest of them
(before the K best are taken, so they push out no other), and one query. Vectors of
another length than the query's are not comparable and are skipped. An empty table gives no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.batches import column
from quire.session import Scratch, bound_batches

K, PROJECTIONS, CONFIDENCE, SEED = 5, 8, 0.97, 31
BLOCK_ROWS, CHUNK_VISITS, LEAF = 12_000, 20_000, 64
#: Rows of the sample that the tree of cells is fitted on: so many a cell, and at most so many in all.
CELL_SAMPLE, SAMPLE_ROWS = 256, 400_000
_SLAB = 20_000


def chi_square_cdf(x: np.ndarray | float, degrees: int) -> np.ndarray:
    """P(chi-square <= x) for an even number of degrees."""
    half = np.asarray(x, dtype=float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 10.0 * degrees + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, degrees) < p else (low, mid)
    return high


def projection(width: int, count: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng((seed, width)).normal(size=(width, count))


class KdTree:
    """Leaves of a kd-tree over projected points: row numbers and bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            if len(rows) <= leaf:
                self.leaves.append(rows)
                continue
            spread = points[rows].max(axis=0) - points[rows].min(axis=0)
            axis = int(spread.argmax())
            middle = len(rows) // 2
            order = np.argpartition(points[rows, axis], middle)
            stack += [rows[order[middle:]], rows[order[:middle]]]
        self.low = np.stack([points[r].min(axis=0) for r in self.leaves])
        self.high = np.stack([points[r].max(axis=0) for r in self.leaves])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of projected queries (rows) to the leaves' boxes."""
        out = np.empty((len(q), len(self.leaves)))
        for i in range(0, len(q), _SLAB // 64):
            part = q[i : i + _SLAB // 64, None, :]
            gap = np.maximum(self.low - part, 0) + np.maximum(part - self.high, 0)
            out[i : i + _SLAB // 64] = (gap * gap).sum(axis=2)
        return out


class _Best:
    """The k best of each query so far, by exact score and then by the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.norms, self.query_ids, self.queries, self.k = ids, vectors, norms, query_ids, queries, k
        self.repeated = len(np.unique(ids)) < len(ids)
        self.lengths = np.sqrt((queries * queries).sum(axis=1))
        self.scores = np.full((len(queries), k), -np.inf)
        self.rows = np.full((len(queries), k), -1, dtype=np.int64)

    def offer(self, q: np.ndarray, rows: np.ndarray) -> None:
        """Candidates (query, row), which may be many of one query."""
        other = self.ids[rows] != self.query_ids[q]
        q, rows = q[other], rows[other]
        if not len(q):
            return
        scores = np.empty(len(q))
        for i in range(0, len(q), _SLAB):
            part = slice(i, i + _SLAB)
            scores[part] = (self.vectors[rows[part]] * self.queries[q[part]]).sum(axis=1) / (self.norms[rows[part]] * self.lengths[q[part]])
        touched = np.unique(q)
        held_q, held = np.repeat(touched, self.k), self.rows[touched].ravel()
        some = held >= 0
        q = np.concatenate((q, held_q[some]))
        rows = np.concatenate((rows, held[some]))
        scores = np.concatenate((scores, self.scores[touched].ravel()[some]))
        order = np.lexsort((self.ids[rows], -scores, q))
        q, rows, scores = q[order], rows[order], scores[order]
        if self.repeated:  # of rows of one id only the best counts, or they would push out others
            by_id = np.lexsort((self.ids[rows], q))  # stable: the best of an id comes first
            again = (np.diff(q[by_id], prepend=-1) == 0) & (np.diff(self.ids[rows[by_id]], prepend=0) == 0)
            once = np.sort(by_id[~again])
            q, rows, scores = q[once], rows[once], scores[once]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = place < self.k
        self.rows[q[top], place[top]], self.scores[q[top], place[top]] = rows[top], scores[top]


class Block:
    """One cell's candidates under a kd-tree, searched by batches of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.plane = projection(vectors.shape[1])
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.units = vectors / self.norms[:, None]
        self.points = self.units @ self.plane
        self.spread = (self.points * self.points).sum(axis=1)
        self.tree = KdTree(self.points)
        self.verified = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int = K, confidence: float = CONFIDENCE, known: np.ndarray | None = None) -> _Best:
        """The k nearest found here of each query; known is the K-th score that a query has from elsewhere (or -inf).

        Queries advance together: each round every query that goes on takes its next leaves by projected distance, and of
        their points those that its stopping test still leaves; only these are verified. Queries that take the same leaf
        share the products with its points and vectors."""
        stop = chi_square_quantile(confidence, self.plane.shape[1])
        best = _Best(self.ids, self.vectors, self.norms, query_ids, queries, k)
        units = queries / best.lengths[:, None]
        asked = units @ self.plane
        far = self.tree.distances(asked)
        order = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, order, axis=1)
        floor = np.full(len(queries), -np.inf) if known is None else known
        going, at, step = np.arange(len(queries)), 0, 2
        while at < far.shape[1] and len(going):
            # equal vectors project to one point: leaves at distance 0 may hold ties and are always read
            kth = np.maximum(best.scores[going, k - 1], floor[going])
            reach = within(kth, stop)
            going, kth, reach = (x[far[going, at] <= reach] for x in (going, kth, reach))
            next_far = far[going, at : at + step]
            q, column_ = np.nonzero(next_far <= reach[:, None])
            leaf = order[going[q], at + column_]
            by_leaf = np.argsort(leaf, kind="stable")
            q, leaf = q[by_leaf], leaf[by_leaf]
            edges = np.flatnonzero(np.diff(leaf, prepend=-1, append=-2))
            found_q, found_rows = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                members, rows = q[a:b], self.tree.leaves[leaf[a]]
                here = asked[going[members]]
                apart = (here * here).sum(axis=1)[:, None] + self.spread[rows] - 2 * (here @ self.points[rows].T)
                due = apart <= reach[members, None] + 1e-9  # the points that the test still leaves: these are verified
                self.verified += int(due.sum())
                near, which = np.nonzero(due & (units[going[members]] @ self.units[rows].T >= kth[members, None] - 1e-9))
                found_q.append(going[members[near]])
                found_rows.append(rows[which])
            if found_q:
                best.offer(np.concatenate(found_q), np.concatenate(found_rows))
            at, step = at + step, min(2 * step, 64)
        return best


def within(kth: np.ndarray, stop: float) -> np.ndarray:
    """The squared projected distance up to which a query with this K-th score goes on."""
    return np.where(np.isfinite(kth), stop * np.maximum(0.0, 2 - 2 * kth) + 1e-12, np.inf)


class Cells:
    """A kd-tree of cells over the projected space: every point lies in one cell."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.axis, self.cut, self.low, self.high, self.count = [], [], [], [], 0

        def node(rows: np.ndarray, parts: int) -> int:
            at = len(self.axis)
            for column_, value in ((self.axis, -1), (self.cut, 0.0), (self.low, 0), (self.high, 0)):
                column_.append(value)
            spread = sample[rows].max(axis=0) - sample[rows].min(axis=0) if len(rows) else np.zeros(1)
            axis = int(spread.argmax())
            if parts > 1 and spread[axis] > 0:
                values = np.sort(sample[rows, axis])
                cut = values[max(1, len(values) * (parts // 2) // parts)]
                if cut == values[0]:
                    cut = values[np.searchsorted(values, cut, side="right")]
                below = sample[rows, axis] < cut
                self.axis[at], self.cut[at] = axis, float(cut)
                self.low[at], self.high[at] = node(rows[below], parts // 2), node(rows[~below], parts - parts // 2)
            else:
                self.low[at], self.count = self.count, self.count + 1
            return at

        node(np.arange(len(sample)), cells)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        axis, cut, low, high = np.array(self.axis), np.array(self.cut), np.array(self.low), np.array(self.high)
        at = np.zeros(len(points), dtype=np.int64)
        rows = np.arange(len(points))
        while len(rows := rows[axis[at[rows]] >= 0]):
            here = at[rows]
            at[rows] = np.where(points[rows, axis[here]] < cut[here], low[here], high[here])
        return low[at]

    def reached(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for all cells no farther from a point than its reach (squared)."""
        found: list[tuple[np.ndarray, int]] = []
        stack = [(0, np.arange(len(points)), np.zeros_like(points))]
        while stack:
            at, rows, gap = stack.pop()
            if self.axis[at] < 0:
                found.append((rows, self.low[at]))
                continue
            axis, side = self.axis[at], points[rows, self.axis[at]] - self.cut[at]
            for child, apart in ((self.low[at], np.maximum(side, 0)), (self.high[at], np.maximum(-side, 0))):
                there = gap.copy()
                there[:, axis] = np.maximum(gap[:, axis], apart)
                near = (there * there).sum(axis=1) <= reach[rows]
                if near.any():
                    stack.append((child, rows[near], there[near]))
        return np.concatenate([r for r, _ in found] or [np.empty(0, np.int64)]), np.concatenate([np.full(len(r), c) for r, c in found] or [np.empty(0, np.int64)])


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of a batch's vectors `v`, by their length."""
    v = column(batch, "v")
    offsets, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False).astype(np.float64)
    widths = np.diff(offsets)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield rows, flat[offsets[rows][:, None] + np.arange(width)]


def _projected(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None] @ projection(matrix.shape[1])


def usable(vectors: DataFrame, kind: str = "double") -> DataFrame:
    """vec_id, v (an array of kind, float where the vectors are such: they are widened when computed with) of the rows that take part."""
    v = F.col("embedding").cast(f"array<{kind}>")
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(whole).where(finite & F.exists(v, lambda x: x != 0)).select("vec_id", v.alias("v"))


def _kind(*frames: DataFrame) -> str:
    return "float" if all(f.schema["embedding"].dataType.simpleString() == "array<float>" for f in frames) else "double"


def distinct_vectors(rows: DataFrame, k: int = K) -> DataFrame:
    """rows (vec_id, v) with the k + 1 smallest ids of each vector, once each."""
    order = Window.partitionBy("v").orderBy("vec_id")
    return rows.dropDuplicates(["vec_id", "v"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("vec_id", "v")


def fit_cells(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[dict[int, Cells], int]:
    """By vector length the tree of cells, from a bounded sample of the projected rows (a length that is not in the sample is one
    cell), and the lots that a cell's rows are dealt to: more than one where the sample has too few cells for the table."""
    n = rows.count()
    cells = min(max(1, math.ceil(n / block_rows)), SAMPLE_ROWS // 20)
    lots = math.ceil(n / (cells * block_rows))
    if cells <= 1:
        return {}, max(1, lots)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE_ROWS, CELL_SAMPLE * cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _matrices(batch):
                points = _projected(matrix)
                yield pa.RecordBatch.from_pydict({"width": np.full(len(at), matrix.shape[1], dtype=np.int32), "p": pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), points.shape[1]).cast(pa.list_(pa.float64()))})

    sample = chosen.mapInArrow(run, "width int, p array<double>").toPandas()
    return {int(w): Cells(np.stack(part["p"].to_numpy()), max(1, round(cells * len(part) / len(sample)))) for w, part in sample.groupby("width")}, lots


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, confidence: float = CONFIDENCE, block_rows: int = BLOCK_ROWS, chunk_visits: int = CHUNK_VISITS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors (vec_id, embedding) to each row of queries."""
    spark = bound_batches(vectors.sparkSession)
    tables = Scratch(spark, "neighbours")
    kind = _kind(vectors, queries)
    rows = tables.keep(distinct_vectors(usable(vectors, kind), k), "rows")
    asked = tables.keep(usable(queries, kind).dropDuplicates(["vec_id", "v"]), "asked")
    trees, lots = fit_cells(rows, block_rows)
    sent = spark.sparkContext.broadcast(trees)  # two numbers and three links a node, under 41 nodes a hundred sample rows
    stop = chi_square_quantile(confidence, PROJECTIONS)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _matrices(batch):
                tree = sent.value.get(matrix.shape[1])
                cell = tree.of(_projected(matrix)) if tree else np.zeros(len(at), dtype=np.int64)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), matrix.shape[1], dtype=np.int32)), pa.array(cell.astype(np.int32))], names=[*part.schema.names, "width", "cell"])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _matrices(batch):
                tree = sent.value.get(matrix.shape[1])
                if not tree:
                    continue  # one cell, which is home
                points, known = _projected(matrix), column(batch, "known").to_numpy(zero_copy_only=False)[at]
                for s in range(0, len(at), 64):  # few at once: each can reach every cell
                    row, cell = tree.reached(points[s : s + 64], within(known[s : s + 64], stop))
                    away = cell != tree.of(points[s : s + 64])[row]
                    row, cell = row[away] + s, cell[away]
                    part = batch.take(pa.array(at[row]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(row), matrix.shape[1], dtype=np.int32)), pa.array(cell.astype(np.int32))], names=[*part.schema.names, "width", "cell"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, block = None, [], [], None
        for batch in batches:
            names = ("width", "cell", "chunk", "asks", "vec_id", "known")
            width, cell, chunk, asks, vec_id, known = (column(batch, n).to_numpy(zero_copy_only=False) for n in names)
            for at, matrix in _matrices(batch):
                edges = np.flatnonzero((np.diff(cell[at]) != 0) | (np.diff(chunk[at]) != 0) | (np.diff(asks[at].astype(np.int8)) != 0)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
                    first = at[a]
                    if key != (here := (width[first], cell[first], chunk[first])):
                        key, ids, parts, block = here, [], [], None
                    if not asks[first]:
                        ids.append(vec_id[at[a:b]])
                        parts.append(matrix[a:b])
                    elif parts or block:
                        if block is None:
                            block, ids, parts = Block(np.concatenate(ids), np.concatenate(parts)), [], []
                        q = vec_id[at[a:b]]
                        best = block.search(q, matrix[a:b], k, confidence, known[at[a:b]])
                        of, place = np.nonzero(best.rows >= 0)
                        yield pa.RecordBatch.from_arrays([pa.array(q[of]), pa.array(block.ids[best.rows[of, place]]), pa.array(best.scores[of, place])], names=["query_id", "vec_id", "score"])

    def searched(visits: DataFrame) -> DataFrame:
        """The results of visits (vec_id, v, known, width, cell): cells come with their candidates first, then their queries."""
        chunks = visits.groupBy("width", "cell").agg(F.ceil(F.count("*") / chunk_visits).cast("int").alias("chunks"))
        copies = held.join(chunks, ["width", "cell"]).select("vec_id", "v", F.lit(float("-inf")).alias("known"), "width", "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("_c"), F.lit(False).alias("asks"))
        lot = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(lots))
        copies = copies.withColumn("chunk", (F.col("_c") * lots + lot).cast("int")).drop("_c")
        dealt = visits.join(chunks, ["width", "cell"]).select("vec_id", "v", "known", "width", "cell", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("chunks")).alias("_c"), F.lit(True).alias("asks"))
        every_lot = F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))
        dealt = dealt.withColumn("_l", every_lot).withColumn("chunk", (F.col("_c") * lots + F.col("_l")).cast("int")).drop("_c", "_l")
        both = copies.unionByName(dealt).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "width", "cell", "chunk")
        return both.sortWithinPartitions("width", "cell", "chunk", "asks").mapInArrow(answers, "query_id long, vec_id long, score double")

    place = f"vec_id long, v array<{kind}>, {{}}width int, cell int"
    held = tables.keep(rows.mapInArrow(homes, place.format("")), "held")
    tables.drop("rows")
    own = tables.keep(searched(asked.withColumn("known", F.lit(float("-inf"))).mapInArrow(homes, place.format("known double, "))), "own")
    # the K-th score that a query has from its own cell bounds how far it goes; without one it goes everywhere
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = own.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    visits = asked.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("known", F.lit(float("-inf"))).alias("known")).mapInArrow(reached, place.format("known double, "))
    away = tables.keep(searched(tables.keep(visits, "visits")), "away")
    tables.drop("held", "asked", "visits")
    # a query row with another vector under the same id asks too; each neighbour counts once
    found = own.unionByName(away).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
