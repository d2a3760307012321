"""Centroid clustering by delta Lloyd on integer vectors.

Every vector's owner and exact squared distance are kept in a table from round to round, and so are the global sums of
each centroid. A round knows which centroids changed in the last one. A vector whose owner moved is compared with all
centroids; any other only with the changed ones, as no unchanged one can have become nearer than its owner. A vector
that changes owner is a transfer: its components leave the old owner's sum and enter the new one's. Tasks add up their
transfers as signed integers by centroid, and only these reach the driver (centroids x width rows); the new position is
the floored mean. When no centroid changes, the remaining rounds would change nothing and are left out.

A round is one job: it reads the last table, writes the next (assignments, and each task's transfers as a few rows of
their own columns), and drops the last, so the folder in spark.checkpoint.dir holds two of them at most. A lost executor
costs its tasks of one round.

Results: vectors of exactly width components, none null or non-finite, take part; each row counts, equal ones too. The
first centroids are the vectors with the least SHA-256 of "seed:vec_id" (null ids last, of equal ids the smaller vector
first), as many as there are vectors at most. Equal distances go to the smaller number; a centroid without vectors stays. Empty tables
give no rows; columns other than vec_id and embedding are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import column
from quire.llm.vectors import LARGEST, GroupSums, added, as_long, batches_of, integers, matrix_of, squared, whole_vectors
from quire.session import Scratch, bound_batches

CENTROIDS, ROUNDS, WIDTH, FACTOR, SEED = 8, 10, 64, 1024, 3


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and distance of each vector after the centroids numbered in changed have moved; owner -1: none yet."""
    owner, distance = owner.copy(), distance.copy()
    anew = (owner < 0) | np.isin(owner, changed) | (distance == LARGEST)  # a distance beyond a long is not known exactly
    for rows, among in ((np.flatnonzero(anew), np.arange(len(centroids))), (np.flatnonzero(~anew), changed)):
        if not len(rows) or not len(among):
            continue
        found = np.stack([squared(x[rows], centroids[c]) for c in among], axis=1)
        at = np.argmin(found, axis=1)  # the first of equals: among ascends
        best, number = found[np.arange(len(rows)), at], among[at]
        if rows.size and not anew[rows[0]]:
            nearer = (best < distance[rows]) | ((best == distance[rows]) & (number < owner[rows]))
            rows, best, number = rows[nearer], best[nearer], number[nearer]
        owner[rows], distance[rows] = number, as_long(best)
    return owner, distance


@dataclass
class Clusters:
    """centroids (integers), and rows: vec_id, cluster, distance."""

    centroids: np.ndarray
    rows: DataFrame
    rounds: int

    def fingerprints(self) -> list[str]:
        """SHA-256 of each centroid's components as decimals joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]

    def with_inertia(self) -> DataFrame:
        """rows with cluster_inertia, inertia and centroid_sha256; the table joined has a row a centroid."""
        spark = self.rows.sparkSession
        sums = {r.cluster: r.total for r in self.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
        whole = min(int(sum(sums.values())), LARGEST)
        told = [(c, min(int(sums.get(c, 0)), LARGEST), whole, mark) for c, mark in enumerate(self.fingerprints())]
        table = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return self.rows.join(F.broadcast(table), "cluster")


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, factor: int = FACTOR, seed: int = SEED) -> Clusters:
    """rounds of assignment and update, and a last assignment."""
    spark = bound_batches(vectors.sparkSession)
    kept = vectors.where(whole_vectors(vectors) & (F.size("embedding") == width)).select("vec_id", F.col("embedding").alias("v"))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(F.asc_nulls_last(mark), "v").limit(centroids).select("v").collect()
    if not start:
        return Clusters(np.empty((0, width), dtype=np.int64), spark.createDataFrame([], "vec_id long, cluster int, distance long"), 0)
    at = integers(np.array([r.v for r in start], dtype=np.float64), factor)
    kind = kept.schema["v"].dataType.simpleString()
    schema = f"vec_id long, v {kind}, owner int, distance long, grp int, pos int, n long, high long, low long"

    def assigned(state: DataFrame, at: np.ndarray, changed: np.ndarray) -> DataFrame:
        """state after the comparison with centroids at, then the task's transfers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moved, types = GroupSums(len(at), width), None
            for batch in batches_of(batches):
                types = column(batch, "v").type
                x = matrix_of(batch, "v", width, factor)
                old, distance = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("owner", "distance"))
                owner, distance = reassigned(x, old, distance, at, changed)
                went = np.flatnonzero(owner != old)
                moved.add(owner[went], x[went])
                left = went[old[went] >= 0]
                moved.add(old[left], x[left], -1)
                none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "v"), pa.array(owner.astype(np.int32)), pa.array(distance), *none], names=names)
            told = moved.columns()
            n = len(told["grp"])
            if n:
                none = [pa.nulls(n, t) for t in (pa.int64(), types, pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*none, *(pa.array(told[c].astype(t)) for c, t in (("grp", np.int32), ("pos", np.int32), ("n", np.int64), ("high", np.int64), ("low", np.int64)))], names=names)

        names = [c.split()[0] for c in schema.split(", ")]
        return state.mapInArrow(run, schema)

    tables = Scratch(spark, "lloyd")
    state = kept.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    count, total = np.zeros(len(at), dtype=object), np.zeros(at.shape, dtype=object)
    changed, last, done = np.arange(len(at)), None, 0
    for turn in range(rounds + 1):
        written = tables.keep(assigned(state, at, changed), f"round-{turn}")
        state = written.where("grp is null").select("vec_id", "v", "owner", "distance")
        if last:
            tables.drop(last)
        last, done = f"round-{turn}", turn + 1
        if turn == rounds:
            break
        in_out, sums = added(written.where("grp is not null").select("grp", "pos", "n", "high", "low"), len(at), width)
        count, total = count + in_out, total + sums
        some = np.flatnonzero(count != 0)
        after = at.copy()
        after[some] = (total[some] // count[some][:, None]).astype(np.int64)
        changed = np.flatnonzero((after != at).any(axis=1))
        at = after
        if not len(changed):
            break
    return Clusters(at, state.select("vec_id", F.col("owner").alias("cluster"), "distance"), done)
