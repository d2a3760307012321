"""Vectors as exact integers: which rows take part, their matrices in Arrow batches, and distances without rounding.

A component x becomes floor(factor * x) in double precision, which is exact for powers of two, limited to +-2**40 (so that
sums of any table fit two longs). Squared distances are computed in 64 bits where they fit and in Python's integers
where they don't; a distance or sum beyond a long is given as the largest long."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import column

LIMIT, LARGEST = 1 << 40, (1 << 63) - 1


def whole_vectors(vectors: DataFrame, name: str = "embedding") -> Column:
    """Whether a row's vector is neither null nor empty and holds finite components only."""
    return F.coalesce((F.size(name) > 0) & F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def matrix_of(batch: pa.RecordBatch, name: str, width: int, factor: int) -> np.ndarray:
    """The integers of a batch whose vectors all have width components."""
    held = column(batch, name)
    return integers(held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), width), factor)


def integers(values: np.ndarray, factor: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * factor), -LIMIT, LIMIT).astype(np.int64)


def fits(width: int, *parts: np.ndarray) -> bool:
    """Whether squared distances between rows of parts fit a long."""
    most = max((int(np.abs(p).max()) for p in parts if p.size), default=0)
    return (2 * most) ** 2 * width < 1 << 63


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows that stand beside each other (shapes broadcast); Python's integers where a long is too short."""
    if not fits(left.shape[-1], left, right):
        left, right = left.astype(object), right.astype(object)
    return ((left - right) ** 2).sum(axis=-1)


def as_long(values: np.ndarray) -> np.ndarray:
    return np.array([min(int(v), LARGEST) for v in values], dtype=np.int64) if values.dtype == object else values


class GroupSums:
    """Exact counts and component sums by group, gathered in a task and added up by Spark as two longs a sum."""

    def __init__(self, groups: int, width: int) -> None:
        self.count = np.zeros(groups, dtype=np.int64)
        self.total = np.zeros((groups, width), dtype=object)

    def add(self, group: np.ndarray, rows: np.ndarray, sign: int = 1) -> None:
        part = np.zeros(self.total.shape, dtype=np.int64)  # a batch of rows within LIMIT fits
        np.add.at(part, group, rows)
        touched = np.unique(group)
        self.total[touched] += sign * part[touched].astype(object)
        self.count += sign * np.bincount(group, minlength=len(self.count))

    def columns(self) -> dict[str, np.ndarray]:
        """grp, pos, n, high, low: one entry for each component of a group that has any count or sum."""
        some = np.flatnonzero((self.count != 0) | (self.total != 0).any(axis=1))
        grp, pos = np.repeat(some, self.total.shape[1]), np.tile(np.arange(self.total.shape[1]), len(some))
        flat = self.total[some].ravel()
        return {"grp": grp, "pos": pos, "n": self.count[grp], "high": (flat >> 32).astype(np.int64), "low": (flat & 0xFFFFFFFF).astype(np.int64)} if len(some) else {c: np.empty(0, dtype=np.int64) for c in ("grp", "pos", "n", "high", "low")}


def added(sums: DataFrame, groups: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums (Python's integers) over all tasks' grp, pos, n, high, low: groups x width rows reach the driver."""
    count, total = np.zeros(groups, dtype=object), np.zeros((groups, width), dtype=object)
    for r in sums.groupBy("grp", "pos").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        count[r.grp] = r.n
        total[r.grp, r.pos] = (r.high << 32) + r.low
    return count, total


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def long_sum(values: str) -> Column:
    """The sum of a long column, at most the largest long."""
    return F.least(F.sum(F.col(values).cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
