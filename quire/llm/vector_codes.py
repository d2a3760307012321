"""Product codes of integer vectors by float32 screening with rigorous intervals.

A vector is cut into equal consecutive parts, and each part is replaced by the number of the nearest entry of its
position's codebook. For all entries at once the distance, less the part's own square, is a float32 matrix product:
|c|**2 - 2 x.c. Its rounding error is at most gamma(width + 4) (|c|**2 + 2 |x||c|), whatever the order of the sums, with
gamma(n) = n u / (1 - n u) and u = 2**-24 (four more roundings than terms: both factors on the way to float32, |c|**2
and the last subtraction). An entry whose interval lies above the least upper end can't be the nearest; every other
one is computed anew in 64-bit integers, and equal distances go to the lower index. A product that isn't finite bounds
nothing, so its entry is computed anew as well. The codes are therefore those of exact arithmetic.

Scale: the codebooks (parts x entries x width integers) are all that a task is given; each round is one pass over the
vectors whose tasks send counts and sums by entry, of which parts x entries x width rows reach the driver.

Results: rows whose vector is null, empty or holds null or non-finite components take no part, nor do vectors
whose length differs from that of the kept vector with the smallest vec_id whose length the parts divide. Rows count once each,
equal ones too; of equal vec_ids the smaller vector comes first, null ids come last. With fewer vectors than entries
the codebooks are shorter. Empty tables give no rows. Other columns are carried only if they are named."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import column
from quire.llm.vectors import GroupSums, added, as_long, batches_of, integers, long_sum, matrix_of, squared, whole_vectors
from quire.session import bound_batches, materialise

PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256
#: Label sums of at most so many labels are broadcast; more are joined by a shuffle that adaptive execution splits.
LABELS_SENT = 50_000
_UNIT = 2.0**-24


def nearest_entries(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and exact squared distance of the nearest of entries for each of rows (both 64-bit integers)."""
    with np.errstate(over="ignore", invalid="ignore"):
        square = (entries.astype(np.float64) ** 2).sum(axis=1)
        product = square.astype(np.float32) - np.float32(2) * (rows.astype(np.float32) @ entries.astype(np.float32).T)
        n = rows.shape[1] + 4
        gamma = n * _UNIT / (1 - n * _UNIT) * 1.001  # the last factor covers the rounding of the bound itself
        norm = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        error = gamma * (square + 2 * norm[:, None] * np.sqrt(square))
        middle = product.astype(np.float64)
        high = np.where(np.isfinite(middle), middle + error, np.inf).min(axis=1)
        open_still = ~(middle - error > high[:, None])
    row, entry = np.nonzero(open_still)
    exact = squared(rows[row], entries[entry])
    first = np.searchsorted(row, np.arange(len(rows)))
    least = np.minimum.reduceat(exact, first)
    hit = np.flatnonzero(exact == least[row])
    winner = hit[np.searchsorted(row[hit], np.arange(len(rows)))]  # entries ascend within a row: the first hit is the lowest
    return entry[winner], least


@dataclass
class Codes:
    """codebooks[part, entry, position], and rows with codes (binary, a byte a part), error, and the columns that were asked for."""

    codebooks: np.ndarray
    rows: DataFrame

    def fingerprint(self) -> str:
        """SHA-256 of all components, decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def reconstructed(self, factor: int = FACTOR) -> DataFrame:
        """rows with vector (array<double>): the entries that the codes name, put together and divided by factor."""
        books = self.codebooks
        schema = self.rows.schema
        out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "vector array<double>"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches_of(batches):
                codes = np.frombuffer(b"".join(column(batch, "codes").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                found = books[np.arange(books.shape[0]), codes].reshape(batch.num_rows, -1) / factor
                vector = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, vector], names=[*batch.schema.names, "vector"])

        return self.rows.mapInArrow(run, out)


def compress(vectors: DataFrame, carried: tuple[str, ...] = ("vec_id", "label"), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> Codes:
    """Codebooks from the entries vectors of smallest vec_id, moved by rounds of assignment and floored means, and the codes of all vectors."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte a part")
    spark = bound_batches(vectors.sparkSession)
    usable = vectors.where(whole_vectors(vectors) & (F.size("embedding") % parts == 0)).select(*carried, F.col("embedding").alias("_v"), F.size("embedding").alias("_width"))
    order = [F.asc_nulls_last("vec_id"), F.asc("_v")]
    first = usable.orderBy(*order).limit(1).select("_width").collect()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usable.schema if f.name in carried) + ", codes binary, error long"
    if not first:
        return Codes(np.empty((parts, 0, 0), dtype=np.int64), spark.createDataFrame([], schema))
    width, step = first[0]["_width"], first[0]["_width"] // parts
    kept = usable.where(F.col("_width") == width).drop("_width")
    start = kept.orderBy(*order).limit(entries).select("_v").collect()
    books = integers(np.array([r["_v"] for r in start], dtype=np.float64), factor).reshape(len(start), parts, step).transpose(1, 0, 2).copy()
    size = books.shape[1]

    def sums(books: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = GroupSums(parts * size, step)
            for batch in batches_of(batches):
                x = matrix_of(batch, "_v", width, factor)
                for p in range(parts):
                    mine = x[:, p * step : (p + 1) * step]
                    task.add(p * size + nearest_entries(mine, books[p])[0], mine)
            yield pa.RecordBatch.from_pydict({k: v.astype(np.int64) for k, v in task.columns().items()})

        return kept.select("_v").mapInArrow(run, "grp long, pos long, n long, high long, low long")

    for _ in range(rounds):
        count, total = added(sums(books), parts * size, step)
        moved = books.reshape(parts * size, step).copy()
        some = np.flatnonzero(count != 0)
        moved[some] = (total[some] // count[some][:, None]).astype(np.int64)
        books = moved.reshape(parts, size, step)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            x = matrix_of(batch, "_v", width, factor)
            codes, error = np.empty((batch.num_rows, parts), dtype=np.uint8), np.zeros(batch.num_rows, dtype=object)
            for p in range(parts):
                codes[:, p], distance = nearest_entries(x[:, p * step : (p + 1) * step], books[p])
                error += distance.astype(object)
            rows = [column(batch, c) for c in carried]
            yield pa.RecordBatch.from_arrays([*rows, pa.array([c.tobytes() for c in codes], type=pa.binary()), pa.array(as_long(error))], names=[*carried, "codes", "error"])

    return Codes(books, kept.mapInArrow(encode, schema))


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows (label, error) with label_error, the errors summed over equal labels, nulls together.

    The rows are kept in the shared folder, as they are read twice. Sums are gathered by task first. Their number is looked
    at: few go to every task, many are joined by a shuffle, where a label of many rows is split."""
    held = materialise(rows, "codes")
    sums = held.groupBy(F.col("label").alias("_label")).agg(long_sum("error").alias("label_error"))
    sums = materialise(sums, "label-errors")
    few = sums.count() <= LABELS_SENT
    return held.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
