"""Toxicity of texts: disguised words are restored by a noisy channel, and a linear model scores the restored text.

1. A character language model is counted over all documents (deobfuscation.character_counts).
2. Features of a text are its distinct restored words and their beginnings of four to eight letters.
3. Labels are learned from rows whose crc32 of the id as text, modulo 5, is not 0, at most TRAIN_ROWS of them, half of
   them toxic where there are so many (those of least hash, a bounded sample). Features that toxic texts hold
   far more often than others are kept, FEATURES at most, and weighed by logistic regression
   that gives both classes the same mass.
4. Every text is scored by the sum of its features' weights; nothing else of a row is looked at.

Scale: counting words is one shuffle of distinct words by task; scoring is a map over texts, one at a time, with a
model of 8 MB at most (BUCKETS counts, FEATURES weights) in each worker.

Results: null texts count as empty, and a text without known features has the score of the intercept; equal texts
score alike, and every row has a result, repeated ones too. Labels with a null id or value are left out; of several labels of an id the
greatest counts. Without labels of both kinds the score is 0. A null id counts as held out. Empty tables give no rows; other columns are not
read."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import column, map_batches
from quire.llm.deobfuscation import Restorer, character_counts
from quire.session import Scratch

#: Labelled rows that are learned from at most, features kept at most.
TRAIN_ROWS, FEATURES, WORD = 12_000, 2_048, 24
#: A feature is kept if it stands in so many toxic texts, so many standard deviations above chance.
_LEAST, _FAR, _RIDGE, _STEPS = 3, 3.5, 2.0, 40
_STARTS = range(4, 9)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def features(words: Iterable[str]) -> list[str]:
    """The whole words of up to WORD letters, and the beginnings (marked by ~) of longer ones."""
    return [f for w in words for f in ([w] if 1 < len(w) <= WORD else []) + [f"{w[:k]}~" for k in _STARTS if len(w) > k]]


class Weights:
    """Logistic regression on binary features, the classes weighed alike."""

    def __init__(self, names: list[str], rows: list[np.ndarray], toxic: np.ndarray) -> None:
        """rows: numbers of the features of each text."""
        rate = toxic.mean() if len(toxic) else 0.0
        self.intercept, weight = -math.inf, np.zeros(len(names))
        if 0 < rate < 1:
            row, col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
            self.intercept, weight = _logistic(row, col, len(names), toxic, np.where(toxic > 0, 0.5 / rate, 0.5 / (1 - rate)))
        self.weight = dict(zip(names, weight.tolist()))

    def known(self, words: tuple[str, ...]) -> tuple[tuple[str, float], ...]:
        """The features of a token's words that have a weight."""
        return tuple((f, self.weight[f]) for f in features(words) if f in self.weight)

    def score(self, found: set[tuple[str, float]]) -> float:
        z = self.intercept + sum(w for _, w in sorted(found))
        return 0.0 if z < -700 else 1 / (1 + math.exp(-z))


def _logistic(row: np.ndarray, col: np.ndarray, count: int, y: np.ndarray, mass: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and ridge weights of rows of the given mass, by Newton steps on the sparse rows' normal equations."""
    n = len(y)
    w = np.zeros(count + 1)
    # the last column is the intercept's
    row, col = np.concatenate((row, np.arange(n))), np.concatenate((col, np.full(n, count)))
    x = np.zeros((n, count + 1), dtype=np.float32)
    x[row, col] = 1
    ridge = np.full(count + 1, _RIDGE)
    ridge[-1] = 1e-9

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((mass * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * w * w).sum())

    now = loss(w)
    for _ in range(_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        pull = x.T @ (mass * (p - y)) + ridge * w
        curve = (x * (mass * p * (1 - p)).astype(np.float32)[:, None]).T @ x
        step, size = np.linalg.solve(curve + np.diag(ridge), pull), 1.0
        while (after := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        if now - after < 1e-7 * abs(now):
            break
        w, now = w - size * step, after
    return float(w[-1]), w[:-1]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic of at most most labelled rows that aren't held out: half toxic where there are so many, by least hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col("toxic") == kind).orderBy(*order).limit(most // 2) for kind in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("_id"), "toxic"))  # at most most rows
    # one text of an id, the least, so that the rows stay within the bound
    return docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").cast("int").alias("toxic")).select("text", "toxic")


def select_features(rows: DataFrame, restored: Callable[[str], set], most: int = FEATURES) -> list[str]:
    """The features that toxic rows hold furthest above chance, counted by Spark; at most most of them reach the driver."""
    n, n1 = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not 0 < n1 < n:
        return []
    rate = n1 / n

    def work(batch: pa.RecordBatch) -> dict:
        seen: dict[str, list[int]] = {}
        for text, toxic in zip(column(batch, "text").to_pylist(), column(batch, "toxic").to_pylist()):
            for f in restored(text or ""):
                both = seen.setdefault(f, [0, 0])
                both[0] += 1
                both[1] += toxic
        return {"feature": list(seen), "n": [v[0] for v in seen.values()], "n1": [v[1] for v in seen.values()]}

    counted = map_batches(rows, work, "feature string, n long, n1 long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    far = (F.col("n1") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    kept = counted.withColumn("far", far).where((F.col("n1") >= _LEAST) & (F.col("far") >= _FAR))
    return sorted(r.feature for r in kept.orderBy(F.desc("far"), "feature").limit(most).select("feature").collect())


def fit(docs: DataFrame, labels: DataFrame, counts: Broadcast, most: int = TRAIN_ROWS) -> Weights:
    """Weights of the selected features; of each of at most most rows only the numbers of its features reach the driver."""
    tables = Scratch(docs.sparkSession, "toxicity")
    rows = tables.keep(training_rows(docs, labels, most), "rows")
    run = uuid.uuid4().hex
    names = select_features(rows, lambda text: _restorer(counts, f"{run} all", lambda words: tuple(features(words))).words(text))
    number = {f: i for i, f in enumerate(names)}

    def work(batch: pa.RecordBatch) -> dict:
        restorer = _restorer(counts, f"{run} numbers", lambda words: tuple(number[f] for f in features(words) if f in number))
        return {"numbers": [np.array(sorted(restorer.words(t or "")), dtype=np.int32).tobytes() for t in column(batch, "text").to_pylist()], "toxic": column(batch, "toxic")}

    found = map_batches(rows, work, "numbers binary, toxic int").toArrow()
    tables.drop("rows")
    taken = sorted(zip(found["numbers"].to_pylist(), found["toxic"].to_pylist()))  # one order, whatever the partitions
    return Weights(names, [np.frombuffer(n, dtype=np.int32) for n, _ in taken], np.array([t for _, t in taken], dtype=float))


_restorers: dict[str, Restorer] = {}


def _restorer(counts: Broadcast, run: str, told: Callable[[tuple[str, ...]], tuple]) -> Restorer:
    """The one of a run in a worker, so that what it remembers lasts over the worker's tasks; that of the run before goes."""
    if run not in _restorers:
        _restorers.clear()
        _restorers[run] = Restorer(counts.value, told=told)
    return _restorers[run]


def score(self, found: set[tuple[str, float]]) -> float:
        z = self.intercept + sum(w for _, w in sorted(found))
        return 0.0 if z < -700 else 1 / (1 + math.exp(-z))


def _logistic(row: np.ndarray, col: np.ndarray, count: int, y: np.ndarray, mass: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and ridge weights of rows of the given mass, by Newton steps on the sparse rows' normal equations."""
    n = len(y)
    w = np.zeros(count + 1)
    # the last column is the intercept's
    row, col = np.concatenate((row, np.arange(n))), np.concatenate((col, np.full(n, count)))
    x = np.zeros((n, count + 1), dtype=np.float32)
    x[row, col] = 1
    ridge = np.full(count + 1, _RIDGE)
    ridge[-1] = 1e-9

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((mass * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * w * w).sum())

    now = loss(w)
    for _ in range(_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        pull = x.T @ (mass * (p - y)) + ridge * w
        curve = (x * (mass * p * (1 - p)).astype(np.float32)[:, None]).T @ x
        step, size = np.linalg.solve(curve + np.diag(ridge), pull), 1.0
        while (after := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        if now - after < 1e-7 * abs(now):
            break
        w, now = w - size * step, after
    return float(w[-1]), w[:-1]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic of at most most labelled rows that aren't held out: half toxic where there are so many, by least hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col("toxic") == kind).orderBy(*order).limit(most // 2) for kind in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("_id"), "toxic"))  # at most most rows
    # one text of an id, the least, so that the rows stay within the bound
    return docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").cast("int").alias("toxic")).select("text", "toxic")


def select_features(rows: DataFrame, restored: Callable[[str], set], most: int = FEATURES) -> list[str]:
    """The features that toxic rows hold furthest above chance, counted by Spark; at most most of them reach the driver."""
    n, n1 = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not 0 < n1 < n:
        return []
    rate = n1 / n

    def work(batch: pa.RecordBatch) -> dict:
        seen: dict[str, list[int]] = {}
        for text, toxic in zip(column(batch, "text").to_pylist(), column(batch, "toxic").to_pylist()):
            for f in restored(text or ""):
                both = seen.setdefault(f, [0, 0])
                both[0] += 1
                both[1] += toxic
        return {"feature": list(seen), "n": [v[0] for v in seen.values()], "n1": [v[1] for v in seen.values()]}

    counted = map_batches(rows, work, "feature string, n long, n1 long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    far = (F.col("n1") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    kept = counted.withColumn("far", far).where((F.col("n1") >= _LEAST) & (F.col("far") >= _FAR))
    return sorted(r.feature for r in kept.orderBy(F.desc("far"), "feature").limit(most).select("feature").collect())


def fit(docs: DataFrame, labels: DataFrame, counts: Broadcast, most: int = TRAIN_ROWS) -> Weights:
    """Weights of the selected features; of each of at most most rows only the numbers of its features reach the driver."""
    tables = Scratch(docs.sparkSession, "toxicity")
    rows = tables.keep(training_rows(docs, labels, most), "rows")
    run = uuid.uuid4().hex
    names = select_features(rows, lambda text: _restorer(counts, f"{run} all", lambda words: tuple(features(words))).words(text))
    number = {f: i for i, f in enumerate(names)}

    def work(batch: pa.RecordBatch) -> dict:
        restorer = _restorer(counts, f"{run} numbers", lambda words: tuple(number[f] for f in features(words) if f in number))
        return {"numbers": [np.array(sorted(restorer.words(t or "")), dtype=np.int32).tobytes() for t in column(batch, "text").to_pylist()], "toxic": column(batch, "toxic")}

    found = map_batches(rows, work, "numbers binary, toxic int").toArrow()
    tables.drop("rows")
    taken = sorted(zip(found["numbers"].to_pylist(), found["toxic"].to_pylist()))  # one order, whatever the partitions
    return Weights(names, [np.frombuffer(n, dtype=np.int32) for n, _ in taken], np.array([t for _, t in taken], dtype=float))


_restorers: dict[tuple[int, str], Restorer] = {}


def _restorer(counts: Broadcast, kind: str, told: Callable[[tuple[str, ...]], tuple]) -> Restorer:
    """One for each model and kind in a worker, the last one, so that what it remembers lasts over batches."""
    key = (id(counts.value), kind)
    if key not in _restorers:
        _restorers.clear()
        _restorers[key] = Restorer(counts.value, told=told)
    return _restorers[key]


def score(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text), learned from labels (doc_id, toxic)."""
    counts = docs.sparkSession.sparkContext.broadcast(character_counts(docs))
    weights = fit(docs, labels, counts, most)

    run = uuid.uuid4().hex

    def work(batch: pa.RecordBatch) -> dict:
        restorer = _restorer(counts, run, weights.known)
        scores = [weights.score(restorer.words(t or "")) for t in column(batch, "text").to_pylist()]
        return {"doc_id": column(batch, "doc_id"), "held_out": column(batch, "held_out"), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return map_batches(rows, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
