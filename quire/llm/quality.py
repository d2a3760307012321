"""Quality rules with an isolation forest on rule statistics.

Each document gets rule statistics; two fixed rules reject it outright (base_failed). The rest is judged by an
isolation forest: random trees over the statistics of labelled good documents isolate unlike documents after
few splits, so a short mean path means an anomaly. The threshold on the anomaly score is calibrated on
labelled rows: among all cuts, that with the best balanced accuracy while at least MIN_KEPT of the good
labelled rows stay; documents above it are rejected.

Training takes every labelled row, in Spark. The statistics are scaled by exact quantiles of all good rows. Half of these,
by a hash of doc_id, are dealt to the trees, each row to one at least and to more while trees would have fewer than SUBSAMPLE
rows; a tree grows where its rows meet and is cut at the depth of SUBSAMPLE rows, so the model keeps its size however many
rows there are. The threshold is sought among the scores of all the rows that no tree has seen. Without labels of both kinds
no cut is made and only the fixed rules reject.

An empty table gives no rows; a very long text is one row of a batch that is cut by bytes. Columns are kept whatever
their names. Equal scores at the cut stay.

Results: null and empty texts have no words and fail the base rule. Repeated rows give repeated results. A null
doc_id is judged like any other. Conflicting labels of one doc_id count as rejected (the lowest quality).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import column, map_batches, texts_of
from quire.llm.ranks import running
from quire.session import Scratch, bound_batches
from quire.llm.textops import WindowHasher, word_bounds, word_hashes

TREES, SUBSAMPLE, SEED = 200, 256, 20240917
MIN_KEPT = 0.995
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that the forest splits on, all independent of the document's length.
FEATURES = ["symbols_per_word", "dup_line_share", "repeat_share", "mean_word", "upper_share", "exclaim_share", "bar_share", "distinct_share", "digit_share", "mark_share"]

#: The columns of a tree's nodes, in the order of IsolationForest.grow.
_NODES = {"feature": "int", "cut": "double", "left": "int", "right": "int", "depth": "double"}

_SYMBOL, _CONT, _UPPER, _DIGIT = (np.zeros(256, dtype=bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_CONT[0x80:0xC0] = True
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_DIGIT[list(b"0123456789")] = True


def statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """The base counts and the forest's features of one text."""
    starts, ends = word_bounds(raw)
    n = len(starts)
    if not n:
        return [0] * len(BASE), [0.0] * len(FEATURES)
    data = np.frombuffer(raw, dtype=np.uint8)
    word_bytes = int((ends - starts).sum())
    points = word_bytes - int(_CONT[data].sum())
    symbols = int(_SYMBOL[data].sum())
    seen: set[bytes] = set()
    lines = dup_lines = 0
    for line in raw.split(b"\n"):
        if line and line.strip(b" \t\n\v\f\r"):
            lines += 1
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    hashes = word_hashes(raw, starts, ends)
    repeat = 0
    if n >= 3:
        windows = WindowHasher(hashes).windows(3)
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(len(windows), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : k + len(windows)] |= twice
        repeat = int(covered.sum())
    distinct = len(np.unique(hashes))
    first = data[starts]
    marks = int(np.isin(data[ends - 1], (33, 42, 36, 37, 38, 35)).sum())
    bars = int(((ends - starts == 1) & (first == 124)).sum())
    features = [symbols / n, dup_lines / max(1, lines), repeat / n, points / n, float(_UPPER[data].sum()) / max(1, points), raw.count(b"!") / n, bars / n, math.log(1 + distinct) / math.log(1 + n), float(_DIGIT[data].sum()) / max(1, points), marks / n]
    return [n, points, symbols, dup_lines, repeat], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


class IsolationForest:
    """Random trees stored as arrays; score near 1 for points isolated early, about 0.5 for ordinary ones.

    A split value is drawn from the range of the data widened by half of it, so that points outside what the trees have seen are isolated too."""

    def __init__(self, points: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.subsample = min(subsample, len(points))
        self.trees = [self.grow(points[rng.choice(len(points), self.subsample, replace=False)], rng, subsample) for _ in range(trees)]

    @classmethod
    def of(cls, trees: list[tuple[np.ndarray, ...]], rows: int) -> IsolationForest:
        """The forest of trees that have grown elsewhere, each on about so many rows."""
        forest = cls.__new__(cls)
        forest.subsample, forest.trees = rows, trees
        return forest

    @staticmethod
    def _expected(n: float) -> float:
        return 0.0 if n <= 1 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n

    @classmethod
    def grow(cls, points: np.ndarray, rng: np.random.Generator, subsample: int = SUBSAMPLE) -> tuple[np.ndarray, ...]:
        """A tree on all points, no deeper than one on subsample points: rows that share a leaf count by the length they would still need."""
        limit = max(1, math.ceil(math.log2(max(2, min(subsample, len(points))))))
        feature, cut, left, right, depth = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            at = len(feature)
            for column_, value in zip((feature, cut, left, right, depth), (-1, 0.0, 0, 0, 0.0)):
                column_.append(value)
            low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
            if level >= limit or not len(rows):
                depth[at] = level + cls._expected(len(rows))
                return at
            f = int(rng.integers(len(low)))
            width = high[f] - low[f]
            margin = 0.5 * width + 1e-3 * (1 + abs(high[f]))
            feature[at], cut[at] = f, float(rng.uniform(low[f] - margin, high[f] + margin))
            below = rows[:, f] < cut[at]
            left[at] = node(rows[below], level + 1)
            right[at] = node(rows[~below], level + 1)
            return at

        node(points, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(depth)

    def score(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(points), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                here = at[rows]
                below = points[rows, f[rows]] < cut[here]
                at[rows] = np.where(below, left[here], right[here])
            total += depth[at]
        return np.exp2(-total / len(self.trees) / max(1e-9, self._expected(self.subsample)))


def calibrate(scores: np.ndarray, good: np.ndarray, min_kept: float = MIN_KEPT) -> float:
    """The cut between two neighbouring scores with the best balanced accuracy that keeps min_kept of the good."""
    if good.all() or not good.any():
        return float("inf")
    order = np.argsort(scores)
    s, g = scores[order], good[order]
    kept_good = np.cumsum(g) / g.sum()
    kept_bad = np.cumsum(~g) / (~g).sum()
    merit = np.where(kept_good >= min_kept, kept_good - kept_bad, -1.0)
    merit[:-1][s[:-1] == s[1:]] = -1.0
    best = int(np.argmax(merit))
    if merit[best] <= 0:
        return float("inf")
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float("inf")


class Model:
    """A forest on standardised statistics and its threshold; without a forest it keeps all."""

    def __init__(self, forest: IsolationForest | None = None, low: np.ndarray | None = None, span: np.ndarray | None = None) -> None:
        self.forest, self.low, self.span, self.threshold = forest, low, span, float("inf")

    def scale(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.low) / self.span, -3.0, 4.0)

    def score(self, features: np.ndarray) -> np.ndarray:
        return self.forest.score(self.scale(features)) if self.forest is not None else np.zeros(len(features))

    def keeps(self, features: np.ndarray) -> np.ndarray:
        return self.score(features) <= self.threshold


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, the features (an array) and a hash of the text of every document."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch)
        rows = [statistics(t) for t in texts]
        return {"doc_id": column(batch, "doc_id"), "features": [r[1] for r in rows], "h": [xxhash.xxh64_intdigest(t) >> 1 for t in texts]} | {name: [r[0][i] for r in rows] for i, name in enumerate(BASE)}

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, " + ", ".join(f"{x} long" for x in BASE) + ", features array<double>, h long")


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quantiles(rows: DataFrame, shares: tuple[float, ...], tables: Scratch) -> np.ndarray:
    """The quantiles of each place of features over all rows (one row a share, as numpy interpolates them)."""
    valued = rows.select(F.posexplode("features").alias("f", "v")).groupBy("f", "v").agg(F.count("*").alias("n"))
    ranked = tables.keep(running(valued, ["f"], "v", ["n"], tables, "values"), "ranked")
    count = rows.count()
    places = [share * (count - 1) for share in shares]
    ranks = sorted({r for place in places for r in (math.floor(place), math.ceil(place))})
    held = " or ".join(f"(upto_n > {r} and upto_n - n <= {r})" for r in ranks)
    found = ranked.where(held).collect()  # a few values of each statistic
    at = {(r, x.f): x.v for x in found for r in ranks if x.upto_n - x.n <= r < x.upto_n}
    tables.drop("values", "ranked")
    return np.array([[at[math.floor(p), f] + (at[math.ceil(p), f] - at[math.floor(p), f]) * (p - math.floor(p)) for f in range(len(FEATURES))] for p in places])


def calibrated(scored: DataFrame, tables: Scratch, min_kept: float = MIN_KEPT) -> float:
    """calibrate() over all rows (score, good) of a table."""
    grouped = scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    total = scored.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).first()
    if not total.good or not total.bad:
        return float("inf")
    summed = tables.keep(running(grouped, [], "score", ["good", "bad"], tables, "scores"), "summed")
    kept = F.col("upto_good") / total.good
    best = summed.where(kept >= min_kept).select((kept - F.col("upto_bad") / total.bad).alias("merit"), "score").orderBy(F.desc("merit"), "score").limit(1).collect()
    after = summed.where(F.col("score") > best[0].score).agg(F.min("score")).first()[0]
    tables.drop("scores", "summed")
    return (best[0].score + after) / 2 if best[0].merit > 0 and after is not None else float("inf")


def forest_of(rows: DataFrame, count: int, scale: Callable[[np.ndarray], np.ndarray]) -> IsolationForest:
    """A forest on all of `count` rows (doc_id, features), each tree grown where its rows meet."""
    copies = min(TREES, max(1, -(-TREES * SUBSAMPLE // count)))
    # a row's trees are apart by a step that has no divisor in common with their number, so they differ and no two trees have the same rows
    steps = [x for x in range(1, TREES) if math.gcd(x, TREES) == 1]
    first, step = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(TREES)), F.get(F.array(*map(F.lit, steps)), F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(len(steps))).cast("int"))
    dealt = rows.select("doc_id", "features", first.alias("first"), step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    dealt = dealt.select("doc_id", "features", ((F.col("first") + F.col("step") * F.col("copy")) % TREES).cast("int").alias("tree"))

    def grown(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        number = int(frame["tree"].iloc[0])
        tree = IsolationForest.grow(scale(np.stack(frame["features"])), np.random.default_rng([SEED, number]))
        return pd.DataFrame({"tree": [number]} | {name: [part] for name, part in zip(_NODES, tree)})

    found = dealt.groupBy("tree").applyInPandas(grown, "tree int, " + ", ".join(f"{name} array<{kind}>" for name, kind in _NODES.items()))
    trees = [tuple(np.array(r[name]) for name in _NODES) for r in found.orderBy("tree").collect()]  # TREES rows
    return IsolationForest.of(trees, round(count * copies / TREES))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit and calibrate on all labelled documents."""
    return _trained(rule_statistics(docs), labels)


def _trained(stats: DataFrame, labels: DataFrame) -> Model:
    tables = Scratch(stats.sparkSession, "quality")
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # of several rows of one id always the same one, so that every run fits the same model
    one = stats.groupBy("doc_id").agg(F.min(F.struct("h", "n_words", "n_repeat_words", "features")).alias("s")).join(marked, "doc_id")
    usable = one.select("doc_id", "s.*", (F.col("quality") > 0).alias("good")).where(~_failed())
    rows = tables.keep(usable.select("doc_id", "good", "features", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("half")), "labelled")
    # fit on one half of the good rows and calibrate on the rest, so that the cut isn't set on what the trees have seen
    fit = F.col("good") & F.col("half")
    n = rows.agg(F.count("*").alias("rows"), F.count_if("good").alias("good"), F.count_if(fit).alias("fit")).first()
    model = Model()
    if n.good >= 8 and n.good < n.rows and n.fit:
        low, high = quantiles(rows.where("good"), (0.01, 0.99), tables)
        model = Model(None, low, np.maximum(high - low, 1e-3))
        model.forest = forest_of(rows.where(fit), n.fit, model.scale)
        sent = stats.sparkSession.sparkContext.broadcast(model)
        held = map_batches(rows.where(~fit).select("good", "features"), lambda batch: {"good": column(batch, "good"), "score": sent.value.score(_matrix(batch))}, "good boolean, score double")
        model.threshold = calibrated(tables.keep(held, "held"), tables)
    tables.drop("labelled", "held")
    return model


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def judge(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every document; statistics are taken once."""
    stats = rule_statistics(docs)
    if labels is not None:
        stats = Scratch(docs.sparkSession, "quality-statistics").keep(stats, "documents")
    model = _trained(stats, labels) if labels is not None else Model()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        score = sent.value.score(_matrix(batch))
        return {name: column(batch, name) for name in ("doc_id", *BASE)} | {"score": score, "normal": score <= sent.value.threshold}

    scored = map_batches(stats.drop("h"), work, "doc_id long, " + ", ".join(f"{x} long" for x in BASE) + ", score double, normal boolean")
    return scored.select("doc_id", *BASE, _failed().alias("base_failed"), "score", (~_failed() & F.col("normal")).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The documents that the rules and the forest keep, with their columns."""
    model = train(docs, labels) if labels is not None else Model()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts, features = zip(*[statistics(t) for t in texts_of(batch)])
                failed = np.array([base_failed(c[0], c[4]) for c in counts])
                yield batch.filter(pa.array(~failed & sent.value.keeps(np.array(features))))

    return docs.mapInArrow(run, docs.schema)
