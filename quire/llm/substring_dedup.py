"""Substring dedup by level-wise doubling: 9, 18 and 35 words.

A window is WINDOW consecutive words of one document. Every window chooses the leftmost least hash among its
9-word windows, its anchor; equal windows choose the same anchor at the same place, so about one position in
fourteen stands for all windows (level 1). Anchors whose 9 words occur once alone end there. The windows
of one anchor lie within one span of words. Spans that are equal are taken together with their count, so a text
with thousands of copies is asked once. Then the length is doubled: the 18 words that begin and those that end with the
anchor's nine must repeat too (level 2), and what survives is doubled again, by two overlapping halves, to full
windows (level 3). Those that occur twice are repeated; no candidates are left after it.

Identity is by two 64-bit hashes together, that of the anchor and that of the span, half or window.

Levels are written to the shared folder; skewed anchors are aggregated before the shuffle and joined with a
unique side, which Spark splits by its own measure of the partitions.

Results: words are those of the whole text, however long, null and empty texts have none. An empty table gives no rows. Texts shorter than the window lose
nothing. Windows are judged on the input. Rows equal in id and text are documents of their own, repeat each
other, and are treated alike. Other columns are kept by deduplicate() whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import column, free_name, map_batches, texts_of, with_row_key
from quire.llm.textops import WindowHasher, leftmost_minimum, mix, word_bounds, word_hashes
from quire.session import Scratch, bound_batches

WINDOW, FIRST = 35, 9
_U = np.uint64


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray, WindowHasher]:
    starts, ends = word_bounds(raw)
    return starts, ends, WindowHasher(word_hashes(raw, starts, ends))


def _anchors(hasher: WindowHasher, window: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, its hash, least and greatest distance back to a window's start that chose it, and the span's hash."""
    short = hasher.windows(first)
    chosen = leftmost_minimum(short, window - first + 1)
    head = np.flatnonzero(np.diff(chosen, prepend=-1))
    tail = np.append(head[1:], len(chosen)) - 1
    at = chosen[head]
    far, near = at - head, at - tail
    span = hasher.ranges(head, tail + window)
    with np.errstate(over="ignore"):
        span = mix(span + far.astype(np.uint64) * _U(0x9E6C63D0876A9A47) + near.astype(np.uint64) * _U(0xB5297A4D3F84D5B5))
    return at, short[at], near, far, span


def _long(values: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(values).astype(np.uint64, copy=False).view(np.int64)) if values else pa.array([], pa.int64())


def anchors(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """Level 1: g (hash of the anchor's words), s (of its span), _k (row key), at, near, far."""

    def work(batch: pa.RecordBatch) -> dict:
        found: list[list[np.ndarray]] = [[] for _ in range(5)]
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for i, raw in enumerate(texts_of(batch)):
            if len(raw) >= 2 * window - 1:
                hasher = _hashed(raw)[2]
                if hasher.n >= window:
                    for held, values in zip(found, _anchors(hasher, window, first)):
                        held.append(values)
                    sizes[i] = len(found[0][-1])
        small = [pa.array(np.concatenate(v).astype(np.int32)) if v else pa.array([], pa.int32()) for v in (found[0], found[2], found[3])]
        return {"g": _long(found[1]), "s": _long(found[4]), "_k": column(batch, "_k").take(pa.array(np.repeat(np.arange(batch.num_rows), sizes))), "at": small[0], "near": small[1].cast(pa.int8()), "far": small[2].cast(pa.int8())}

    return map_batches(docs.select("_k", "text"), work, "g long, s long, _k binary, at int, near byte, far byte")


def _doubled(docs: DataFrame, requests: DataFrame, window: int, first: int) -> DataFrame:
    """Of each requested span the hashes of the halves before and after its anchor and of its windows (nearest first)."""
    asked = requests.groupBy("_k").agg(F.collect_list(F.struct("g", "s", "at", "near", "far", "n")).alias("asks"))
    joined = docs.select("_k", "text").join(asked, "_k")

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in ("g", "s", "n", "near", "head", "tail", "windows")}
        for raw, asks in zip(texts_of(batch), column(batch, "asks").to_pylist()):
            hasher = _hashed(raw)[2]
            for ask in asks:
                at, near, far = ask["at"], ask["near"], ask["far"]
                start = at - np.arange(near, far + 1)
                hashes = hasher.ranges(start, start + window)
                out["windows"].append(hashes.view(np.int64))
                for name, a, b in (("head", at + first - 2 * first, at + first), ("tail", at, at + 2 * first)):
                    inside = a >= 0 and b <= hasher.n
                    out[name].append(int(hasher.ranges(np.array([a]), np.array([b])).view(np.int64)[0]) if inside else None)
                for name in ("g", "s", "n", "near"):
                    out[name].append(ask[name])
        return out

    return map_batches(joined, work, "g long, s long, n long, near byte, head long, tail long, windows array<long>")


def repeated_windows(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """_k, hits: by row key the anchors and the bits of those distances back from them at which a repeated window starts. docs has _k and text."""
    if not 2 * first <= window <= 4 * first or window - first + 1 > 31:
        raise ValueError("the window is two to four times the first length and at most 30 words longer")
    tables = Scratch(docs.sparkSession, "substrings")
    level1 = tables.keep(anchors(docs, window, first), "level1")
    # a counted side is a table of its own, so that both sides of its join come from plain shuffles, whose skewed parts Spark splits
    several = tables.keep(level1.groupBy("g").count().where("count > 1").select("g"), "several")
    alive = tables.keep(level1.join(several, "g"), "alive")
    tables.drop("level1")
    spans = tables.keep(alive.groupBy("g", "s", "near", "far").agg(F.count("*").alias("n"), F.min(F.struct("_k", "at")).alias("of")), "spans")
    requests = spans.select("g", "s", "near", "far", "n", "of._k", "of.at")
    level2 = tables.keep(_doubled(docs, requests, window, first), "level2")
    heads = tables.keep(level2.where("head is not null").groupBy("g", "head").agg(F.sum("n").alias("c")).where("c > 1").select("g", "head", F.lit(True).alias("by_head")), "heads")
    tails = tables.keep(level2.where("tail is not null").groupBy("g", "tail").agg(F.sum("n").alias("c")).where("c > 1").select("g", "tail", F.lit(True).alias("by_tail")), "tails")
    survive = level2.join(heads, ["g", "head"], "left").join(tails, ["g", "tail"], "left").where("by_head or by_tail")
    each = survive.select("g", "s", "n", "near", "by_head", "by_tail", F.posexplode("windows").alias("i", "w")).withColumn("back", F.col("i") + F.col("near"))
    # a window that starts `first` or more words before the anchor holds the half before it, any other the half after it
    level3 = tables.keep(each.where(F.when(F.col("back") >= first, F.col("by_head")).otherwise(F.col("by_tail"))).select("g", "s", "n", "w", F.col("back").cast("byte").alias("back")), "level3")
    twice = tables.keep(level3.groupBy("g", "w").agg(F.sum("n").alias("c")).where("c > 1").select("g", "w"), "twice")
    bit = F.expr("shiftleft(1, cast(back as int))")
    bits = tables.keep(level3.join(twice, ["g", "w"]).groupBy("g", "s").agg(F.bit_or(bit).alias("bits")), "bits")
    tables.drop("several", "spans", "level2", "heads", "tails", "level3", "twice")
    hits = alive.select("g", "s", "_k", "at").join(bits, ["g", "s"]).select("_k", "at", "bits").distinct()
    out = tables.keep(hits.groupBy("_k").agg(F.collect_list(F.struct("at", "bits")).alias("_hits")), "hits")
    tables.drop("alive", "bits")
    return out


def removed_words(n: int, hits: list[dict] | None, window: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for hit in hits or ():
        at, bits = hit["at"], hit["bits"]
        while bits:
            back = bits.bit_length() - 1
            bits &= ~(1 << back)
            edge[at - back] += 1
            edge[at - back + window] -= 1
    return np.cumsum(edge[:n]) > 0


def kept_text(raw: bytes, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the removed words; white space before a kept word stays as it is."""
    if not gone.any():
        return raw
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    out, at = [], 0
    for a, b in zip(edges[0::2], edges[1::2]):
        out.append(raw[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(raw)
    return b"".join([*out, raw[at:]]).rstrip(b" \t\n\v\f\r")


def deduplicate(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """docs with the covered words cut out of text."""
    return _applied(docs, window, first, digest=False)


def removals(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    return _applied(docs.select("doc_id", "text"), window, first, digest=True)


def _applied(docs: DataFrame, window: int, first: int, digest: bool) -> DataFrame:
    bound_batches(docs.sparkSession)
    key, hits = free_name(docs, "_k"), free_name(docs, "_hits")
    keyed = with_row_key(docs, key)
    found = repeated_windows(keyed.select(F.col(key).alias("_k"), "text"), window, first).select(F.col("_k").alias(key), F.col("_hits").alias(hits))
    joined = keyed.join(found, key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], hits)
    where, names = docs.columns.index("text"), docs.columns

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
        for raw, hits in zip(texts_of(batch), batch.column(len(names)).to_pylist()):
            starts, ends = word_bounds(raw)
            yield raw, starts, ends, removed_words(len(starts), hits, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[: len(names)])
            null = columns[where].is_null().to_pylist()
            columns[where] = pa.array([None if n else kept_text(raw, starts, gone).decode("utf-8") for n, (raw, starts, _, gone) in zip(null, cut(batch))], type=batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def work(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": column(batch, "doc_id"), "n_words": [], "n_removed": [], "kept_sha256": []}
        for raw, _, _, gone in cut(batch):
            words = raw.split()
            kept = [w for w, x in zip(words, gone.tolist()) if not x] if gone.any() else words
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return out

    if digest:
        return map_batches(joined, work, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return joined.mapInArrow(run, docs.schema)
