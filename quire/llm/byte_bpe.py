"""Byte-level BPE encoding and decoding in padded numpy matrices.

Pieces (matches of the pre-tokeniser's pattern) are bucketed by byte length into padded id matrices. Each
round every row merges its leftmost pair of minimum rank; the pair's rank comes from an open-addressing hash
table, merged cells are compacted away, and rows without a mergeable pair leave the matrix. Pieces over
LONG_PIECE bytes would need as many rounds as merges, each over the whole row, so they use a heap of pairs
with the same order (rank, position).

Results: null text is an empty text (no ids, empty bytes). Repeated rows give repeated results. A very long text is one
row of a batch that is cut by bytes; ties of rank go to the leftmost pair. An empty table gives no rows. Columns of
the input other than those named are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.batches import column, map_batches

LONG_PIECE = 1024
#: Pieces kept with their ids by a worker, longer ones for one batch only; the table is emptied when full.
CACHE_PIECES, CACHE_CHARS = 200_000, 256
_NONE = np.int32(2**31 - 1)


class Codec:
    """Encoder and decoder for one vocabulary of byte sequences by rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        self._build(pairs)
        self.cache: dict[str, tuple[bytes, int, bytes]] = {}
        self.passing: list[str] = []

    def _build(self, pairs: dict[int, int]) -> None:
        size = 1 << max(4, (4 * max(1, len(pairs))).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, _NONE, dtype=np.int32)
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        ranks = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        slot, probes = self._slot(keys), 0
        while len(keys):
            probes += 1
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            winner = np.zeros(len(keys), dtype=bool)
            winner[first] = True
            take = free & winner
            self.keys[slot[take]], self.values[slot[take]] = keys[take], ranks[take]
            keys, ranks = keys[~take], ranks[~take]
            slot = (slot[~take] + np.uint64(1)) & self.mask
        self.probes = probes

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)) & self.mask

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of id pairs; no rank where either is padding (negative) or the pair is unknown."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, _NONE, dtype=np.int32)
        flat, res = keys.ravel(), out.ravel()
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        slot = self._slot(flat[todo])
        while len(todo):
            seen = self.keys[slot]
            hit = seen == flat[todo]
            res[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (seen != -1)
            todo, slot = todo[go], (slot[go] + np.uint64(1)) & self.mask
        return res.reshape(keys.shape)

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        rows = np.arange(len(pieces))
        rank = self.pair_rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 1), _NONE, dtype=np.int32)
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            ended = best == _NONE
            if ended.any():
                for r, row in zip(rows[ended], ids[ended]):
                    out[r] = row[row >= 0]
                go = ~ended
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                if not len(rows):
                    break
                used = int((ids >= 0).sum(axis=1).max())
                ids, rank = ids[:, :used], rank[:, : used - 1]
            r = np.arange(len(rows))
            ids[r, at] = best
            width = ids.shape[1]
            keep = np.ones(ids.shape, dtype=bool)
            keep[r, at + 1] = False
            ids = ids[keep].reshape(len(rows), width - 1)
            if width == 2:
                rank = np.full((len(rows), 1), _NONE, dtype=np.int32)
                continue
            keep = np.ones(rank.shape, dtype=bool)
            keep[r, at] = False
            rank = rank[keep].reshape(len(rows), width - 2)
            has = at > 0
            rank[r[has], at[has] - 1] = self.pair_rank(ids[r[has], at[has] - 1], best[has])
            has = at < width - 2
            rank[r[has], at[has]] = self.pair_rank(best[has], ids[r[has], at[has] + 1])
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        ids = [int(self.single[b]) for b in piece]
        n, ranks, text = len(ids), self.ranks, self.bytes_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := ranks.get(text[ids[i]] + text[ids[j]])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, by length bucket (1, 2, 3-4, 5-8, ... bytes)."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > LONG_PIECE:
                out[i] = self._long(p)
            elif p:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
            else:
                out[i] = np.empty(0, dtype=np.int32)
        for level, members in buckets.items():
            rows = max(1, (1 << 20) >> level)
            for at in range(0, len(members), rows):
                part = members[at : at + rows]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part])):
                    out[i] = ids
        return out

    def encode(self, text: str) -> np.ndarray:
        parts = self.encode_pieces([p.encode("utf-8") for p in self.pattern.findall(text)])
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])

    def learn(self, pieces: set[str]) -> None:
        """Put the pieces that are not known yet into the table, encoded together."""
        for p in self.passing:
            self.cache.pop(p, None)
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache.clear()
            new = list(pieces)
        self.passing = [p for p in new if len(p) > CACHE_CHARS]
        for p, ids in zip(new, self.encode_pieces([p.encode("utf-8") for p in new])):
            got = ids.tolist()
            self.cache[p] = (",".join(map(str, got)).encode(), len(got), self.decode(got))


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


_codecs: dict[tuple[str, str], Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary file's content, built once in each process."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(parse_ranks(content), pattern)
    return _codecs[key]


def _shared(docs: DataFrame, vocabulary: str, pattern: str):
    with open(vocabulary, "rb") as f:  # a file of the driver; executors get its content
        content = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(content)
    return lambda: codec(sent.value, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and the ids of its text."""
    get = _shared(docs, vocabulary, pattern)

    def work(batch: pa.RecordBatch) -> dict:
        c = get()
        return {"doc_id": column(batch, "doc_id"), "ids": [c.encode(t or "") for t in column(batch, "text").to_pylist()]}

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for; null ids are none."""
    get = _shared(encoded, vocabulary, pattern)

    def work(batch: pa.RecordBatch) -> dict:
        c = get()
        return {"doc_id": column(batch, "doc_id"), "content": [c.decode(ids or []) for ids in column(batch, "ids").to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), work, "doc_id long, content binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encode each whole text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    get = _shared(docs, vocabulary, pattern)

    def work(batch: pa.RecordBatch) -> dict:
        c = get()
        n, ids_sha, text_sha = [], [], []
        pieces = [c.pattern.findall(t) if t else [] for t in column(batch, "text").to_pylist()]
        c.learn(set().union(*pieces))
        known = c.cache
        for doc in pieces:
            got = [known[p] for p in doc]
            n.append(sum([g[1] for g in got]))
            ids_sha.append(hashlib.sha256(b",".join([g[0] for g in got])).hexdigest())
            text_sha.append(hashlib.sha256(b"".join([g[2] for g in got])).hexdigest())
        return {"doc_id": column(batch, "doc_id"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
