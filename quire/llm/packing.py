"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. A document longer than the greatest is cut into full pieces of that
length and a rest. Pieces go in falling length: each into the open bin that it fills best (least room left);
where none has room, a new bin is opened at the capacity whose cost, shared over what it can still be filled
with from the pieces that remain, is least. In the end each bin is downsized to the least permitted capacity
that holds its contents. A bin of c positions costs OVERHEAD + c + c**2 / ATTENTION: the fixed price of a
sequence, the price of its positions padded or not, and that of attention, which grows with the square.

Documents are dealt by a hash of the row into blocks of about BLOCK_ROWS documents, and each block is
packed as a whole by one task, so memory and time a task don't grow with the input and the loss by cutting into
blocks is at most one badly filled bin of each capacity a block. pack() places documents by their words, for which only
ids and lengths are shuffled; sequences() encodes them, places their token ids, and writes each bin as one padded
sequence with its mask and segments.

Results: a document without words (null, empty) has one piece of length 0 in bin null in pack(), and is its end id in
sequences(). Repeated rows are packed as often as they come. Of open bins with equal room the one opened or used last
takes a piece. A very long text is many full pieces. An empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import column, texts_of
from quire.session import bound_batches

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD, ATTENTION = 32, 16_384
BLOCK_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


class Packer:
    """Best-fit over integer lengths; open bins are found by the least room that suffices in a bit set."""

    def __init__(self, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> None:
        self.capacities = tuple(sorted(set(capacities)))
        if not self.capacities or self.capacities[0] < 1:
            raise ValueError("capacities are positive")
        self.overhead, self.attention = overhead, attention

    def fit(self, contents: int) -> int:
        return next(c for c in self.capacities if c >= contents)

    def cost(self, capacity: int) -> float:
        return self.overhead + capacity + capacity * capacity / self.attention

    def opening(self, length: int, remaining: Callable[[int], int]) -> int:
        """The capacity to open for a piece; remaining(c) is the total length of later pieces of at most c."""
        best, least = self.capacities[-1], math.inf
        for c in self.capacities:
            if c >= length:
                filled = length + min(c - length, remaining(c - length))
                share = self.cost(self.fit(filled)) / filled
                if share < least - 1e-12:
                    best, least = c, share
        return best

    def pack(self, lengths: list[int]) -> list[tuple[int, int, int]]:
        """(bin, offset, capacity) of each length, all within 1 and the greatest capacity, given in falling order."""
        top = self.capacities[-1]
        # lengths fall, so the later pieces of at most c are the end of the list from some place on
        falling = np.array(lengths, dtype=np.int64)
        before = np.concatenate(([0], falling.cumsum())).tolist()
        first = np.searchsorted(-falling, -np.arange(top + 1)).tolist()
        rooms: list[list[int]] = [[] for _ in range(top + 1)]
        open_rooms = 0
        contents: list[int] = []
        placed: list[tuple[int, int]] = []
        for n, x in enumerate(lengths):
            suffices = open_rooms >> x
            if suffices:
                room = x + (suffices & -suffices).bit_length() - 1
                which = rooms[room].pop()
                if not rooms[room]:
                    open_rooms &= ~(1 << room)
            else:
                which, room = len(contents), self.opening(x, lambda c, later=n + 1: before[-1] - before[max(later, first[c])])
                contents.append(0)
            placed.append((which, contents[which]))
            contents[which] += x
            left = room - x
            if left:
                rooms[left].append(which)
                open_rooms |= 1 << left
        sizes = [self.fit(c) for c in contents]
        return [(b, at, sizes[b]) for b, at in placed]


def _placed(sized: DataFrame, rows: int, capacities: tuple[int, ...], overhead: int, attention: int, block_rows: int) -> DataFrame:
    """row, doc_id, n, piece, length, bin_id, offset, capacity of the pieces of sized (row, doc_id, n, deal): rows of it in all."""
    top = max(capacities)
    blocks = max(1, math.ceil(rows / block_rows))
    # by the row, not by the text alone: copies are no hot block
    dealt = sized.select("row", "doc_id", "n", "deal", F.pmod(F.xxhash64("deal", "row"), F.lit(blocks)).cast("int").alias("block"))
    packer = Packer(capacities, overhead, attention)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "deal", "doc_id", "row"], ascending=[False, True, True, True], kind="stable")
        block = int(frame["block"].iloc[0])
        found = []
        pieces = []
        for row, doc_id, n in zip(frame["row"].tolist(), frame["doc_id"].tolist(), frame["n"].tolist()):
            full, rest = divmod(n, top)
            for k in range(full):
                pieces.append((top, row, doc_id, n, k))
            if rest:
                pieces.append((rest, row, doc_id, n, full))
            if not n:
                found.append((row, doc_id, 0, 0, 0, None, 0, 0))
        pieces.sort(key=lambda p: -p[0])
        for (length, row, doc_id, n, k), (which, at, size) in zip(pieces, packer.pack([p[0] for p in pieces])):
            found.append((row, doc_id, n, k, length, (block << 32) + which, at, size))
        out = pd.DataFrame(found, columns=["row", "doc_id", "n", "piece", "length", "bin_id", "offset", "capacity"])
        for name in ("doc_id", "bin_id"):
            out[name] = pd.array([None if pd.isna(x) else int(x) for x in out[name]], dtype="Int64") if out[name].isna().any() else out[name].astype("int64")
        return out

    return dealt.groupBy("block").applyInPandas(work, "row long, doc_id long, n long, piece int, length long, bin_id long, offset long, capacity int")


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_words, piece (from 0), piece_words, bin_id, offset, capacity: a row for each piece, lengths in words.

    bin_id is block * 2**32 + bin; offset is the piece's first position within its bin."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", words.alias("n"), F.xxhash64("doc_id", "text").alias("deal"), F.monotonically_increasing_id().alias("row"))
    placed = _placed(sized, docs.count(), capacities, overhead, attention, block_rows)
    return placed.select("doc_id", F.col("n").alias("n_words"), "piece", F.col("length").alias("piece_words"), "bin_id", "offset", "capacity")


_PIECES = pa.schema([("doc_id", pa.int64()), ("deal", pa.int64()), ("piece", pa.int32()), ("length", pa.int64()), ("ids", pa.binary())])
_SEQUENCE = "bin_id long, capacity int, n_tokens long, ids array<int>, mask array<tinyint>, segments array<struct<doc_id:long,piece:int,start:long,length:long>>"
#: Rows of a batch of pieces or of sequences.
_BATCH = 256
#: Numbers within a block of the bins that are one full piece begin here, above those that are packed.
_FULL = 1 << 31


def _sequence_batch(made: list[tuple[int, int, list[tuple[int, int, np.ndarray]]]], pad_id: int) -> pa.RecordBatch:
    """Sequences (bin_id, capacity, parts (doc_id, piece, ids) in their order) as rows."""
    columns: dict[str, list] = {c: [] for c in ("bin_id", "capacity", "n_tokens", "ids", "mask", "segments")}
    for bin_id, size, parts in made:
        held = np.concatenate([p[2] for p in parts]).astype(np.int32)
        ids, mask = np.full(size, pad_id, dtype=np.int32), np.zeros(size, dtype=np.int8)
        ids[: len(held)], mask[: len(held)] = held, 1
        starts = np.cumsum([0, *(len(p[2]) for p in parts)])
        segments = [{"doc_id": d, "piece": k, "start": int(at), "length": len(x)} for (d, k, x), at in zip(parts, starts)]
        for name, value in (("bin_id", bin_id), ("capacity", size), ("n_tokens", len(held)), ("ids", ids), ("mask", mask), ("segments", segments)):
            columns[name].append(value)
    kinds = {"bin_id": pa.int64(), "capacity": pa.int32(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "mask": pa.list_(pa.int8()), "segments": pa.list_(pa.struct({"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64()}))}
    return pa.RecordBatch.from_arrays([pa.array(columns[n], type=t) for n, t in kinds.items()], names=list(kinds))


def sequences(docs: DataFrame, vocabulary: str, end_id: int, pad_id: int = 0, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The training sequences of docs: texts encoded by the vocabulary, an end id after each, packed and written out.

    bin_id, capacity, n_tokens, ids (capacity of them, pad_id after the last), mask (1 where an id stands, else 0), and
    segments: doc_id, piece, start and length of each piece in its order. Pieces are shuffled once, with their ids, to their
    blocks. A piece of the greatest capacity is written at once; a task holds only the rests of one block, which are under the
    greatest capacity each, and writes its sequences batch by batch."""
    from quire.llm import token_files

    spark = bound_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:  # a file of the driver; executors get its content
        sent = spark.sparkContext.broadcast(f.read())
    top, packer = max(capacities), Packer(capacities, overhead, attention)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = token_files.encoder(sent.value)
            end = np.array([end_id], dtype=encoder.dtype).tobytes()
            rows: list[tuple] = []
            for doc_id, deal, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "deal").to_pylist(), texts_of(batch)):
                ids = encoder.encode(text) + end
                step = top * encoder.dtype.itemsize
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, deal, k, len(part) // encoder.dtype.itemsize, part))
                    if len(rows) == _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, block, held, full, alone = None, None, [], 0, []

        def packed() -> Iterator[pa.RecordBatch]:
            bins: dict[int, tuple[int, list]] = {}
            for (doc_id, piece, ids), (which, _, size) in zip(held, packer.pack([len(p[2]) for p in held])):
                bins.setdefault(which, (size, []))[1].append((doc_id, piece, ids))
            made = [((block << 32) + which, size, parts) for which, (size, parts) in bins.items()]
            for at in range(0, len(made), _BATCH):
                yield _sequence_batch(made[at : at + _BATCH], pad_id)

        for batch in batches:
            kind = kind or token_files.encoder(sent.value).dtype
            for doc_id, piece, ids, here in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "piece", "ids", "block"))):
                if here != block:
                    if held:
                        yield from packed()
                    block, held, full = here, [], 0
                part = (doc_id, piece, np.frombuffer(ids, dtype=kind))
                if len(part[2]) < top:
                    held.append(part)
                    continue
                alone.append(((block << 32) + _FULL + full, top, [part]))
                full += 1
                if len(alone) == _BATCH:
                    yield _sequence_batch(alone, pad_id)
                    alone = []
        if alone:
            yield _sequence_batch(alone, pad_id)
        if held:
            yield from packed()

    blocks = max(1, math.ceil(docs.count() / block_rows))
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("deal"))
    pieces = keyed.mapInArrow(encode, "doc_id long, deal long, piece int, length long, ids binary")
    # by the row, not by the text alone: copies are no hot block
    block = F.pmod(F.xxhash64("deal", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    spread = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))) if blocks > 1 else 1
    dealt = pieces.withColumn("block", block).repartition(spread, "block").sortWithinPartitions("block", F.desc("length"), "deal", "doc_id", "piece")
    return dealt.select("doc_id", "piece", "ids", "block").mapInArrow(write, _SEQUENCE)
