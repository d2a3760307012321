"""Token ids in Arrow files of fixed-size lists: zero-copy random access to equal-length sequences and masks.

A data set is a folder of shards in ascending doc_id order. A shard `part-NNNNN.tokens.arrow` is an Arrow IPC
file without compression whose record batches hold `ids`, a fixed-size list of LENGTH unsigned integers of the
narrowest width that holds the vocabulary, and `mask`, a fixed-size list of LENGTH bytes (0 only on the padding of
the shard's last sequence, else 1); sequence i of a shard and its mask are found by position alone, memory-mapped,
both views of the file without copying. `part-NNNNN.index.arrow` lists the shard's documents: doc_id, offset (of the first id in the shard),
n_tokens. Each document's ids end with the end id.

Files are written under a name of the attempt and then renamed, and the same shard always has the same
content, so retried and speculative tasks are harmless. Shards and counts come back through a manifest of one
row a shard.

Shards are ranges of (doc_id, hash of the text, row), so that neither one id nor copies under one id make a shard
greater than others; their number follows the bytes of the texts (SHARD_BYTES each, and at least Spark's shuffle
partitions). A shard is written as it is encoded: a task holds one batch of texts, one of sequences and its index.

Results: null text is empty (one end id). A null doc_id sorts first. Repeated rows are written repeatedly.
Rows of equal doc_id are ordered by the hash of their text. A very long text may span any number of sequences. An
empty table gives shards without rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import array
import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import column, texts_of
from quire.session import bound_batches, open_fs, scratch_path

LENGTH, BATCH = 2048, 64
SHARD_BYTES = 256 << 20
#: Words kept with their ids by a worker, in two generations: a full one becomes the old one, whose words return when met again.
CACHE_WORDS = 1_000_000
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+")
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[^A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next code point from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class WordEncoder:
    """Ids by the tokenizers library. White space always ends a piece of this vocabulary, so a text's ids are
    those of its words; each different word is encoded once while it is in the table. A text that may hold an added
    token of the vocabulary goes through the whole pipeline, which gives such a token its own id.

    Words of Latin-1 letters and ASCII marks need no normalisation but lower case, so their pieces go to the
    library's model at once; every other word goes through the library's whole pipeline."""

    def __init__(self, content: bytes) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(content.decode("utf-8"))
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.code = next(c for c in "HIL" if array.array(c).itemsize == self.dtype.itemsize)
        described = f"{self.tokenizer.normalizer}{self.tokenizer.pre_tokenizer}"
        self.by_word = "Lowercase()" in described and "Removed, invert=True" in described and r"[^\s\p{L}\p{N}]+" in described
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        # found in lower case whatever their case; other letters that become an ASCII one are those of k and i only
        self.by_word = self.by_word and all(t.content.isascii() and not (t.normalized and set("ki") & set(t.content.lower())) for t in added)
        self.added = re.compile(b"|".join(re.escape(t.content.lower().encode()) for t in added) or rb"(?!)")
        self.letters = _byte_alphabet()
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        packed = array.array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if word.isalpha():  # ASCII letters: one piece
            return self._pack([t.id for t in self.model.tokenize(text.lower())])
        if not _PLAIN.fullmatch(text):
            return self._whole(text)
        ids: list[int] = []
        for part in _PARTS.findall(text.lower()):
            shown = part if part.isascii() else "".join([self.letters[b] for b in part.encode("utf-8")])
            ids += [t.id for t in self.model.tokenize(shown)]
        return self._pack(ids)

    def encode(self, raw: bytes) -> bytes:
        """The packed ids of one whole text."""
        if not self.by_word or self.added.search(raw.lower()):
            return self._whole(raw.decode("utf-8"))
        # words end at ASCII white space; other white space inside a word is left to the library
        words = raw.split()
        out = list(map(self.words.get, words))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self._met(words[i])
        return b"".join(out)

    def _met(self, word: bytes) -> bytes:
        """Ids of a word that isn't in the young generation."""
        ids = self.words.get(word) or self.old.get(word)
        if ids is None:
            low = word.lower()
            core = low.rstrip(_MARKS)
            if core and len(core) < len(low) and core[-1:].isalnum():  # marks after a letter or digit are a piece of their own
                ids = self._met(core) + self._met(low[len(core) :])
            elif low != word and word.isascii():
                ids = self._met(low)
            else:
                ids = self._word(word)
        if len(word) <= 64:
            if len(self.words) >= CACHE_WORDS // 2:
                self.old, self.words = self.words, {}
            self.words[word] = ids
        return ids


_encoders: dict[int, WordEncoder] = {}


def encoder(content: bytes) -> WordEncoder:
    """The encoder of a vocabulary file's content, built once in each process."""
    key = zlib.crc32(content)
    if key not in _encoders:
        _encoders[key] = WordEncoder(content)
    return _encoders[key]


def _write(fs, path: str, batches: Iterator[pa.RecordBatch], schema: pa.Schema, attempt: int) -> None:
    part = f"{path}.{attempt}.tmp"
    with fs.open_output_stream(part) as sink, pa.ipc.new_file(sink, schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    fs.move(part, path)


class _Sequences:
    """Cuts a stream of packed ids into batches of equal-length sequences."""

    def __init__(self, dtype: np.dtype, length: int) -> None:
        self.length, self.item = length, dtype.itemsize
        self.type = {2: pa.uint16(), 4: pa.uint32()}[self.item]
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("item", self.type, False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.uint8(), False), length), False)])

    def batch(self, packed: bytes) -> pa.RecordBatch:
        n = len(packed) // self.item
        rows = -(-n // self.length)
        full = packed + bytes((rows * self.length - n) * self.item)
        mask = np.zeros(rows * self.length, dtype=np.uint8)
        mask[:n] = 1
        ids = pa.Array.from_buffers(self.type, rows * self.length, [None, pa.py_buffer(full)])
        return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(v, type=f.type) for v, f in zip((ids, pa.array(mask)), self.schema)], schema=self.schema)

    def batches(self, stream: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        size = self.length * BATCH * self.item
        held = bytearray()
        for packed in stream:
            held += packed
            while len(held) >= size:
                yield self.batch(bytes(held[:size]))
                del held[:size]
        if held:
            yield self.batch(bytes(held))


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, length: int = LENGTH, shards: int | None = None) -> DataFrame:
    """Encode every text and write the data set; the manifest (shard, path, index_path, n_docs, n_tokens, item) as a table of one row a shard."""
    spark = bound_batches(docs.sparkSession)
    folder = folder or scratch_path(spark, "tokens")
    with open(vocabulary, "rb") as f:  # a file of the driver; executors get its content
        sent = spark.sparkContext.broadcast(f.read())
    if not shards:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    keys = ("doc_id", "_h", "_n")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_n"))
    ordered = rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        coder = encoder(sent.value)
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        ids, counts, total = [], [], 0

        def stream() -> Iterator[bytes]:
            nonlocal total
            for batch in batches:
                ids.append(column(batch, "doc_id"))
                for raw in texts_of(batch):
                    packed = coder.encode(raw) + end
                    counts.append(len(packed) // coder.dtype.itemsize)
                    total += counts[-1]
                    yield packed

        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        form = _Sequences(coder.dtype, length)
        path, index_path = f"{base}/part-{shard:05d}.tokens.arrow", f"{base}/part-{shard:05d}.index.arrow"
        _write(fs, path, form.batches(stream()), form.schema, attempt)
        doc_ids = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
        n = np.array(counts, dtype=np.int64)
        index = pa.RecordBatch.from_arrays([doc_ids, pa.array(np.cumsum(n) - n), pa.array(n)], names=["doc_id", "offset", "n_tokens"])
        _write(fs, index_path, iter([index]), index.schema, attempt)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(n)], "n_tokens": [total], "item": [coder.dtype.itemsize]}, schema=_MANIFEST_ARROW)

    manifest = ordered.mapInArrow(run, _MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return open_manifest(spark, folder)


_MANIFEST = "shard int, n_docs long, n_tokens long, item int"
_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("item", pa.int32())])


def open_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a data set with the start of each shard; one row a shard, so its order is a driver's matter."""
    rows = sorted(spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").collect(), key=lambda r: r.shard)
    starts = np.cumsum([0] + [r.n_tokens for r in rows])
    data = [(r.shard, f"{folder}/part-{r.shard:05d}.tokens.arrow", f"{folder}/part-{r.shard:05d}.index.arrow", int(s), r.n_docs, r.n_tokens) for r, s in zip(rows, starts)]
    frame = spark.createDataFrame(data, "shard int, path string, index_path string, start long, n_docs long, n_tokens long")
    return frame.repartition(max(1, len(data)), "shard")


class TokenShard:
    """A shard opened for random access; on a local file system nothing is copied."""

    def __init__(self, path: str) -> None:
        fs, base = open_fs(path)
        self.source = pa.memory_map(base) if type(fs).__name__ == "LocalFileSystem" else fs.open_input_file(base)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def _rows(self, batch: int, name: str) -> np.ndarray | pa.Array:
        return self.reader.get_batch(batch).column(self.reader.schema.get_field_index(name))

    def sequence(self, i: int) -> np.ndarray:
        """The ids of sequence i, a view of the file."""
        at = self._rows(i // BATCH, "ids")
        return at.flatten().to_numpy(zero_copy_only=True).reshape(-1, self.length)[i % BATCH]

    def mask(self, i: int) -> np.ndarray:
        """The mask of sequence i (1 where an id stands), a view of the file."""
        at = self._rows(i // BATCH, "mask")
        return at.flatten().to_numpy(zero_copy_only=True).reshape(-1, self.length)[i % BATCH]

    def span(self, offset: int, n: int) -> np.ndarray:
        """n ids from an offset of the shard's stream, across sequences."""
        size, parts = self.length * BATCH, []
        while n > 0:
            flat = self._rows(offset // size, "ids").flatten().to_numpy(zero_copy_only=True)
            part = flat[offset % size : offset % size + n]
            parts.append(part)
            offset, n = offset + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, dtype=np.uint16)


def read_index(path: str) -> pa.Table:
    fs, base = open_fs(path)
    with fs.open_input_file(base) as source:
        return pa.ipc.open_file(source).read_all()


def _stretches(counts: np.ndarray, rows: int = 1000, tokens: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Stretches of documents of so many rows and ids at most; a longer document is one of its own."""
    at, before = 0, np.concatenate(([0], np.cumsum(counts)))
    while at < len(counts):
        end = min(at + rows, max(at + 1, int(np.searchsorted(before, before[at] + tokens, side="right")) - 1))
        yield at, end
        at = end


def read_documents(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and with_ids the ids."""
    bound_batches(manifest.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, index = TokenShard(row["path"]), read_index(row["index_path"])
                for at, end in _stretches(index["n_tokens"].to_numpy()):
                    part = index.slice(at, end - at)
                    spans = [shard.span(o, n) for o, n in zip(part["offset"].to_pylist(), part["n_tokens"].to_pylist())]
                    crc = [zlib.crc32(s.astype("<u4").tobytes()) for s in spans]
                    columns = [part["doc_id"].combine_chunks(), pa.array(part["offset"].to_numpy() + row["start"]), part["n_tokens"].combine_chunks(), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.array([s.astype(np.int32) for s in spans], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return manifest.select("path", "index_path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)

