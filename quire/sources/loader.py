"""Documents from files: binary scan, decoding on the executors, layout relations out of the decoded rows."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from itertools import compress, count, islice, pairwise
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import js
from quire.operators import layout
from quire.operators.paths import RequestError
from quire.session import BATCH_ROWS, bound_batches, open_fs
from quire.sources import ranged

#: A file of more bytes is dealt out by shares of its pages, one for so many bytes.
PART_BYTES = 8 << 20

_RUNS = "array<struct<seq:long,str:string,y:double>>"
_PAINTS = "array<struct<op_pos:int,fn:int,obj_name:string,y:double>>"
_OBJECT = "struct<name:string,width:int,height:int,kind:int,data:binary,problem:string>"
_HEAD = "struct<num_pages:int,info:string,metadata:string,error:string>"
#: A row with the head for each document, a row for each page, and a row for each image object of a page.
PAGES = f"head {_HEAD}, page int, error string, runs {_RUNS}, paints {_PAINTS}, object {_OBJECT}"
DECODED = f"doc_id long, {PAGES}"
_KEYS = {"doc_id": pa.int64(), "path": pa.string()}
#: PAGES as Arrow types; tasks have no session to ask for them.
_ARROW = {
    "head": pa.struct({"num_pages": pa.int32(), "info": pa.string(), "metadata": pa.string(), "error": pa.string()}),
    "page": pa.int32(),
    "error": pa.string(),
    "runs": pa.list_(pa.struct({"seq": pa.int64(), "str": pa.string(), "y": pa.float64()})),
    "paints": pa.list_(pa.struct({"op_pos": pa.int32(), "fn": pa.int32(), "obj_name": pa.string(), "y": pa.float64()})),
    "object": pa.struct({"name": pa.string(), "width": pa.int32(), "height": pa.int32(), "kind": pa.int32(), "data": pa.binary(), "problem": pa.string()}),
}
_LISTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())])
#: Pages of a batch of decoded rows at most; an image is a batch of its own.
_BATCH_PAGES = 64
#: Characters of a batch of finished texts, about.
_BATCH_CHARS = 1 << 20


def scan(spark: SparkSession, paths: list[str] | str, **options: str) -> DataFrame:
    """path, length, content of files; content is read only where it is used."""
    return spark.read.format("binaryFile").options(**options).load(paths).select("path", "length", "content")


def listed(folders: DataFrame) -> DataFrame:
    """path of the files directly in each of folders (folder: plain paths or URIs), listed by the executors; a folder that isn't there has none."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in given:
            for folder in batch.column(0).to_pylist():
                store, base = open_fs(folder)
                prefix = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
                found = store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if store.get_file_info(base).type == fs.FileType.Directory else []
                names = [prefix + f.path for f in found if f.is_file]
                for at in range(0, len(names), 10_000):
                    yield pa.RecordBatch.from_pydict({"path": names[at : at + 10_000]}, schema=pa.schema([("path", pa.string())]))

    spread = max(1, folders.sparkSession.sparkContext.defaultParallelism)
    return folders.select("folder").distinct().repartition(spread, "folder").mapInArrow(run, "path string")


def tasks_of(spark: SparkSession) -> int:
    """Tasks that paths are dealt to: told by number, as Spark would join partitions that hold a few bytes of names."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def under(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """path, length of the files in folder and below whose names end in suffix.

    One task lists the folder itself, others the folders in it: no name passes through the driver, whose memory doesn't
    depend on the number of files."""

    def listing(given: Iterator[pa.RecordBatch], deep: bool) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in given:
            yield batch.filter(pc.invert(batch.column("folder")))
            for path in batch.filter(batch.column("folder")).column("path").to_pylist():
                store, base = open_fs(path)
                prefix = path[: len(path) - len(base)] if path.endswith(base) else ""
                found = store.get_file_info(fs.FileSelector(base, recursive=deep))
                found = [f for f in found if f.path.endswith(suffix) and f.is_file or not deep and f.type == fs.FileType.Directory]
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    yield pa.RecordBatch.from_pydict({"path": [prefix + f.path for f in some], "length": [f.size if f.is_file else None for f in some], "folder": [not f.is_file for f in some]}, schema=_LISTED)

    names = "path string, length long, folder boolean"
    top = spark.createDataFrame([(folder, None, True)], names).coalesce(1).mapInArrow(lambda given: listing(given, False), names)
    return top.repartition(tasks_of(spark), "path").mapInArrow(lambda given: listing(given, True), names).select("path", "length")


def shares_of(files: DataFrame, part_bytes: int) -> DataFrame:
    """files (length, others) with shares, into how many parts of part_bytes each goes, and number: a row for each share."""
    shares = F.greatest(F.lit(1), F.ceil(F.col("length") / max(1, part_bytes))).cast("int")
    return files.withColumn("shares", shares).withColumn("number", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))


def decode_one(source: bytes | ranged.Source, wanted: Callable[[int], list[int]], with_images: bool, with_head: bool = True, share: tuple[int, int] = (0, 1), object_seconds: float = math.inf) -> Iterator[dict]:
    """One document's rows: an unreadable file is an error of its head, an unreadable page an error of that page, unreadable metadata absent.

    wanted gives the page numbers for a number of pages; of these the share (number, of how many) is decoded."""
    from quire.sources import pdf

    try:
        doc = pdf.Document(source)
    except Exception as e:
        if with_head:
            yield {"head": {"num_pages": None, "info": None, "metadata": None, "error": str(e) or "Unknown loading error"}}
        return
    if with_head:
        head: dict = {"num_pages": len(doc.pages), "info": None, "metadata": None, "error": None}
        try:
            head["info"] = json.dumps(doc.info(), ensure_ascii=False)
            head["metadata"] = json.dumps(doc.metadata(), ensure_ascii=False)
        except Exception:
            pass  # what was read before stays, as for any source whose metadata is damaged
        yield {"head": head}
    chosen, (number, shares) = wanted(len(doc.pages)), share
    for page in chosen[number * len(chosen) // shares : (number + 1) * len(chosen) // shares]:
        try:
            found = pdf.page_layout(doc, page, with_images, object_seconds=object_seconds)
        except Exception as e:
            yield {"page": page, "error": str(e)}
            continue
        yield {
            "page": page,
            "runs": (found.texts, found.heights),
            "paints": [{"op_pos": i, "fn": code, "obj_name": name, "y": m[5]} for i, (code, name, m) in enumerate(found.paints)] if with_images else [],
        }
        for name, o in found.images.items():
            yield {"page": page, "object": {"name": name, "problem": found.lost.get(name)} | o}
        doc.release()


def _wanted(target: list[int] | None, every_page: bool) -> Callable[[int], list[int]]:
    return lambda count: [p for p in target if p <= count] if target is not None else list(range(1, count + 1)) if every_page else []


def _run_lists(pages: list[tuple[list[str], list[float]] | None]) -> pa.Array:
    """The runs of pages, by their texts and heights, as a list column, made of flat columns."""
    sizes = [len(runs[0]) if runs else 0 for runs in pages]
    seq = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.empty(0, dtype=np.int64)
    texts, heights = ([v for runs in pages if runs for v in runs[at]] for at in (0, 1))
    values = pa.StructArray.from_arrays([pa.array(seq, pa.int64()), pa.array(texts, pa.string()), pa.array(heights, pa.float64())], fields=list(_ARROW["runs"].value_type))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values, type=_ARROW["runs"], mask=pa.array([runs is None for runs in pages]))


def batches(rows: Iterator[dict], key: str = "doc_id") -> Iterator[pa.RecordBatch]:
    """Rows in batches of few pages or of one image, so that no batch grows with a document."""
    schema = pa.schema({key: _KEYS[key]} | _ARROW)
    held: list[dict] = []

    def batch() -> pa.RecordBatch:
        columns = [_run_lists([row.get("runs") for row in held]) if f.name == "runs" else pa.array([row.get(f.name) for row in held], type=f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == _BATCH_PAGES or "object" in row:
            yield batch()
            held.clear()
    if held:
        yield batch()


_DEALT = ["doc_id", "path", "target", "shares", "number"]


def _dealt(files: DataFrame, part_bytes: int) -> DataFrame:
    """The shares of files (doc_id, path, length, target), each in the task that reads it."""
    return shares_of(files, part_bytes).select(_DEALT).repartition(tasks_of(files.sparkSession), "path", "number")


def _decoded(given: Iterator[pa.RecordBatch], every_page: bool, with_images: bool = False, with_heads: bool = False, object_seconds: float = math.inf) -> Iterator[dict]:
    """The rows of the shares that are dealt to a task, keyed by doc_id; the head of a file is told by its first share."""
    for batch in given:
        for row in batch.to_pylist():
            source = ranged.opened(row["path"])
            for found in decode_one(source, _wanted(row["target"], every_page), with_images, with_heads and row["number"] == 0, (row["number"], row["shares"]), object_seconds):
                yield {"doc_id": row["doc_id"]} | found
            source.close()


def decode(files: DataFrame, every_page: bool = True, with_images: bool = False, part_bytes: int = PART_BYTES, object_seconds: float = math.inf) -> DataFrame:
    """The rows of DECODED for each row of files (doc_id, target: pages wanted or null; content, or path and length, or all three).

    Only the pages wanted are decoded: the selection goes into the decoder, as nothing prunes behind it. A file of over
    part_bytes bytes whose path is known is dealt out by shares of its pages: only its path is shuffled, each task seeks what
    its pages need, and the scan doesn't read such contents. Other files stay where they were read; without a column content
every file is read by the task that its path is dealt to."""
    bound_batches(files.sparkSession)
    seekable = {"path", "length"} <= set(files.columns)
    plain = files.where(F.col("length") <= part_bytes) if seekable else files

    def whole(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in given for row in batch.to_pylist())
        # a batch holds pages of many files
        yield from batches({"doc_id": row["doc_id"]} | found for row in rows for found in decode_one(row["content"] or b"", _wanted(row["target"], every_page), with_images, object_seconds=object_seconds))

    def shared(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(_decoded(given, every_page, with_images, True, object_seconds))

    if "content" not in files.columns:
        return _dealt(files, part_bytes).mapInArrow(shared, DECODED)
    out = plain.select("doc_id", "content", "target").mapInArrow(whole, DECODED)
    if not seekable:
        return out
    great = shares_of(files.where(F.col("length") > part_bytes), part_bytes).select(_DEALT).repartition("doc_id", "number")
    return out.unionByName(great.mapInArrow(shared, DECODED))


def heads(decoded: DataFrame) -> DataFrame:
    """doc_id, num_pages, info, metadata (both variant: values keep their types), error: a row a document."""
    told = decoded.where("head is not null").select("doc_id", "head.*")
    return told.withColumn("info", F.try_parse_json("info")).withColumn("metadata", F.try_parse_json("metadata"))


def runs(decoded: DataFrame) -> DataFrame:
    """doc_id, page, seq, str, y."""
    return decoded.select("doc_id", "page", F.explode("runs").alias("r")).select("doc_id", "page", "r.*")


def paint_ops(decoded: DataFrame) -> DataFrame:
    """doc_id, page, op_pos, fn, obj_name, y."""
    return decoded.select("doc_id", "page", F.explode("paints").alias("o")).select("doc_id", "page", "o.*")


def image_objects(decoded: DataFrame) -> DataFrame:
    """scope, doc_id, page, name, width, height, kind, data."""
    return decoded.where("object is not null").select(F.lit("page").alias("scope"), "doc_id", "page", "object.*").drop("problem")


def lost_images(decoded: DataFrame) -> DataFrame:
    """doc_id, page, name, message of the images that are reported without data: no decoder, damage, or the deadline of an object."""
    return decoded.where("object.problem is not null").select("doc_id", "page", "object.name", F.concat(F.lit("Image "), "object.name", F.lit(" was not decoded: "), "object.problem").alias("message"))


def page_errors(decoded: DataFrame) -> DataFrame:
    """doc_id, page, message."""
    return decoded.where("error is not null").select("doc_id", "page", F.col("error").alias("message"))


def selected_pages(decoded: DataFrame) -> DataFrame:
    """doc_id, page of the pages that were decoded."""
    return decoded.where("page is not null and object is null").select("doc_id", "page")


def page_texts(decoded: DataFrame) -> DataFrame:
    """doc_id, page, text of every decoded page, from one decoding: a page goes along as a row of its own beside its runs."""
    each = decoded.where("page is not null and object is null").select("doc_id", "page", F.explode_outer("runs").alias("r")).select("doc_id", "page", "r.*")
    # one exchange by document and block serves the lines and the pages
    each = layout.with_block(each).repartition("doc_id", "block")
    # a page's rows end in one group, so pages need no list of their own: those without lines are told by their rows without a run
    rounded = each.select("doc_id", "block", "page", "seq", F.coalesce("str", F.lit("")).alias("str"), js.round_half_up(F.col("y")).alias("y"))
    lines = rounded.groupBy("doc_id", "block", "page", "y").agg(F.expr("listagg(str, '') WITHIN GROUP (ORDER BY seq)").alias("line"))
    shown = F.when(F.col("y").isNotNull() & ~js.is_blank(F.col("line")), F.col("line"))
    return lines.select("doc_id", "block", "page", "y", shown.alias("line")).groupBy("doc_id", "block", "page").agg(F.coalesce(F.expr("listagg(line, '') WITHIN GROUP (ORDER BY y DESC)"), F.lit("")).alias("text")).select("doc_id", "page", "text")


_SHOWN = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", f"[^{js.WHITE_SPACE}]"))


def _nearest(y: float) -> float:
    """js.round_half_up of a number."""
    if not math.isfinite(y):
        return 1 if math.isnan(y) else y
    below = math.floor(y)
    return below + (y - below >= 0.5)


def page_text(texts: list[str], heights: list[float]) -> str:
    """The text of a page by its runs in stream order, as layout.lines and layout.page_texts have it."""
    rounded = {y: _nearest(y) for y in set(heights)}
    at = list(map(rounded.__getitem__, heights))
    lines: dict[float, list[str]] = {}
    # runs of one line mostly follow one another
    edges = [0, *compress(count(1), map(ne, at, islice(at, 1, None))), len(at)] if at else []
    for begin, end in pairwise(edges):
        lines.setdefault(at[begin], []).append("".join(texts[begin:end]))
    return "".join([line for y in sorted(lines, reverse=True) if _SHOWN.search(line := "".join(lines[y]))])


def texts(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, page, text of every page of each of files (doc_id, path, length, target: pages wanted or null for all).

    The rows of page_texts(decode(files)); the task that decodes a page has all of its runs and joins them, so that only
    finished texts leave it and nothing but names is shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("text", pa.string())])

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str]] = []
        size = 0
        for row in _decoded(given, every_page=True):
            held.append((row["doc_id"], row["page"], page_text(*row.get("runs") or ((), ()))))
            size += len(held[-1][2])
            if len(held) == BATCH_ROWS or size > _BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    bound_batches(files.sparkSession)
    return _dealt(files, part_bytes).mapInArrow(run, "doc_id long, page int, text string")


def load_error(source: str, reason: str) -> str:
    return str(RequestError("InvalidRequest", f"Failed to load PDF document from {source}. Reason: {reason or 'Unknown loading error'}"))
