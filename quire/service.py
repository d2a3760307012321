"""The tool surface: request validation, one batch of sources to ordered content parts, listing and dispatch.

A malformed request is refused as a whole before any Spark job; whatever fails in one source, its pages or its
metadata stays with that source.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import VariantVal

from quire.operators import images, layout, page_ranges, paths, requests, results, sharing, sink
from quire.operators.paths import RequestError
from quire.session import materialise
from quire.sources import loader, web

CHARSET = "Page string must contain only numbers, commas, and hyphens."
FLAGS = {"include_full_text": False, "include_metadata": True, "include_page_count": True, "include_images": False}
_NEEDS_WHITE = re.compile(r"\s")


@dataclass
class Source:
    path: str | None = None
    url: str | None = None
    pages: str | list[int] | None = None

    @property
    def label(self) -> str:
        return self.path if self.path is not None else self.url if self.url is not None else "unknown source"


@dataclass
class Request:
    sources: list[Source]
    flags: dict[str, bool] = field(default_factory=lambda: dict(FLAGS))


def _page_issue(pages: object) -> str | None:
    if isinstance(pages, str):
        if not pages:
            return "String must contain at least 1 character(s)"
        return None if re.fullmatch(r"[0-9,-]+", _NEEDS_WHITE.sub("", pages)) else CHARSET
    if isinstance(pages, list):
        if not pages:
            return "Array must contain at least 1 element(s)"
        whole = all(isinstance(p, (int, float)) and not isinstance(p, bool) and float(p).is_integer() and p >= 1 for p in pages)
        return None if whole else "Number must be an integer greater than or equal to 1"
    return "Invalid input"


def _source_issues(at: str, given: object) -> list[tuple[str, str]]:
    if not isinstance(given, dict):
        return [(at, "Expected object")]
    found = [(f"{at}", f"Unrecognized key(s) in object: '{k}'") for k in given if k not in ("path", "url", "pages")]
    path, url = given.get("path"), given.get("url")
    if path is not None and (not isinstance(path, str) or not path):
        found.append((f"{at}.path", "Expected string" if not isinstance(path, str) else "String must contain at least 1 character(s)"))
    if url is not None and (not isinstance(url, str) or not urlsplit(url).scheme or not (urlsplit(url).netloc or urlsplit(url).path)):
        found.append((f"{at}.url", "Invalid url"))
    if given.get("pages") is not None and (issue := _page_issue(given["pages"])):
        found.append((f"{at}.pages", issue))
    if not found and bool(path) == bool(url):
        found.append((at, requests.EXCLUSIVE))
    return found


def validate(args: object) -> Request:
    """The request with its defaults; all its faults are told in one refusal."""
    if not isinstance(args, dict):
        raise RequestError("InvalidParams", "Invalid arguments:  (Expected object)")
    issues = [("", f"Unrecognized key(s) in object: '{k}'") for k in args if k not in ("sources", *FLAGS)]
    sources = args.get("sources")
    if not isinstance(sources, list):
        issues.append(("sources", "Required" if sources is None else "Expected array"))
        sources = []
    elif not sources:
        issues.append(("sources", "Array must contain at least 1 element(s)"))
    for i, s in enumerate(sources):
        issues += _source_issues(f"sources.{i}", s)
    for name in FLAGS:
        if name in args and args[name] is not None and not isinstance(args[name], bool):
            issues.append((name, "Expected boolean"))
    if issues:
        raise RequestError("InvalidParams", "Invalid arguments: " + ", ".join(f"{at} ({message})" for at, message in issues))
    flags = {k: default if args.get(k) is None else args[k] for k, default in FLAGS.items()}
    return Request([Source(s.get("path"), s.get("url"), s.get("pages")) for s in sources], flags)


def _source_frame(spark: SparkSession, request: Request) -> DataFrame:
    rows = [(i, s.path, s.url, s.label, s.pages if isinstance(s.pages, str) else None, [int(p) for p in s.pages] if isinstance(s.pages, list) else None) for i, s in enumerate(request.sources)]
    frame = spark.createDataFrame(rows, "doc_id long, path string, url string, source string, spec string, listed array<long>")
    chosen = page_ranges.selected(frame)
    target = F.coalesce(F.col("target"), page_ranges.pages_of_array(F.col("listed")))
    ranges = F.coalesce(F.col("ranges"), sharing.ranges_of_pages(page_ranges.pages_of_array(F.col("listed"))))
    message = page_ranges.specification_error(F.col("source"), F.col("spec_error"))
    error = F.when(F.col("spec_error").isNotNull(), F.concat(F.lit(f"MCP error {RequestError.CODES['InvalidParams']}: "), message))
    return chosen.select("doc_id", "path", "url", "source", target.alias("target"), ranges.alias("ranges"), error.alias("error"))


Fetcher = Callable[[str], bytes]


def _located(spark: SparkSession, request: Request, refused: set[int], root: str, fetch: Fetcher | None) -> tuple[dict[int, str], dict[int, str], dict[int, str]]:
    """By source: the file's URI, the url to fetch, or the error."""
    wanted, urls, errors = {}, {}, {}
    for i, s in enumerate(request.sources):
        if i in refused:
            continue
        try:
            if s.path:
                wanted[i] = paths.resolve_path(s.path, root)
            elif s.url:
                if fetch is None or not re.match(r"https?://", s.url, re.I):
                    raise RequestError("InvalidRequest", f"Failed to load PDF document from {s.url}. Reason: fetching of urls is off")
                urls[i] = s.url
            else:
                raise RequestError("InvalidParams", f"Source {s.label} missing 'path' or 'url'.")
        except RequestError as e:
            errors[i] = str(e)
    if wanted:
        asked = spark.createDataFrame([(i, request.sources[i].path, full, os.path.dirname(full)) for i, full in wanted.items()], "src_idx long, path string, resolved string, folder string")
        for r in requests.missing_files(asked, loader.listed(asked)).collect():  # a row for each source of the request at most
            errors[r.src_idx] = str(RequestError("InvalidRequest", r.error))
            del wanted[r.src_idx]
    return wanted, urls, errors


def fetched(spark: SparkSession, urls: dict[int, str], fetch: Fetcher) -> DataFrame:
    """doc_id, content, failure of each url, fetched by the executors, each once: the result is kept in the shared folder."""
    return materialise(web.fetched(spark.createDataFrame(list(urls.items()), "doc_id long, url string"), fetch), "fetched")


def _layout(decoded: DataFrame, with_images: bool) -> tuple[DataFrame, DataFrame]:
    """The ordered items of every decoded page, and its valid images."""
    pictures = images.valid_images(images.resolve_objects(images.paint_ordinals(loader.paint_ops(decoded)), loader.image_objects(decoded)))
    if not with_images:
        pictures = pictures.limit(0)
    placed = pictures.select("doc_id", "page", images.image_y(F.col("y")).alias("y"), "index")
    return layout.reading_order(layout.items(layout.lines(loader.runs(decoded)), placed, loader.page_errors(decoded))), pictures


def _columns(request: Request, decoded: DataFrame, ordered: DataFrame, pictures: DataFrame) -> DataFrame:
    """doc_id and per document: page texts, image info; arrays in their order."""
    text = ordered.where("type = 'text'").groupBy("doc_id", "page").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY item_ord)").alias("text"))
    pages = loader.selected_pages(decoded).join(text, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))
    out = loader.heads(decoded).withColumnRenamed("error", "load_error")
    out = out.join(pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("page_texts")), "doc_id", "left")
    if request.flags["include_images"]:
        told = ordered.where("type = 'image'").select("doc_id", "page", "item_ord", "index").join(images.image_info(pictures), ["doc_id", "page", "index"])
        told = told.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "item_ord", "index", "width", "height", "format"))).alias("image_info"))
        out = out.join(told, "doc_id", "left").withColumn("image_info", F.transform("image_info", lambda i: F.struct(i["page"].alias("page"), i["index"].alias("index"), i["width"].alias("width"), i["height"].alias("height"), i["format"].alias("format"))))
    return out


def read_documents(spark: SparkSession, args: object, root: str, fetch: Fetcher | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, parts) of a request.

    results: src_idx, source, success, data, error in one row a source; parts: src_idx, page, item_ord, type, text,
    data (base64 PNG), mime_type. Urls are fetched by the executors with the caller's fetch, which has to be picklable;
    without it they are refused. What was decoded is kept in the shared folder, so nothing stays cached."""
    request = validate(args)
    asked = _source_frame(spark, request)
    known = {r.doc_id: r for r in asked.collect()}  # a row for each source of the request
    spec_errors = {i: r.error for i, r in known.items() if r.error}
    files, urls, errors = _located(spark, request, set(spec_errors), root, fetch)
    errors |= spec_errors
    flags = request.flags
    # what several sources ask of one file or url is read and decoded once, the union of their pages, and given to each
    names = sorted({*files.values(), *urls.values()})
    number = {name: n for n, name in enumerate(names)}
    of = spark.createDataFrame([(i, number[name]) for i, name in (files | urls).items()], "doc_id long, file long")
    nothing = F.array().cast(sharing.RANGES)
    ranges = F.col("ranges") if flags["include_full_text"] else F.coalesce("ranges", nothing)
    wanted = asked.join(of, "doc_id").select("doc_id", "file", ranges.alias("ranges"))
    schema = "doc_id long, path string, length long, content binary"
    on_disk = spark.createDataFrame([], schema)
    if files:
        where = spark.createDataFrame([(number[p], f"file:{p}" if p.startswith("/") else p) for p in set(files.values())], "doc_id long, uri string")
        on_disk = loader.scan(spark, sorted(set(files.values()))).join(F.broadcast(where), F.col("path") == F.col("uri")).select("doc_id", "path", "length", "content")
    if urls:
        got = fetched(spark, {number[u]: u for u in set(urls.values())}, fetch)
        failures = {r.doc_id: r.failure for r in got.where("failure is not null").select("doc_id", "failure").collect()}  # a row for each url of the request
        for i, url in urls.items():
            if number[url] in failures:
                errors[i] = str(RequestError("InvalidRequest", f"Failed to load PDF document from {url}. Reason: {failures[number[url]]}"))
        on_disk = on_disk.unionByName(got.where("failure is null").select("doc_id", F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("length"), "content"))
    documents = on_disk.join(F.broadcast(sharing.shared_targets(wanted.select(F.col("file").alias("doc_id"), "ranges"))), "doc_id")
    once = materialise(loader.decode(documents, flags["include_full_text"], flags["include_images"]), "decoded")
    decoded = sharing.fan_out(once, wanted)
    ordered, pictures = _layout(decoded, flags["include_images"])
    found = _columns(request, decoded, ordered, pictures)
    told = spark.createDataFrame([(i, e) for i, e in errors.items()], "doc_id long, told string")
    joined = asked.drop("error").join(found, "doc_id", "left").join(told, "doc_id", "left")
    failed = F.concat(F.lit(f"MCP error {RequestError.CODES['InvalidRequest']}: Failed to load PDF document from "), "source", F.lit(". Reason: "), "load_error")
    joined = joined.withColumn("error", F.coalesce("told", F.when(F.col("load_error").isNotNull(), failed)))
    beyond = F.filter("target", lambda p: p > F.col("num_pages"))
    some = F.size("page_texts") > 0
    joined = (
        joined.withColumn("success", F.col("error").isNull())
        .withColumn("warnings", F.when(F.size(beyond) > 0, F.array(page_ranges.warning(beyond, F.col("num_pages")))))
        .withColumn("full_text", F.when(F.col("target").isNull() & some, F.array_join(F.transform("page_texts", lambda p: p["text"]), "\n\n")))
        .withColumn("page_texts", F.when(F.col("target").isNotNull() & some, F.col("page_texts")))
    )
    answer = joined.select(F.col("doc_id").alias("src_idx"), results.result_struct(flags).alias("r")).select("src_idx", "r.*")
    # each different image of the request is encoded once, wherever it stands
    parts = ordered.join(images.shared_pngs(pictures), ["doc_id", "page", "index"], "left") if flags["include_images"] else ordered.withColumn("png", F.lit(None).cast("string"))
    mime = F.when(F.col("type") == "image", F.lit("image/png"))
    parts = parts.where("type = 'image' or length(text) > 0").select(F.col("doc_id").alias("src_idx"), "page", "item_ord", "type", "text", F.col("png").alias("data"), mime.alias("mime_type"))
    return answer, parts


def handle(spark: SparkSession, args: object, root: str, fetch: Fetcher | None = None) -> dict:
    """The answer of one request: its JSON part, then texts and images in order. The size is the request's."""
    answer, parts = read_documents(spark, args, root, fetch)
    rows = [r.asDict(recursive=True) for r in answer.orderBy("src_idx").collect()]
    for row in rows:
        del row["src_idx"]
        if row.get("data"):
            row["data"] |= {k: v.toPython() for k, v in row["data"].items() if isinstance(v, VariantVal)}
    content = [{"type": "text", "text": results.pretty(rows)}]
    for p in parts.orderBy("src_idx", "page", "item_ord").collect():
        content.append({"type": "text", "text": p.text} if p.type == "text" else {"type": "image", "data": p.data, "mimeType": p.mime_type})
    return {"content": content}


PART = "src_idx long, page int, item_ord int, type string, text string, data string, mime_type string"


def write_answer(spark: SparkSession, args: object, root: str, folder: str, fetch: Fetcher | None = None) -> DataFrame:
    """The answer of one request as files: results as JSON lines, a row a source, and the ordered parts (sink.read_ordered, PART).

    Nothing of it passes through the driver. Returns the parts' manifest."""
    answer, parts = read_documents(spark, args, root, fetch)
    answer.repartitionByRange("src_idx").sortWithinPartitions("src_idx").write.json(f"{folder}/results")
    return sink.write_ordered(parts, folder, ["src_idx", "page", "item_ord"])


def input_schema() -> dict:
    """The JSON Schema of a request."""
    pages = {"anyOf": [{"type": "array", "items": {"type": "integer", "minimum": 1}, "minItems": 1}, {"type": "string", "minLength": 1}]}
    source = {"type": "object", "properties": {"path": {"type": "string", "minLength": 1}, "url": {"type": "string", "format": "uri"}, "pages": pages}, "additionalProperties": False}
    flags = {name: {"type": "boolean", "default": default} for name, default in FLAGS.items()}
    return {"type": "object", "properties": {"sources": {"type": "array", "items": source, "minItems": 1}, **flags}, "required": ["sources"], "additionalProperties": False}


@dataclass
class Tool:
    name: str
    description: str
    schema: Callable[[], dict]
    handler: Callable[..., dict]


TOOLS = {"read_pdf": Tool("read_pdf", "Text, metadata and images of PDF files, whole or by pages.", input_schema, handle)}


def list_tools() -> dict:
    return {"tools": [{"name": t.name, "description": t.description, "inputSchema": t.schema()} for t in TOOLS.values()]}


def call_tool(spark: SparkSession, name: str, args: object, root: str, fetch: Fetcher | None = None) -> dict:
    if name not in TOOLS:
        raise RequestError("MethodNotFound", f"Unknown tool: {name}")
    return TOOLS[name].handler(spark, args, root, fetch)
