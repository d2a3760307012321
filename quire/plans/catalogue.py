"""The registered queries of the document-extraction operators, over the derived layout relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import images, layout, page_ranges, paths, requests, results, sharing, sink
from quire.plans.oracle import oracle_sql
from quire.session import scratch_path
from quire.sources import fixtures as fx
from quire.sources import loader, page_source

__all__ = ["oracle_sql", "queries"]

Query = Callable[[SparkSession, str], DataFrame]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(fx.runs(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).drop("block")


def _page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_texts(layout.all_pages(fx.doc_pages(spark, sf_dir)), _lines(spark, sf_dir))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_texts(spark, sf_dir).drop("block")


def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.full_texts(_page_texts(spark, sf_dir))


def _number() -> Column:
    return F.regexp_extract("path", "([0-9]+)[.]pdf$", 1).cast("long")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, length of the documents' PDF files, listed by the executors; who decodes a file reads it."""
    return loader.under(spark, fx.pdf_folder(spark, sf_dir)).select(_number().alias("doc_id"), "path", "length")


def _decoded_files(spark: SparkSession, sf_dir: str, every_page: bool) -> DataFrame:
    return loader.decode(_files(spark, sf_dir).withColumn("target", F.lit(None).cast("array<long>")), every_page)


def _seen_pages(spark: SparkSession, sf_dir: str, part_bytes: int = page_source.PART_BYTES) -> DataFrame:
    """The rows of the page source over the documents' files, keyed by doc_id."""
    return page_source.pages(spark, fx.pdf_folder(spark, sf_dir), part_bytes=part_bytes).withColumn("doc_id", _number())


def pdf_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the second and third page of each file: the filter reaches the reader, which decodes no other page."""
    return loader.page_texts(_seen_pages(spark, sf_dir).where("page between 2 and 3"))


def pdf_parted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts where files of over 16 kB are dealt out to several tasks by shares of their pages, each seeking its own."""
    return loader.page_texts(_seen_pages(spark, sf_dir, part_bytes=16_384))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_idx, doc_id, ranges (null: all pages) of the requests with a good specification."""
    return page_ranges.selected(fx.page_requests(spark, sf_dir)).where("spec_error is null").select("src_idx", "doc_id", "ranges")


def _decoded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = sharing.shared_targets(_asked(spark, sf_dir))
    return loader.decode(_files(spark, sf_dir).join(targets, "doc_id"))


def shared_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page texts of every request, each page of a file decoded once for all of them."""
    asked = _asked(spark, sf_dir).select(F.col("src_idx").alias("doc_id"), F.col("doc_id").alias("file"), "ranges")
    return sharing.fan_out(loader.page_texts(_decoded_once(spark, sf_dir)), asked).withColumnRenamed("doc_id", "src_idx")


def shared_decodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, decodings: how often each asked page was decoded."""
    return loader.selected_pages(_decoded_once(spark, sf_dir)).groupBy("doc_id", "page").agg(F.count("*").alias("decodings"))


def asked_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, first, last: the union of what the requests ask of each document, cut to its pages."""
    every = _asked(spark, sf_dir).withColumn("ranges", F.coalesce("ranges", sharing.ranges_to_end()))
    return sharing.clamped(sharing.union_of_ranges(sharing.exploded(every)), fx.doc_pages(spark, sf_dir))


def pdf_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts out of PDF files: scan, decoding, a row a page, whose lines are joined where it is decoded."""
    return loader.texts(_files(spark, sf_dir).withColumn("target", F.lit(None).cast("array<long>")))


def pdf_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of pages of each PDF file, without decoding a page."""
    return loader.heads(_decoded_files(spark, sf_dir, every_page=False)).select("doc_id", F.col("num_pages").cast("long").alias("num_pages"))


def stream_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.stream_page_texts(layout.all_pages(fx.doc_pages(spark, sf_dir)), fx.runs(spark, sf_dir))


def _painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.paint_ordinals(fx.paint_ops(spark, sf_dir))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.resolve_objects(_painted(spark, sf_dir), fx.image_objects(spark, sf_dir))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.valid_images(_resolved(spark, sf_dir))


def _ordered(spark: SparkSession, sf_dir: str, errors: bool = False) -> DataFrame:
    painted = _valid(spark, sf_dir).select("doc_id", "page", images.image_y(F.col("y")).alias("y"), "index")
    failed = fx.page_errors(spark, sf_dir) if errors else None
    return layout.reading_order(layout.items(_lines(spark, sf_dir), painted, failed))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("doc_id", "page", "item_ord", "type", "y")


def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("doc_id", "page", "item_ord", "type", "text", "index")


def content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.content_parts(_ordered(spark, sf_dir, errors=True)).select("doc_id", "ord", "type", "text", "mime_type")


def range_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_ranges.selected(fx.page_specs(spark, sf_dir)).select("spec_id", F.explode("parts").alias("p"))
    return found.select("spec_id", "p.part_no", F.when(F.col("p.error").isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"), "p.start_page", "p.end_page")


def range_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ranges.selected(fx.page_specs(spark, sf_dir)).select("spec_id", F.explode("target").alias("page"))


def range_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_ranges.selected(fx.page_specs(spark, sf_dir)).where("spec_error is not null")
    name = F.concat(F.lit("doc-"), F.col("spec_id").cast("string"))
    return found.select("spec_id", page_ranges.specification_error(name, F.col("spec_error")).alias("error"))


def array_spec_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.page_arrays(spark, sf_dir).select("spec_id", F.explode(page_ranges.pages_of_array(F.col("pages"))).alias("page"))


def array_spec_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.page_arrays(spark, sf_dir).select("spec_id", page_ranges.array_valid(F.col("pages")).alias("valid"), page_ranges.array_error(F.col("pages")).alias("error"))


def spec_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.charset_cases(spark, sf_dir).select("spec_id", page_ranges.charset_valid(F.col("spec")).alias("valid"))


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ranges.resolve(page_ranges.selected(fx.spec_of_documents(spark, sf_dir)), full_text=True)


def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sf_dir).select("doc_id", F.explode("valid").alias("page"))


def invalid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sf_dir).select("doc_id", F.explode("invalid").alias("page"))


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    warned = _selection(spark, sf_dir).where(page_ranges.exceeds(F.col("ranges"), F.col("num_pages")))
    return warned.select("doc_id", page_ranges.warning(F.col("invalid"), F.col("num_pages")).alias("warning"))


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.all_pages(fx.doc_pages(spark, sf_dir))


def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.doc_pages(spark, sf_dir)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.metadata_pairs(fx.doc_metadata(spark, sf_dir))


def source_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sources(spark, sf_dir).select("src_idx", requests.source_label(F.col("path"), F.col("url")).alias("source"))


def source_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.validity(fx.sources(spark, sf_dir))


def source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sources(spark, sf_dir).select("src_idx", requests.source_kind(F.col("path"), F.col("url")).alias("kind"))


def path_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sources(spark, sf_dir).select("src_idx", paths.path_status(F.col("path"), fx.ROOT).alias("p")).select("src_idx", "p.status", "p.resolved")


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = fx.sources(spark, sf_dir).select("src_idx", "path", paths.path_status(F.col("path"), fx.ROOT)["resolved"].alias("resolved"))
    return requests.missing_files(resolved, fx.files(spark, sf_dir))


def source_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.source_status(fx.sources(spark, sf_dir), fx.files(spark, sf_dir), fx.ROOT)


def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.status_json(source_results(spark, sf_dir))


def answers_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to requests of ten sources each."""
    return results.answers(source_results(spark, sf_dir), F.expr("src_idx div 10"))


def paint_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _painted(spark, sf_dir).select("doc_id", "page", "op_pos", "index")


def image_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("doc_id", "page", "index", "origin")


def valid_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir).select("doc_id", "page", "index", "width", "height")


def image_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.image_info(_valid(spark, sf_dir))


def image_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_info(spark, sf_dir).select("doc_id", "page", "index", "format")


def image_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _painted(spark, sf_dir).select("doc_id", "page", "index", images.image_y(F.col("y")).alias("y"))


def pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.pixel_statistics(_valid(spark, sf_dir))


def png_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _valid(spark, sf_dir).withColumn("data", images.pack_bytes("data"))
    return found.select("doc_id", "page", "index", images.png_udf("data", "width", "height", "kind").alias("png"))


def png_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the PNG files of the images hold when they are decoded again."""
    return png_images(spark, sf_dir).select("doc_id", "page", "index", images.png_statistics_udf("png").alias("s")).select("doc_id", "page", "index", "s.*")


def page_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.error_text(fx.page_errors(spark, sf_dir))


def typed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.typed_pairs(fx.doc_info(spark, sf_dir))


def _logos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.logos(spark, sf_dir).withColumn("data", images.pack_bytes("data"))


def image_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different image once, with the number of its placements."""
    return images.dictionary(_logos(spark, sf_dir)).select("key", "placements", "width", "height", "kind")


def shared_pngs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the PNG files of repeated images hold, each different one encoded once."""
    found = images.shared_pngs(_logos(spark, sf_dir))
    return found.select("doc_id", "page", "index", images.png_statistics_udf("png").alias("s")).select("doc_id", "page", "index", "s.*")


def ordered_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content parts of all documents, written in order and read back with their positions."""
    parts, folder = content_parts(spark, sf_dir), scratch_path(spark, "answer")
    sink.write_ordered(parts, folder, ["doc_id", "ord"])
    return sink.read_ordered(spark, folder, "doc_id long, ord long, type string, text string, mime_type string")


def batch_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents by their page specification, odd ones in full: one result of the batch each page.

    Ranges meet the runs by document and block before anything is grouped, so runs of pages that nobody asks for go no further."""
    asked = page_ranges.selected(fx.spec_of_documents(spark, sf_dir)).where("spec_error is null or doc_id % 2 = 1")
    wanted = asked.withColumn("ranges", F.when(F.col("doc_id") % 2 == 0, F.col("ranges")).otherwise(sharing.ranges_to_end()))
    ranges = sharing.exploded(wanted.select("doc_id", "num_pages", "ranges"), ["doc_id", "num_pages"]).where("first <= num_pages").withColumn("last", F.least("last", "num_pages")).drop("num_pages")
    texts = layout.page_texts(sharing.pages_within(ranges), layout.lines(sharing.within(fx.runs(spark, sf_dir), ranges)))
    mode = F.when(F.col("doc_id") % 2 == 0, F.lit("pages")).otherwise(F.lit("full_text"))
    return texts.select(F.col("doc_id").alias("src_idx"), mode.alias("mode"), "page", "text")


_NAMES = (
    "full_text page_texts stream_page_texts lines reading_order content_parts page_contents range_parts range_pages range_errors array_spec_pages spec_charset array_spec_valid "
    "selected_pages invalid_pages all_pages warnings page_count metadata source_label source_exclusive path_status source_kind missing_files paint_ordinals image_resolution "
    "valid_images image_info image_only image_y pixel_stats png_images png_pixels page_errors source_results results_json answers_json batch_mixed pdf_page_texts pdf_page_count "
    "pdf_first_pages pdf_parted_texts shared_page_texts shared_decodings asked_ranges typed_metadata image_dictionary shared_pngs ordered_sink"
)


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in _NAMES.split()}
