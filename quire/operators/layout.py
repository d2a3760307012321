"""Positioned text runs to lines, page texts and full texts.

Every operator takes and returns DataFrames keyed by doc_id. A document is dealt out by blocks of PAGE_BLOCK pages: runs
that come from one hash partitioning by doc_id and block stay in it, so lines, pages and blocks add no exchange, and a
document that holds a third of all runs is as many pieces as it has blocks. Only finished texts of blocks and counts of
blocks meet by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import js

PAGE_BLOCK = 64


def block_of(page: str = "page") -> Column:
    """The block that a page belongs to, from 0."""
    return F.expr(f"cast((`{page}` - 1) div {PAGE_BLOCK} as int)")


def with_block(pages: DataFrame) -> DataFrame:
    return pages if "block" in pages.columns else pages.withColumn("block", block_of())


def _joined(value: str, separator: str, order: str) -> Column:
    return F.expr(f"listagg({value}, '{separator}') WITHIN GROUP (ORDER BY {order})")


def lines(runs: DataFrame) -> DataFrame:
    """doc_id, block, page, y, line: runs with a position grouped by rounded y in stream order; blank lines are dropped, others not trimmed."""
    placed = with_block(runs.where(F.col("y").isNotNull())).select("doc_id", "block", "page", "seq", "str", js.round_half_up(F.col("y")).alias("y"))
    grouped = placed.groupBy("doc_id", "block", "page", "y").agg(_joined("str", "", "seq").alias("line"))
    return grouped.where(~js.is_blank(F.col("line")))


def _texts_of_pages(pages: DataFrame, parts: DataFrame, order: str) -> DataFrame:
    """doc_id, block, page, text of each of pages: its parts (part, and what order names) with nothing between.

    Pages go in as rows without a part, so that no join is needed; what belongs to other pages is left out."""
    blank = with_block(pages).select("doc_id", "block", "page", F.lit(None).cast("string").alias("part"))
    both = with_block(parts).unionByName(blank, allowMissingColumns=True).repartition("doc_id", "block")
    texts = both.groupBy("doc_id", "block", "page").agg(_joined("part", "", order).alias("text"), F.bool_or(F.col("part").isNull()).alias("asked"))
    return texts.where("asked").select("doc_id", "block", "page", F.coalesce("text", F.lit("")).alias("text"))


def page_texts(pages: DataFrame, lines_: DataFrame) -> DataFrame:
    """doc_id, block, page, text of each page (doc_id, page): its lines from the top with nothing between; pages without lines are ''."""
    return _texts_of_pages(pages, with_block(lines_).select("doc_id", "block", "page", "y", F.col("line").alias("part")), "y DESC")


def full_texts(page_texts_: DataFrame) -> DataFrame:
    """doc_id, num_pages, full_text: page texts in page order, a blank line between, blank pages included.

    In two levels: the pages of a block are joined where they are, then the blocks of a document."""
    blocks = with_block(page_texts_).groupBy("doc_id", "block").agg(F.count("*").alias("n"), _joined("text", "\\n\\n", "page").alias("text"))
    return blocks.groupBy("doc_id").agg(F.sum("n").cast("long").alias("num_pages"), _joined("text", "\\n\\n", "block").alias("full_text"))


def stream_page_texts(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, page, text with the runs in stream order whatever their position."""
    texts = with_block(runs.where("str is not null")).groupBy("doc_id", "block", "page").agg(_joined("str", "", "seq").alias("part"))
    return _texts_of_pages(pages, texts, "part").select("doc_id", "page", "text")


def all_pages(doc_pages: DataFrame) -> DataFrame:
    """doc_id, page for each page of doc_pages (doc_id, num_pages)."""
    return doc_pages.where("num_pages >= 1").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("num_pages").cast("int"))).alias("page"))


def items(lines_: DataFrame, images: DataFrame, page_errors: DataFrame | None = None) -> DataFrame:
    """doc_id, page, type, y, ordinal, text, index: lines and images of a page in one relation.

    A page with an error holds nothing but one text item with the message, at y 0."""
    text = lines_.select("doc_id", "page", F.lit("text").alias("type"), "y", F.lit(0).alias("ordinal"), F.col("line").alias("text"), F.lit(None).cast("int").alias("index"))
    image = images.select("doc_id", "page", F.lit("image").alias("type"), "y", F.col("index").alias("ordinal"), F.lit(None).cast("string").alias("text"), "index")
    both = text.unionByName(image)
    if page_errors is None:
        return both
    message = error_text(page_errors).select("doc_id", "page", F.lit("text").alias("type"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("ordinal"), "text", F.lit(None).cast("int").alias("index"))
    return both.join(page_errors.select("doc_id", "page"), ["doc_id", "page"], "left_anti").unionByName(message)


def error_text(page_errors: DataFrame) -> DataFrame:
    """doc_id, page, text of failed pages."""
    return page_errors.select("doc_id", "page", F.concat(F.lit("Error processing page: "), "message").alias("text"))


def reading_order(items_: DataFrame) -> DataFrame:
    """items with item_ord (from 1): from the top; on one height text before images, images in paint order."""
    order = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), F.desc("type"), "ordinal")
    return items_.withColumn("item_ord", F.row_number().over(order))


def content_parts(ordered: DataFrame) -> DataFrame:
    """doc_id, ord, type, text, mime_type: the parts of a document after its JSON part (ord 0), pages in order, without empty texts.

    Parts are numbered within their block of pages; the sums of the blocks before, of which there is a row a block, are added."""
    kept = with_block(ordered.where("type = 'image' or length(text) > 0"))
    counts = kept.groupBy("doc_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("doc_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("page", "item_ord"))
    mime = F.when(F.col("type") == "image", F.lit("image/png"))
    return kept.withColumn("local", local).join(starts, ["doc_id", "block"]).select("doc_id", (F.col("start") + F.col("local")).cast("long").alias("ord"), "type", "text", mime.alias("mime_type"), "page", "index")
