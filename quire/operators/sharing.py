"""Requests that ask the same files: unions of page ranges, joins of pages with ranges by bins, fan-out of what was read once.

A range is (first, last), both included. Ranges and pages meet by bins of PAGE_BLOCK pages, the blocks that a document is
dealt out by, so neither side is compared page by page and a document that all ask for is many keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import layout, page_ranges

RANGES = "array<struct<first:bigint,last:bigint>>"


def ranges_of_pages(pages: Column) -> Column:
    """A sorted array of pages as ranges of one page each."""
    return F.transform(pages, lambda p: F.struct(p.cast("long").alias("first"), p.cast("long").alias("last")))


def ranges_to_end() -> Column:
    """One range over all the pages that a document may have."""
    return F.array(F.struct(F.lit(1).cast("long").alias("first"), F.lit((1 << 31) - 1).cast("long").alias("last")))


def exploded(asked: DataFrame, keys: str | list[str] = "doc_id") -> DataFrame:
    """keys, first, last of asked (keys, ranges)."""
    keys = [keys] if isinstance(keys, str) else keys
    return asked.select(*keys, F.explode("ranges").alias("r")).select(*keys, "r.first", "r.last")


def union_of_ranges(ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, first, last: the ranges of each key as disjoint ones that don't touch, by a sweep over their first pages.

    Of the ranges that begin on one page only the longest goes into the sweep, so a file that everybody asks for brings no
    more rows than it has pages."""
    longest = ranges.groupBy(key, "first").agg(F.max("last").alias("last"))
    sweep = Window.partitionBy(key).orderBy("first")
    reach = F.max("last").over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    begun = longest.withColumn("begins", F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0))
    numbered = begun.withColumn("piece", F.sum("begins").over(sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "piece").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("piece")


def shared_targets(asked: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, target: the pages that any request (key, ranges; null: all pages, empty: none) wants of each file; null for all."""
    every = asked.groupBy(key).agg(F.bool_or(F.col("ranges").isNull()).alias("every"))
    union = union_of_ranges(exploded(asked, key), key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("union"))
    pages = F.coalesce(page_ranges.pages_of_ranges(F.col("union")), F.array().cast("array<bigint>"))
    return every.join(union, key, "left").select(key, F.when(~F.col("every"), pages).alias("target"))


def fan_out(decoded: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of files decoded once (doc_id: the file's number, page null in heads) for each request (doc_id, file, ranges) that wants them."""
    rows = decoded.withColumnRenamed("doc_id", "file")
    wants = F.col("page").isNull() | F.col("ranges").isNull() | F.exists("ranges", lambda r: (r["first"] <= F.col("page")) & (F.col("page") <= r["last"]))
    return rows.join(asked.select("doc_id", "file", "ranges"), "file").where(wants).select(*decoded.columns)


def clamped(ranges: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """ranges (doc_id, first, last) cut to the pages that their documents have."""
    known = ranges.join(doc_pages.select("doc_id", "num_pages"), "doc_id").where("first <= num_pages")
    return known.withColumn("last", F.least("last", "num_pages")).drop("num_pages")


def binned(ranges: DataFrame) -> DataFrame:
    """ranges with a row for each block of pages that they reach into."""
    return ranges.withColumn("block", F.explode(F.sequence(layout.block_of("first"), layout.block_of("last"))))


def within(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (doc_id, page) with the other columns of each of ranges (doc_id, first, last) that they lie in: an equality join on document and block, then a look at the page."""
    met = layout.with_block(rows).join(binned(ranges), ["doc_id", "block"])
    return met.where("page between first and last").drop("first", "last")


def pages_within(ranges: DataFrame) -> DataFrame:
    """The pages of ranges, one row each, with the ranges' other columns."""
    return ranges.withColumn("page", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int")))).drop("first", "last")
