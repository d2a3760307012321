"""Page selections: the range grammar, arrays of numbers, and their resolution against documents.

A specification is a comma-separated list of pages (`5`), closed (`1-3`) and open (`7-`) ranges. A range holds at
most MAX_RANGE pages after its first. The lowest bad part decides the error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import js

MAX_RANGE = 10_000
EMPTY_SET = "Page specification resulted in an empty set of pages."
NOT_POSITIVE = "Page numbers in array must be positive integers."


def charset_valid(spec: Column) -> Column:
    """Whether a specification holds digits, commas and hyphens only, white space aside, and is not empty."""
    return F.coalesce((F.length(spec) > 0) & js.strip_space(spec).rlike(r"^[0-9,-]+\z"), F.lit(False))


def array_valid(pages: Column) -> Column:
    """Whether an array of page numbers is not empty and holds integers from 1 only."""
    return F.coalesce((F.size(pages) > 0) & F.forall(pages, lambda p: p.isNotNull() & (p >= 1) & (p == F.floor(p))), F.lit(False))


def parsed_parts(spec: Column) -> Column:
    """array<struct<part_no, part, start_page, end_page, open, error>> of a specification."""

    # three passes over the parts, each naming what the next refers to, keep the expression small

    def split_part(raw: Column, n: Column) -> Column:
        part = js.trim(raw)
        return F.struct(n.alias("part_no"), part.alias("part"))

    def read(p: Column) -> Column:
        pieces = F.split(p["part"], "-", 3)
        ranged = p["part"].contains("-")
        end = F.when(ranged, F.get(pieces, F.lit(1)))
        last = F.when(end == "", F.lit(js.GREATEST)).otherwise(js.integer_prefix(F.coalesce(end, p["part"])))
        return F.struct(p["part_no"], p["part"], ranged.alias("ranged"), F.coalesce(end == "", F.lit(False)).alias("open"), js.integer_prefix(F.get(pieces, F.lit(0))).alias("first"), last.alias("last"))

    def judged(p: Column) -> Column:
        good = F.coalesce((p["first"] >= 1) & (p["first"] <= p["last"]), F.lit(False))
        kind = F.when(p["ranged"], F.lit("Invalid page range values: ")).otherwise(F.lit("Invalid page number: "))
        return F.struct(
            p["part_no"],
            p["part"],
            F.when(good, p["first"]).alias("start_page"),
            F.when(good, F.least(p["last"], p["first"] + MAX_RANGE)).alias("end_page"),
            (p["open"] & good).alias("open"),
            F.when(~good, F.concat(kind, p["part"])).alias("error"),
        )

    return F.transform(F.transform(F.transform(F.split(spec, ",", -1), split_part), read), judged)


def first_error(parts: Column) -> Column:
    return F.get(F.filter(parts, lambda p: p["error"].isNotNull()), F.lit(0))["error"]


def ranges_of_parts(parts: Column) -> Column:
    """The pages of all parts as disjoint rising ranges, array<struct<first, last>>; null if a part is bad.

    Ranges stay ranges until they meet a document's page count, so that an open range costs two numbers."""
    kind = "array<struct<first:bigint,last:bigint>>"
    good = F.filter(parts, lambda p: p["error"].isNull())
    rising = F.array_sort(F.transform(good, lambda p: F.struct(p["start_page"].alias("first"), p["end_page"].alias("last"))))

    def add(acc: Column, r: Column) -> Column:
        end = F.element_at(acc, -1)
        joined = F.struct(end["first"].alias("first"), F.greatest(end["last"], r["last"]).alias("last"))
        return F.when((F.size(acc) == 0) | (F.get(acc, F.size(acc) - 1)["last"] < r["first"] - 1), F.concat(acc, F.array(r))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))

    return F.when(first_error(parts).isNull(), F.aggregate(rising, F.array().cast(kind), add))


def pages_of_ranges(ranges: Column) -> Column:
    return F.flatten(F.transform(ranges, lambda r: F.sequence(r["first"], r["last"])))


def pages_of_parts(parts: Column) -> Column:
    """The distinct pages of all parts in rising order; null if a part is bad."""
    return pages_of_ranges(ranges_of_parts(parts))


def pages_of_array(pages: Column) -> Column:
    """The distinct pages of an array in rising order; null if it isn't valid."""
    return F.when(array_valid(pages), F.array_sort(F.array_distinct(F.transform(pages, lambda p: p.cast("long")))))


def array_error(pages: Column) -> Column:
    return F.when(F.size(pages) == 0, F.lit(EMPTY_SET)).when(~array_valid(pages), F.lit(NOT_POSITIVE))


def specification_error(source: Column, message: Column) -> Column:
    """The error of one source; null where there is none."""
    return F.concat(F.lit("Invalid page specification for source "), source, F.lit(": "), message)


def selected(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """specs with parts, spec_error, ranges and target (the pages); the last two are null for no or a bad specification."""
    given = F.when(F.length(spec) > 0, F.col(spec))
    found = specs.withColumn("parts", parsed_parts(given)).withColumn("spec_error", first_error(F.col("parts")))
    return found.withColumn("ranges", ranges_of_parts(F.col("parts"))).withColumn("target", pages_of_ranges(F.col("ranges")))


def resolve(documents: DataFrame, full_text: bool) -> DataFrame:
    """documents (num_pages, ranges, spec_error) with valid (pages to read) and invalid (requested beyond the end).

    Ranges are clamped to the document before they become pages. A selection decides even if full text is wanted."""
    total = F.col("num_pages").cast("long")
    every = F.when(total >= 1, F.sequence(F.lit(1).cast("long"), total)).otherwise(F.array().cast("array<bigint>"))
    none = F.array().cast("array<bigint>")
    within = F.flatten(F.transform(F.filter("ranges", lambda r: r["first"] <= total), lambda r: F.sequence(r["first"], F.least(r["last"], total))))
    beyond = F.flatten(F.transform(F.filter("ranges", lambda r: r["last"] > total), lambda r: F.sequence(F.greatest(r["first"], total + 1), r["last"])))
    failed = F.col("spec_error").isNotNull()
    out = documents.withColumn("valid", F.when(failed, none).when(F.col("ranges").isNotNull(), within).otherwise(every if full_text else none))
    return out.withColumn("invalid", F.when(failed | F.col("ranges").isNull(), none).otherwise(beyond))


def exceeds(ranges: Column, total: Column) -> Column:
    """Whether a selection goes beyond the last page, without listing by how much."""
    return F.coalesce(F.exists(ranges, lambda r: r["last"] > total), F.lit(False))


def warning(invalid: Column, total: Column) -> Column:
    """The one warning about pages beyond the end; null without such."""
    shown = invalid.cast("array<bigint>").cast("string")  # [4, 5, 6]
    listed = F.substring(shown, F.lit(2), F.length(shown) - 2)
    return F.when(F.size(invalid) > 0, F.concat(F.lit("Requested page numbers "), listed, F.lit(" exceed total pages ("), total.cast("string"), F.lit(").")))
