"""Predicates and labels of requested sources (src_idx, path, url, pages_spec)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCLUSIVE = "Each source must have either 'path' or 'url', but not both."


def source_label(path: Column, url: Column) -> Column:
    return F.coalesce(path, url, F.lit("unknown source"))


def _given(value: Column) -> Column:
    return F.coalesce(F.length(value) > 0, F.lit(False))


def exclusive(path: Column, url: Column) -> Column:
    """Whether exactly one of path and url is given; an empty one isn't."""
    return _given(path) != _given(url)


def source_kind(path: Column, url: Column) -> Column:
    """file, url (http and https only), refused_url or missing."""
    web = F.lower(url).rlike(r"^https?://[^/\s]+")
    return F.when(_given(path), F.lit("file")).when(_given(url) & web, F.lit("url")).when(_given(url), F.lit("refused_url")).otherwise(F.lit("missing"))


def validity(sources: DataFrame) -> DataFrame:
    ok = exclusive(F.col("path"), F.col("url"))
    return sources.select("src_idx", ok.alias("valid"), F.when(~ok, F.lit(EXCLUSIVE)).alias("message"))


def missing_files(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """src_idx, error of confined paths (src_idx, path, resolved) that aren't among files (path)."""
    lacking = resolved.where("resolved is not null").join(files.select(F.col("path").alias("resolved")), "resolved", "left_anti")
    return lacking.select("src_idx", F.concat(F.lit("File not found at '"), "path", F.lit("'.")).alias("error"))
