"""Results of requested sources: status, error isolation, assembly and JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.operators import page_ranges, paths, requests


def metadata_pairs(documents: DataFrame) -> DataFrame:
    """doc_id, key, value of a metadata map; documents without one have no rows."""
    return documents.where("metadata is not null").select("doc_id", F.explode("metadata").alias("key", "value"))


def typed_pairs(documents: DataFrame) -> DataFrame:
    """doc_id, key, kind, value of an information dictionary (info variant): its type as Spark names it, and its JSON. Documents without one have no rows."""
    told = documents.where("info is not null").lateralJoin(documents.sparkSession.tvf.variant_explode(F.col("info").outer()))
    return told.select("doc_id", "key", F.schema_of_variant("value").alias("kind"), F.to_json("value").alias("value"))


def source_status(sources: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """src_idx, source, success, error by the order of the stages: specification, path, file.

    The first failing stage decides, and later ones aren't entered; every source keeps its row."""
    label = requests.source_label(F.col("path"), F.col("url"))
    spec = page_ranges.selected(sources.withColumn("source", label), "pages_spec")
    located = spec.withColumn("p", paths.path_status(F.col("path"), root))
    known = files.select(F.col("path").alias("_file"), F.lit(True).alias("_there"))
    joined = located.join(known, F.col("p.resolved") == F.col("_file"), "left")
    given = F.coalesce(F.length("path") > 0, F.lit(False))
    prefix = lambda kind: F.lit(f"MCP error {paths.RequestError.CODES[kind]}: ")
    missing = F.concat(prefix("InvalidParams"), F.lit("Source "), "source", F.lit(" missing 'path' or 'url'."))
    error = (
        F.when(F.col("spec_error").isNotNull(), F.concat(prefix("InvalidParams"), page_ranges.specification_error(F.col("source"), F.col("spec_error"))))
        .when(~given & F.coalesce(F.length("url") == 0, F.lit(True)), missing)
        .when(given & (F.col("p.status") == "absolute"), F.concat(prefix("InvalidParams"), F.lit(paths.ABSOLUTE)))
        .when(given & (F.col("p.status") == "traversal"), F.concat(prefix("InvalidRequest"), F.lit(paths.OUTSIDE)))
        .when(given & F.col("_there").isNull(), F.concat(prefix("InvalidRequest"), F.lit("File not found at '"), "path", F.lit("'.")))
    )
    return joined.select("src_idx", "source", error.isNull().alias("success"), error.alias("error"))


def status_json(status: DataFrame) -> DataFrame:
    """src_idx, json of source, success and error; absent fields are left out."""
    return status.select("src_idx", F.to_json(F.struct("source", "success", "error")).alias("json"))


def answers(status: DataFrame, batch: Column) -> DataFrame:
    """batch, answer: the JSON part of the answer to each batch of sources, in their order. A batch is a request, so it is small."""
    rows = status.groupBy(batch.alias("batch")).agg(F.array_sort(F.collect_list(F.struct("src_idx", "source", "success", "error"))).alias("rows"))
    return rows.select("batch", pretty_udf(F.to_json("rows")).alias("answer"))


def result_struct(flags: dict[str, bool]) -> Column:
    """struct<source, success, data, error> from flat columns, with the fields that the flags ask for."""
    fields = []
    if flags["include_page_count"]:
        fields.append("num_pages")
    if flags["include_metadata"]:
        fields += ["info", "metadata"]
    fields += ["warnings", "page_texts", "full_text"]
    if flags["include_images"]:
        fields.append("image_info")
    return F.struct("source", "success", F.when(F.col("success"), F.struct(*fields)).alias("data"), F.when(~F.col("success"), F.col("error")).alias("error"))


def without_absent(value: object) -> object:
    """A nested value without the entries that are null."""
    if isinstance(value, dict):
        return {k: without_absent(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple)):
        return [without_absent(v) for v in value]
    return value


def pretty(results: list[dict]) -> str:
    """The JSON part of an answer: two spaces of indent, absent fields left out, order kept."""
    return json.dumps({"results": without_absent(results)}, indent=2, ensure_ascii=False)


@F.pandas_udf(StringType())
def pretty_udf(rows: pd.Series) -> pd.Series:
    """pretty() of each array of rows, given as compact JSON."""
    return pd.Series([pretty([{k: v for k, v in row.items() if k != "src_idx"} for row in json.loads(x)]) for x in rows], dtype=object)
