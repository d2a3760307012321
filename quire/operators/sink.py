"""An ordered sink: parts of answers as JSON lines in range-partitioned files whose offsets are known.

Rows are dealt by ranges of their order, so that the files follow one another, and sorted within; each file is written by one
task, and no row passes through the driver. A line knows its file and its place there, and the manifest tells for each
file its lines and the lines of all files before it, so a reader can fetch any stretch of an answer alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PLACE = 33  # bits of a row's place below those of its partition in monotonically_increasing_id


def write_ordered(parts: DataFrame, folder: str, order: list[str]) -> DataFrame:
    """Write parts (no columns file_no and line_no) to folder in order; the manifest: file_no, lines, before."""
    spark = parts.sparkSession
    placed = parts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    told = placed.select(F.shiftrightunsigned("_at", _PLACE).cast("int").alias("file_no"), F.col("_at").bitwiseAND(F.lit((1 << _PLACE) - 1)).alias("line_no"), *parts.columns)
    told.write.json(f"{folder}/parts")
    counts = spark.read.schema("file_no int").json(f"{folder}/parts").groupBy("file_no").agg(F.count("*").alias("lines"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # over a row a file
    counts.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_ordered(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The parts (schema as it was written) with position: the line's number over all files, from 1."""
    lines = spark.read.schema(f"file_no int, line_no long, {schema}").json(f"{folder}/parts")
    known = lines.join(spark.read.parquet(f"{folder}/manifest"), "file_no")
    return known.withColumn("position", F.col("before") + F.col("line_no") + 1).drop("file_no", "line_no", "lines", "before")
