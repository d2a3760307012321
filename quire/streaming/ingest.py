"""Incremental decoding of files that arrive in a folder: an extension, stateless and restartable by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources import loader

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", files_per_trigger: int = 1000) -> DataFrame:
    """doc_id (a hash of the path), path, content, target of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content", F.lit(None).cast("array<bigint>").alias("target"))


def page_texts_of_batch(batch: DataFrame) -> DataFrame:
    """doc_id, page, text of the files of a batch."""
    return loader.page_texts(loader.decode(batch))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Page texts of all new files under out, one folder a batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        page_texts_of_batch(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream_files(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
