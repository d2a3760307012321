"""The corpus pipeline: quality rules, near-dedup, substring dedup, redaction of personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the
shared folder and gives it, read again, to the next. All stages but the last return the columns of documents.
Column n_chars follows the text where a stage changes it; the last returns training sequences.

Every stage takes null, empty and very long texts, null ids, repeated rows, ties, empty tables and extra columns of any
name: what each does with them is said in its docstring and that of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import near_copies, packing, pii, quality, substring_dedup
from quire.session import discard, scratch_path, ship

#: SQL can't express the forest or the trees; the stages are tested against brute force.
ORACLE_SQL = None

VOCABULARY, END_ID = "word_bpe_49k.json", 2


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules (null and empty texts among them) or that the isolation forest rejects go; equal rows fare alike."""
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 of 5-word shingles) stays, that with the smallest doc_id (nulls last).

    Of rows equal in id and text one stays; texts without words are one group."""
    ship(spark)
    return near_copies.deduplicate(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand elsewhere too, in copies of the row as well, are cut out; null texts stay null."""
    ship(spark)
    return _counted(substring_dedup.deduplicate(docs))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; null texts stay null, equal rows fare alike."""
    ship(spark)
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the token ids of every document, packed, with masks and segments. Null texts are an end id; repeated rows are packed each."""
    import public_tokenizers

    ship(spark)
    return packing.sequences(docs, public_tokenizers.path(VOCABULARY), END_ID)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup_stage), ("pii", redact_pii), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)  # nothing reads it any more
        before = path
    return docs
