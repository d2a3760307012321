"""The thin queries of the training-data operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import substring_dedup

    return substring_dedup.removals(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm import token_files

    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_documents(manifest)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import simhash

    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import quality

    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 9).alias("score"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm import packing

    found = packing.sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    ids = F.crc32(F.array_join("ids", ",").cast("binary"))
    told = F.transform("segments", lambda s: F.concat_ws(":", *[s[c].cast("string") for c in ("doc_id", "piece", "start", "length")]))
    ones = F.aggregate("mask", F.lit(0).cast("long"), lambda acc, m: acc + m)
    return found.select("bin_id", "capacity", "n_tokens", ones.alias("mask_ones"), F.transform("segments", lambda s: s["doc_id"]).alias("doc_ids"), F.array_join(told, ",").alias("segments"), ids.alias("ids_crc32"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm import byte_bpe

    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import sharding

    placed = sharding.reshard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", F.col("shard_size").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import pii

    return pii.find(_table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import ann

    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import html_text

    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import toxicity

    scored = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", F.round("score", 12).alias("score"), "predicted")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import vector_codes

    found = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    rows = vector_codes.with_label_error(found.rows)
    return rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(found.fingerprint()).alias("codebooks_sha256"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import delta_lloyd

    found = delta_lloyd.cluster(_table(spark, sf_dir, "embeddings"))
    return found.with_inertia().select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def queries() -> dict[str, Query]:
    return {name: value for name, value in globals().items() if name.startswith("op") and name[2].isdigit()}


_OP1 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
wins AS (SELECT doc_id, unnest(list_transform(range(0, len(ws) - 34), lambda i: i)) AS i, unnest(list_transform(range(0, len(ws) - 34), lambda i: md5(array_to_string(ws[i + 1:i + 35], ' ')))) AS h FROM w WHERE len(ws) >= 35),
twice AS (SELECT h FROM wins GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM wins WHERE h IN (SELECT h FROM twice)),
lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
sha256(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ks, i - 1)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)
"""

_OP10 = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1), '</?(?:p|h1)(?:\s[^>]*)?>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda p: regexp_replace(regexp_replace(p, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')) AS raw FROM a),
c AS (SELECT page_id, url, list_transform(raw, lambda p: regexp_replace(replace(replace(regexp_replace(p, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')) AS plain FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(plain, lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query: not the forest, the trees, the tokenizers, XXH64 or what approximates."""
    return {"op1_substring_dedup": _OP1, "op10_html_text": _OP10}
