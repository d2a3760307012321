import zlib

import pytest

from quire.llm import queries

from ..oracle_check import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    got, want = compare(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])
    assert got == want and got


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_shards_by_bytes(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op7_resharding(spark, sf_dir).toPandas()
    assert list(got.columns) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples()} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in docs.items()}
    assert got.shard.between(0, 39).all() and got.grown_shard.isna().all() and set(got.law) == {"bytes"}
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_packing_covers_every_token(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.op5_best_fit_packing(spark, sf_dir).collect()
    held = {}
    for r in got:
        segments = [tuple(map(int, s.split(":"))) for s in r.segments.split(",")]
        assert [s[0] for s in segments] == r.doc_ids and r.n_tokens == r.mask_ones == sum(s[3] for s in segments) <= r.capacity
        assert [s[2] for s in segments] == [sum(x[3] for x in segments[:i]) for i in range(len(segments))]
        for doc_id, _, _, length in segments:
            held[doc_id] = held.get(doc_id, 0) + length
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert held == {r.doc_id: len(encoder.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs}
