import hashlib
import random

import public_tokenizers
import tiktoken

from quire.llm import byte_bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    with open(FILE, "rb") as f:
        ranks = byte_bpe.parse_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_equals_the_library(spark, hard_docs, hard_rows):
    got = {r.doc_id: r for r in byte_bpe.round_trip(hard_docs, FILE, public_tokenizers.PATTERN).collect()}
    other = library()
    for doc_id, text, *_ in hard_rows:
        ids = other.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), doc_id
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_then_decode(spark, hard_docs, hard_rows):
    encoded = byte_bpe.encode(hard_docs, FILE, public_tokenizers.PATTERN)
    other = library()
    ids = {r.doc_id: list(r.ids) for r in encoded.collect()}
    back = {r.doc_id: bytes(r.content) for r in byte_bpe.decode(encoded, FILE, public_tokenizers.PATTERN).collect()}
    for doc_id, text, *_ in hard_rows:
        assert ids[doc_id] == other.encode_ordinary(text or "") and back[doc_id] == (text or "").encode()


def test_matrices_and_heap_agree_on_random_pieces():
    with open(FILE, "rb") as f:
        codec = byte_bpe.codec(f.read(), public_tokenizers.PATTERN)
    rng, other = random.Random(3), library()
    pieces = [bytes(rng.choice(b"aeinrst \xc3\xa9") for _ in range(rng.randint(1, 200))) for _ in range(300)] + [b"a" * 700, b"ab" * 900]
    for piece, ids in zip(pieces, codec.encode_pieces(pieces)):
        assert ids.tolist() == codec._long(piece).tolist() == other._encode_single_piece(piece)


def test_empty_table(no_docs):
    assert byte_bpe.round_trip(no_docs, FILE, public_tokenizers.PATTERN).collect() == []
