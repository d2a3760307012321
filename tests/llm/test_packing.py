import random

from quire.llm import packing


def plain(packer, lengths):
    """The same rule over plain lists; of bins with one room the one opened or used last is taken."""
    bins, placed, touched = [], [], []
    for n, x in enumerate(lengths):
        fitting = [room for room, _ in bins if room >= x]
        if fitting:
            which = max((k for k, (room, _) in enumerate(bins) if room == min(fitting)), key=lambda k: touched[k])
            touched[which] = n
        else:
            later = lengths[n + 1 :]
            which = len(bins)
            bins.append((packer.opening(x, lambda c, later=later: sum(y for y in later if y <= c)), 0))
            touched.append(n)
        room, used = bins[which]
        placed.append((which, used))
        bins[which] = (room - x, used + x)
    return [(b, at, packer.fit(bins[b][1])) for b, at in placed]


def test_invariants_and_least_room_rule():
    rng = random.Random(2)
    for caps in ((8,), (4, 16), (3, 7, 20)):
        packer = packing.Packer(caps, overhead=1)
        for _ in range(30):
            lengths = sorted((rng.randint(1, caps[-1]) for _ in range(rng.randint(1, 60))), reverse=True)
            got = packer.pack(lengths)
            held = {}
            for x, (b, at, size) in zip(lengths, got):
                held.setdefault(b, []).append((at, at + x, size))
            for parts in held.values():
                parts.sort()
                assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
                assert packer.fit(parts[-1][1]) == parts[0][2] and len({p[2] for p in parts}) == 1
            rooms = sum(size for parts in held.values() for size in {parts[0][2]})
            assert rooms >= sum(lengths)
            assert got == plain(packer, lengths)


def test_several_lengths_waste_less_than_one():
    rng = random.Random(4)
    lengths = sorted((min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(3000)), reverse=True)
    one = {b: c for b, _, c in packing.Packer((4096,)).pack(lengths)}
    many = {b: c for b, _, c in packing.Packer().pack(lengths)}
    cost = lambda bins: sum(map(packing.Packer().cost, bins.values()))
    assert cost(many) < cost(one) and len(set(many.values())) > 1
    assert sum(lengths) / sum(many.values()) > 0.95


def test_documents_are_whole(spark, hard_docs, hard_rows, no_docs):
    got = packing.pack(hard_docs, capacities=(16, 64), block_rows=20).toPandas()
    for doc_id, text, *_ in hard_rows:
        pieces = got[got.doc_id == doc_id].sort_values("piece")
        n = len((text or "").encode().split())
        assert pieces.piece_words.sum() == n and (pieces.n_words == n).all() and pieces.piece.tolist() == list(range(len(pieces)))
        assert pieces.bin_id.isna().all() == (n == 0)
    filled = got.dropna(subset=["bin_id"]).groupby("bin_id").agg(n=("piece_words", "sum"), c=("capacity", "first"))
    assert (filled.n <= filled.c).all() and set(filled.c) <= {16, 64}
    assert packing.pack(no_docs).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.piece_words for r in packing.pack(odd).collect()) == [0, 2, 2]


def test_sequences_hold_every_token_once(spark, hard_docs, hard_rows, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain_encoder = Tokenizer.from_file(path)
    got = packing.sequences(hard_docs, path, 2, pad_id=7, capacities=(16, 64), block_rows=20).collect()
    pieces = {}
    for r in got:
        assert len(r.ids) == len(r.mask) == r.capacity and sum(r.mask) == r.n_tokens == sum(s.length for s in r.segments)
        assert r.mask == [1] * r.n_tokens + [0] * (r.capacity - r.n_tokens) and set(r.ids[r.n_tokens :]) <= {7}
        for s in r.segments:
            pieces.setdefault(s.doc_id, {})[s.piece] = r.ids[s.start : s.start + s.length]
    for doc_id, text, *_ in hard_rows:
        assert sum((pieces[doc_id][k] for k in sorted(pieces[doc_id])), []) == [*plain_encoder.encode(text or "", add_special_tokens=False).ids, 2]
    assert packing.sequences(no_docs, path, 2).count() == 0
