import re

import pytest

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import packing, pii, simhash

from . import test_near_copies, test_substring_dedup


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's output at the smallest size, with its input."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        found[name] = (before.toPandas(), docs.toPandas())
    return found


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "pii", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert list(after.columns) == list(before.columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_rules_reject_and_keep(stages):
    before, after = stages["quality_rules"]
    gone = before[~before.doc_id.isin(after.doc_id)]
    assert 0 < len(gone) < len(before) / 3
    assert (before[before.doc_id.isin(after.doc_id)].text.str.split().str.len() >= 50).all()


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    assert sorted(after.doc_id) == test_near_copies.kept(list(zip(before.doc_id.tolist(), before.text.tolist())))


def test_repeated_passages_go(stages):
    before, after = stages["substring_dedup"]
    want = {d: n - gone for d, (n, gone, _) in zip(before.doc_id, test_substring_dedup.brute(before.text.tolist(), 35))}
    assert {d: len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) for d, t in zip(after.doc_id, after.text)} == want
    assert (after.n_chars == after.text.str.len()).all()


def test_no_personal_data_is_left(stages):
    before, after = stages["pii"]
    assert sum(len(pii.base_spans(t)) for t in before.text) > 0
    assert sum(len(pii.base_spans(t)) for t in after.text) == 0
    same = before.merge(after, on="doc_id")
    untouched = [not pii.detector().spans(t)[1] for t in same.text_x]
    assert (same.text_x == same.text_y)[untouched].all()


def test_every_token_is_in_one_sequence(stages):
    before, after = stages["packing"]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    found = {}
    for r in after.itertuples():
        assert len(r.ids) == len(r.mask) == r.capacity in packing.CAPACITIES and sum(map(int, r.mask)) == r.n_tokens == sum(s["length"] for s in r.segments)
        assert not any(r.ids[r.n_tokens :]) and all(a["start"] + a["length"] == b["start"] for a, b in zip(r.segments, r.segments[1:]))
        for s in r.segments:
            found.setdefault(s["doc_id"], {})[s["piece"]] = list(r.ids[s["start"] : s["start"] + s["length"]])
    for doc_id, text in zip(before.doc_id, before.text):
        ids = [x for _, part in sorted(found.pop(doc_id).items()) for x in part]
        assert ids == library.encode(text, add_special_tokens=False).ids + [corpus_pipeline.END_ID]
    assert not found


def test_run_gives_the_last_stage(spark, stages):
    assert len(corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()) == len(stages["packing"][1])


def test_near_copies_are_caught(spark):
    text = " ".join(f"word{i % 97}x{i}" for i in range(400))
    rows = [(1, text), (2, text), (3, "Entirely different words " * 3 + "that stand alone")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def odd_documents(spark):
    """Rows with nulls in any column, ties, copies, an empty and a long text, and columns whose names the operators use."""
    prose = " ".join(f"word{i}" for i in range(70))
    rows = [
        (1, prose, "en", None, 9, "k1", 1, 0.5, True),
        (1, prose, "en", None, 9, "k1", 1, 0.5, True),
        (2, prose + " write to anna.example@mail.org now", None, "s", None, None, None, None, None),
        (None, " ".join(f"other{i}" for i in range(80)), None, None, None, None, 2, 0.1, False),
        (3, None, None, None, None, None, None, None, None),
        (4, "", "de", "s", 0, "", 0, 0.0, False),
        (5, " ".join(f"long{i}" for i in range(30_000)), "fr", "s", 1, "k5", 5, 0.2, True),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _k string, block int, score double, kept boolean")


STAGE = dict(corpus_pipeline.STAGES)
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["quality_rules", "near_dedup", "substring_dedup", "pii"])
def test_stages_take_odd_rows_and_keep_columns(spark, name):
    docs = odd_documents(spark)
    after = STAGE[name](spark, docs, SF)
    assert after.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in after.select("doc_id", F.coalesce("text", F.lit("-null-")).alias("text")).collect())
    ids = [None if none else i for none, i, _ in got]
    if name == "quality_rules":  # too short and word-less texts go, equal rows fare alike
        assert {3, 4}.isdisjoint(ids) and ids.count(1) in (0, 2)
    elif name == "near_dedup":  # of equal rows one stays, and one of the texts without words
        assert ids == [1, 3, 5, None]
    else:
        assert ids == [1, 1, 2, 3, 4, 5, None] and (False, 3, "-null-") in got
        texts = {i: t for _, i, t in got}
        if name == "substring_dedup":
            assert texts[1] == "" and "word5" not in texts[2] and "anna.example" in texts[2] and len(texts[5].split()) == 30_000
        else:
            assert "anna.example" not in texts[2] and texts[2].startswith("word0 word1")
            assert {r.n_chars for r in after.where("doc_id = 2").collect()} == {len(texts[2])}
    assert STAGE[name](spark, docs.limit(0), SF).collect() == []


def test_packing_takes_odd_rows(spark):
    docs = odd_documents(spark)
    got = STAGE["packing"](spark, docs, SF).collect()
    held = [(s.doc_id, s.length) for r in got for s in r.segments]
    assert sorted(length for d, length in held if d in (3, 4)) == [1, 1]  # an end id each
    assert len([1 for d, _ in held if d == 1]) == 2 and any(d is None for d, _ in held)
    assert sum(length for d, length in held if d == 5) > 30_000 and STAGE["packing"](spark, docs.limit(0), SF).collect() == []
