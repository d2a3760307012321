"""Operators against plain-Python models on random input."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quire.functions import js
from quire.operators import images, layout, page_ranges
from quire.sources.fixtures import SPECS


def model_of_spec(spec):
    pages = set()
    for part in spec.split(","):
        part = part.strip()
        if "-" in part:
            first, last = part.split("-")[:2]
            a = re.match(r"\s*([+-]?\d+)", first)
            b = re.match(r"\s*([+-]?\d+)", last)
            low = int(a[1]) if a else None
            high = math.inf if last == "" else int(b[1]) if b else None
            if low is None or high is None or low < 1 or low > high:
                return f"Invalid page range values: {part}"
            pages.update(range(low, min(high, low + 10000) + 1))
        else:
            m = re.match(r"\s*([+-]?\d+)", part)
            if not m or int(m[1]) < 1:
                return f"Invalid page number: {part}"
            pages.add(int(m[1]))
    return sorted(pages)


def test_grammar_on_random_specifications(spark):
    rng = random.Random(3)
    specs = SPECS + ["".join(rng.choice("0123459-, ,-") for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["99999999999999999999", "1-99999999999999999999"]
    frame = page_ranges.selected(spark.createDataFrame(list(enumerate(specs)), "id int, spec string"))
    for r in frame.select("spec", "spec_error", "target").collect():
        want = model_of_spec(r.spec)
        if r.spec == "99999999999999999999":
            assert r.target == [js.GREATEST]
        elif isinstance(want, str):
            assert (r.spec_error, r.target) == (want, None), r.spec
        else:
            assert (r.spec_error, r.target) == (None, want), r.spec


def test_selection_cases(spark):
    cases = [(1, "1,2,5,10,15", 10), (2, None, 5), (3, "11-13", 10), (4, "2,4", 10), (5, "5-3", 4), (6, "2-", 3)]
    frame = page_ranges.selected(spark.createDataFrame(cases, "doc_id long, spec string, num_pages long"))
    whole = {r.doc_id: (r.valid, len(r.invalid)) for r in page_ranges.resolve(frame, True).collect()}
    assert whole == {1: ([1, 2, 5, 10], 1), 2: ([1, 2, 3, 4, 5], 0), 3: ([], 3), 4: ([2, 4], 0), 5: ([], 0), 6: ([2, 3], 9999)}
    assert page_ranges.resolve(frame, False).where("doc_id = 2").first().valid == []


def test_rounding_blanks_and_prefixes(spark):
    values = [-2.5, 2.5, -0.5, 0.49999999999999994, 0.5, -1.2, 7.0, None]
    got = [r.y for r in spark.createDataFrame([(v,) for v in values], "v double").select(js.round_half_up(F.col("v")).alias("y")).collect()]
    assert got == [-2, 3, 0, 0, 1, -1, 7, None]
    blanks = [("\t 　﻿", True), ("", True), (" \n", True), ("x\n", False), ("​", False), ("\n", True)]
    frame = spark.createDataFrame(blanks, "s string, want boolean").select("want", js.is_blank(F.col("s")).alias("got"))
    assert all(r.want == r.got for r in frame.collect())


def test_lines_against_a_model(spark):
    rng = random.Random(11)
    runs = [(1, rng.randint(1, 3), i, rng.choice(["a", "b ", "", " ", "\t"]), rng.choice([None, *[x / 2 for x in range(-6, 7)]])) for i in range(400)]
    frame = spark.createDataFrame(runs, "doc_id long, page int, seq long, str string, y double").repartition(5)
    want = {}
    for _, page, _, s, y in runs:
        if y is not None:
            key = (page, math.floor(y + 0.5))
            want[key] = want.get(key, "") + s
    want = {k: v for k, v in want.items() if v.strip()}
    assert {(r.page, r.y): r.line for r in layout.lines(frame).collect()} == want
    texts = layout.page_texts(spark.createDataFrame([(1, p) for p in range(1, 5)], "doc_id long, page int"), layout.lines(frame))
    model = {p: "".join(want[k] for k in sorted(want, key=lambda k: -k[1]) if k[0] == p) for p in range(1, 5)}
    assert {r.page: r.text for r in texts.collect()} == model
    assert layout.full_texts(texts).first().full_text == "\n\n".join(model[p] for p in range(1, 5))


def test_short_buffers_and_kinds():
    assert images.to_rgba(b"\x01\x02\x03", 2, 1, 2).tolist() == [[[1, 2, 3, 255], [0, 0, 0, 255]]]
    assert images.to_rgba(b"\x09", 1, 2, 1).tolist() == [[[9, 9, 9, 255]], [[0, 0, 0, 255]]]
    assert images.to_rgba(b"\x01\x02", 1, 1, 3).tolist() == [[[1, 2, 0, 0]]]
    assert images.to_rgba(b"abc" * 9, 1, 1, None).shape == (1, 1, 4)
    assert images.png_bytes(np.zeros((1, 1, 4), dtype=np.uint8))[:8] == b"\x89PNG\r\n\x1a\n"


def test_presence_decides_over_validity(spark):
    painted = spark.createDataFrame([(1, 1, 0, 89, "g_a", None), (1, 1, 1, 89, "g_b", None), (1, 1, 2, 89, "i", None)], "doc_id long, page int, op_pos int, fn int, obj_name string, y double")
    objects = spark.createDataFrame(
        [("common", 1, 1, "g_a", None, 8, 1, b"x"), ("page", 1, 1, "g_a", 8, 8, 1, b"x"), ("page", 1, 1, "g_b", 8, 8, 1, b"x"), ("common", 1, 1, "i", 8, 8, 1, b"x")],
        "scope string, doc_id long, page int, name string, width int, height int, kind int, data binary",
    )
    resolved = images.resolve_objects(images.paint_ordinals(painted), objects)
    assert {r.obj_name: r.origin for r in resolved.collect()} == {"g_a": "common", "g_b": "page", "i": None}
    assert [r.obj_name for r in images.valid_images(resolved).collect()] == ["g_b"]
