"""Folders of many files: listed by the executors, dealt to as many tasks as their bytes need."""

import re

import pytest
from pyspark.sql import functions as F

from quire.plans import catalogue
from quire.sources import loader, page_source, pdf, pdf_writer, ranged

from .pdf_writer import build, text_page


def folder_of(tmp_path, names):
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(build([text_page((1, 1, f"{name} page {n}")) for n in (1, 2, 3)]))
    return sorted(f"{tmp_path}/{name}" for name in names)


def test_files_at_any_depth_are_listed(spark, tmp_path):
    paths = folder_of(tmp_path, ["1.pdf", "a/2.pdf", "a/b/c/3.pdf", "d/4.pdf"])
    (tmp_path / "a/note.txt").write_text("x")
    (tmp_path / "empty").mkdir()
    for folder in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        found = {r.path: r.length for r in loader.under(spark, folder).collect()}
        assert sorted(re.sub("^file:(//)?", "", p) for p in found) == paths
        assert sorted(found.values()) == sorted(len(ranged.opened(p).read(0, 1 << 20)) for p in paths)


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_decoding_by_path_is_that_of_contents(spark, tmp_path, part_bytes):
    folder_of(tmp_path, [f"{n % 3}/{n}.pdf" for n in range(1, 9)])
    (tmp_path / "0/9.pdf").write_bytes(b"nothing")
    files = loader.under(spark, str(tmp_path)).selectExpr("cast(regexp_extract(path, '([0-9]+).pdf$', 1) as long) as doc_id", "path", "length", "if(path like '%4.pdf', array(2L, 99L), null) as target")
    held = loader.scan(spark, f"{tmp_path}/*").selectExpr("cast(regexp_extract(path, '([0-9]+).pdf$', 1) as long) as doc_id", "content", "if(path like '%4.pdf', array(2L, 99L), null) as target")
    rows = [sorted(map(str, loader.decode(f, part_bytes=b).drop("paints").collect())) for f, b in ((files, part_bytes), (held, 1 << 20))]
    assert rows[0] == rows[1] and len(rows[0]) == 9 + 7 * 3 + 1


def test_the_driver_lists_no_documents(spark, sf_dir):
    for query in (catalogue.pdf_page_texts, catalogue.pdf_page_count, catalogue.shared_page_texts, catalogue.shared_decodings):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "content" not in plan and "binary" not in plan.lower().replace("data:binary", ""), plan[:500]
        assert not [f for f in query(spark, sf_dir).inputFiles() if f.endswith(".pdf")]


def test_shares_of_many_files_meet_in_few_tasks(spark, tmp_path):
    folder_of(tmp_path, [f"{n % 7}/{n}.pdf" for n in range(200)])
    whole, parted = (page_source.pages(spark, str(tmp_path), part_bytes=b) for b in (1 << 20, 300))
    assert parted.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    rows = [sorted(map(str, f.select("path", "page", "head.num_pages", "runs").collect())) for f in (whole, parted)]
    assert rows[0] == rows[1] and len(rows[0]) == 800
    reader = page_source.PageReader({"path": str(tmp_path), "part_bytes": "300", "slots": "2"}, None)
    parts = reader.partitions()
    assert len(parts) <= 8 and sum(b.num_rows for part in parts for b in reader.read(part)) == 800


def test_placed_strings_at_once_are_as_token_by_token(monkeypatch):
    shown = b"BT /F1 2 Tf 1 0 0 1 5 6 Tm <0001000> Tj 1 0 0 -1.5 +.5 7. Tm\n<00020003>Tj 9 8 1 0 0 1 1 2 Tm <0001> Tj 1 0 0 1 3 4 Tm <0002> Tjx 1 0 0 1 3 4 Tm <0003> 1 Tj 1 0 0 1 7 7 Tm (x) Tj 2 0 0 2 0 0 cm 1 0 0 1 3 4 Tm <0002> Tj <0001> Tj ET"
    raw = pdf_writer.write([[("abc", 1, 2)]])
    found = []
    for pattern in (pdf._PLACED, re.compile(rb"(?!)")):
        monkeypatch.setattr(pdf, "_PLACED", pattern)
        doc = pdf.Document(raw)
        run = pdf._Interpreter(doc, False, 1e9, 1e9)
        run.run(shown, {"Font": {"F1": pdf.Ref(3, 0)}})
        found.append((run.out.runs, run.tm, run.line))
    assert found[0] == found[1] and len(found[0][0]) >= 5
