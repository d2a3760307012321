"""Texts of pages joined where they are decoded, and the bulk reading of what files hold many of."""

import random
import re

import pytest

from quire.plans import catalogue
from quire.sources import fixtures, loader, pdf, pdf_writer

from .pdf_writer import build, text_page

NEVER = re.compile(rb"(?!)")


def test_page_texts_shuffle_nothing_but_names(spark, sf_dir):
    plan = catalogue.pdf_page_texts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("RepartitionByExpression")]
    assert "MapInArrow" in top and not any(word in top for word in ("Aggregate", "Generate", "Sort", "Window", "Join")), plan


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_texts_are_those_of_the_runs(spark, tmp_path, monkeypatch, part_bytes):
    rng = random.Random(3)
    words = ["a ", " ", "\t\xa0", "　", "﻿", "é", "😀 ", "x" * 30, "\x00", "​"]
    for n in range(1, 30):
        pages = [[(rng.choice(words), rng.random(), rng.choice([0.5, 0.49, -0.5, -1.5, 700, 699.5, 1e17, -3.2])) for _ in range(rng.choice([0, 1, 40]))] for _ in range(rng.randint(1, 4))]
        (tmp_path / f"{n}.pdf").write_bytes(pdf_writer.write(pages))
    (tmp_path / "30.pdf").write_bytes(b"nothing")
    (tmp_path / "31.pdf").write_bytes(pdf_writer.write([[("a", 1, 2)]] * 3).replace(b"/FlateDecode", b"/JPXDecode  "))
    (tmp_path / "32.pdf").write_bytes(build([text_page((1, 1, f"n{n}")) for n in range(200)]))
    files = loader.under(spark, str(tmp_path)).selectExpr("cast(regexp_extract(path, '([0-9]+).pdf$', 1) as long) as doc_id", "path", "length", "if(path like '%2.pdf', array(2L, 99L), null) as target")
    found = [sorted(map(tuple, f.select("doc_id", "page", "text").collect())) for f in (loader.texts(files, part_bytes), loader.page_texts(loader.decode(files, part_bytes=part_bytes)))]
    assert found[0] == found[1] and [t for d, _, t in found[0] if d == 31] == ["", "", ""]
    assert [p for d, p, _ in found[0] if d == 32] == [2, 99]
    assert [len({t for _, _, t in found[0]}) > 20, 30 in {d for d, _, _ in found[0]}] == [True, False]


def test_a_batch_holds_pages_of_many_files(spark, tmp_path):
    for n in range(60):
        (tmp_path / f"{n}.pdf").write_bytes(build([text_page((1, 1, f"n{n}"))]))
    files = loader.under(spark, str(tmp_path)).selectExpr("cast(regexp_extract(path, '([0-9]+).pdf$', 1) as long) as doc_id", "path", "length", "cast(null as array<long>) as target")
    held = loader.scan(spark, str(tmp_path)).selectExpr("1L as doc_id", "content", "cast(null as array<long>) as target").coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    for decoded, most in ((loader.decode(files), loader.tasks_of(spark) + 60 * 2 // 64 + 1), (loader.decode(held), 3)):
        rows = [r.n for r in decoded.select("page").mapInArrow(sizes, "n long").collect()]
        assert sum(rows) == 120 and len(rows) <= most


@pytest.mark.parametrize(("given", "nearest"), [(0.5, 1), (-0.5, 0), (-1.5, -1), (2.49, 2), (-2.51, -3), (4503599627370497.5, 4503599627370498), (1e300, 10**300), (float("nan"), 1)])
def test_heights_are_rounded_half_up(given, nearest):
    assert loader._nearest(given) == pytest.approx(nearest, rel=1e-15)


PLACE = "1 0 0 1 5 6 Tm <0001> Tj "


@pytest.mark.parametrize("before", ["/F1 2 Tf", "/F1 2 Tf 2 0 .5 2 3 4 cm 5 Ts 50 Tz", ""])
@pytest.mark.parametrize(
    "shown",
    [
        PLACE * 5,
        PLACE * 3 + "1 0 0 1 5 6 Tm <> Tj " + PLACE * 3,
        PLACE * 3 + "2 0 0 -1.5 +.5 7. Tm\n<00020003>Tj 9 .5 1 0 0 1 Tm\0<0002> Tj <0001> Tj " + PLACE * 2,
        PLACE * 3 + "1 0 0 1 5 Tm <0001> Tj 1 1 0 0 1 5 6 Tm <0002> Tj " + PLACE * 3,
        PLACE * 3 + "1 0 0 1 5 1-2 Tm <0002> Tj 1 0 0 1 5 . Tm <0002> Tj 1 0 0 1 5 +-6 Tm <0002> Tj" + PLACE * 3,
        PLACE * 3 + "1 0 0 1 5 6Tm <0002> Tj " + PLACE * 3,
        PLACE * 3 + "1 0 0 1 5 8 Tm <000> Tj 1 0 0 1 5 8 Tm <00020> Tj " + PLACE * 3,
        PLACE * 3 + "1 0 0 1 5 8 Tm <0009> Tj 1 0 0 1 5 8 Tm <FFFF0001> Tj " + PLACE * 3,
        PLACE * 3 + "1 0 0 1 5 8 Tm <0002> Tjx " + PLACE * 3 + "1 0 0 1 5 8 Tm <0002>Tj",
    ],
)
def test_strings_that_follow_one_another_are_as_one_by_one(monkeypatch, before, shown):
    raw = pdf_writer.write([[("abc", 1, 2)]])
    found = []
    for many, placed in ((pdf._MANY, pdf._PLACED), (NEVER, pdf._PLACED), (NEVER, NEVER)):
        monkeypatch.setattr(pdf, "_MANY", many)
        monkeypatch.setattr(pdf, "_PLACED", placed)
        run = pdf._Interpreter(pdf.Document(raw), False, 1e9, 1e9)
        run.run(f"BT {before} {shown} (end) Tj ET".encode(), {"Font": {"F1": pdf.Ref(3, 0)}})
        out = run.out
        assert len(out.texts) == len(out.heights) == len(out.runs) and out.heights == [m[5] for _, m in out.runs]
        found.append((out.runs, run.tm, run.line))
    assert found[0] == found[1] == found[2] and (len(found[0][0]) >= 5) == bool(before)


@pytest.mark.parametrize("to", ["<0066006C>", "<D83DDE00>", "<>", "<00>", "<00 66>"])
def test_lists_of_codes_are_as_token_by_token(monkeypatch, to):
    body = f"begincmap 3 beginbfchar <0001> <0061> <0002> {to} <3> <0063> endbfchar 1 beginbfrange <0004> <0005> <0064> endbfrange 1 beginbfchar <0006> <0066>endbfchar".encode()
    found = []
    for pairs in (pdf._PAIRS, NEVER):
        monkeypatch.setattr(pdf, "_PAIRS", pairs)
        font = pdf.Font.__new__(pdf.Font)
        font.map, font.widths, font.default, font.spaces, font.shown, font.codec, font.wide = {}, {}, 1.0, [], {}, None, True
        font._read_map(body)
        digits = [b"0001", b"00020001", b"0005", b"0006", b"0009", b"000100"]
        assert font.texts(digits) == [font.show(bytes.fromhex(d.decode()))[0] for d in digits]
        assert font.texts([b"0001", b"00010006"]) == ["a", "af"] and font.texts([]) == []
        found.append(font.map)
    assert found[0] == found[1] and len(found[0]) == 6


@pytest.mark.parametrize("table", ["0 3\n0000000000 65535 f \n0000000010 00000 n \n0000000020 00000 n \n", "0 2\n0000000000 65535 f \n0000000010 00000 n \n7 1\n0000000020 00000 n \n", "0 3 0000000000 65535 f\r\n0000000010 00000 n\n  0000000020 00000 n \n", "0 1 0000000000 65535 f \n5 0\n"])
def test_tables_are_as_token_by_token(monkeypatch, table):
    found = []
    for entries in (pdf._ENTRIES, NEVER):
        monkeypatch.setattr(pdf, "_ENTRIES", entries)
        lexer = pdf.Lexer(f"xref\n{table}trailer << /Size 3 /Root 1 0 R >> startxref".encode())
        found.append((pdf._table(lexer), lexer.at))
    assert found[0] == found[1] and found[0][0][1]["Size"] == 3


def test_written_files_hold_the_runs_of_the_documents():
    for doc_id, text in ((7, "a  b c d e\n\n x\ny\nz\nlast é😀"), (33, "one two three four five"), (26, "p q\nr s\nt u v"), (1, "")):
        pages = fixtures._placed(doc_id, text)
        lines = text.split("\n")
        want = [[] for _ in range((len(lines) - 1) // 5 + 1 + (doc_id % 3 == 0))]
        for pos, line in enumerate(lines):
            for at, word in enumerate(line.split(" ")):
                if doc_id % 11 or at != 3:
                    y = 700.0 - 20 * (pos % 5) + (at % 4) * 0.25 - 0.5 - (0 if doc_id % 7 else 1000)
                    want[pos // 5].append(("\t\xa0" if doc_id % 13 == 0 and pos % 5 == 2 else word + " ", y))
        doc = pdf.Document(pdf_writer.write(pages))
        assert [list(zip((found := pdf.page_layout(doc, n)).texts, found.heights)) for n in range(1, len(doc.pages) + 1)] == want


@pytest.mark.parametrize("entry", ["/A 1/B/C/D 12 0 R", "/A 1.5", "/A 1 2", "/A 1 0 Rx", "/B#20 /C /D#41", "/A true /B null", "/A 1 /A 2", "/A [1 2 0 R] /B 3", "/A <</B 1 /C 2 0 R>> /D (x)", "/A %note\n 1", "/A -1 /B +2", "/A"])
def test_dictionaries_are_as_token_by_token(monkeypatch, entry):
    found = []
    for plain in (pdf._PLAIN_DICT, NEVER):
        monkeypatch.setattr(pdf, "_PLAIN_DICT", plain)
        lexer = pdf.Lexer(f"<< {entry} >> after".encode())
        found.append((lexer.next(), lexer.at, lexer.next()))
    assert found[0] == found[1] and found[0][2] == b"after"


@pytest.mark.parametrize("direct", [True, False])
def test_files_are_written_by_the_scan_where_it_has_tasks_enough(spark, tmp_path, direct):
    rows = [(n, f"text {n}\nof a document" if n % 50 else None) for n in range(1, 201)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(20).write.parquet(f"{tmp_path}/documents.parquet")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    held = [spark.conf.get(name) for name in names]
    try:
        if direct:
            for name, value in zip(names, (max(f.stat().st_size for f in tmp_path.glob("documents.parquet/*.parquet")), 0)):
                spark.conf.set(name, str(value))
        folder = fixtures.pdf_folder(spark, str(tmp_path))
        files = [r.path for r in loader.under(spark, folder).collect()]
        assert len({p.rpartition("/")[0] for p in files if re.search(r"/[0-9]+-0/", p)}) == (20 if direct else 0)
        assert sorted(int(re.search(r"([0-9]+)\.pdf$", p)[1]) for p in files) == [n for n in range(1, 201) if n % 50]
        got = {(r.doc_id, r.page): r.text for r in catalogue.pdf_page_texts(spark, str(tmp_path)).collect()}
        assert got[8, 1] == "text 8 of a document " and len({d for d, _ in got}) == 196
    finally:
        for name, value in zip(names, held):
            spark.conf.set(name, value)
