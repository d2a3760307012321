"""The stdio server, and the decoder's dealing of great files by page ranges."""

import io
import json
import os
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pdf_writer import build, text_page  # noqa: E402

from quire import server  # noqa: E402
from quire.sources import loader, pdf, pdf_writer  # noqa: E402


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("served")
    (top / "a.pdf").write_bytes(build([text_page((10, 700, "One")), text_page((10, 700, "Two"))]))
    return str(top)


def talk(spark, root, *requests):
    out = io.StringIO()
    server.serve(spark, [r if isinstance(r, str) else json.dumps(r) for r in requests], out, root)
    return [json.loads(line) for line in out.getvalue().splitlines()]


def call(method, number=None, **params):
    return {"jsonrpc": "2.0", "method": method, "params": params} | ({"id": number} if number is not None else {})


def test_requests_are_answered_in_turn(spark, root):
    told = talk(
        spark, root, call("initialize", 1, protocolVersion="2025-03-26"), call("notifications/initialized"), call("tools/list", 2), call("ping", 3), "", "no json", call("tools/call", 4, name="none", arguments={}),
        call("tools/call", 5, name="read_pdf", arguments={"sources": []}), call("rename", 6), {"id": 7}, call("tools/call", "x", name="read_pdf", arguments={"sources": [{"path": "a.pdf", "pages": "2"}], "include_metadata": False}),
    )
    assert [t["id"] for t in told] == [1, 2, 3, None, 4, 5, 6, None, "x"]
    assert told[0]["result"]["protocolVersion"] == "2025-03-26" and told[0]["result"]["capabilities"] == {"tools": {}}
    assert [t["name"] for t in told[1]["result"]["tools"]] == ["read_pdf"] and told[2]["result"] == {}
    assert [told[i]["error"]["code"] for i in (3, 4, 5, 6, 7)] == [-32700, -32601, -32602, -32601, -32600]
    assert "Unknown tool: none" in told[4]["error"]["message"]
    content = told[8]["result"]["content"]
    assert json.loads(content[0]["text"])["results"][0]["data"] == {"num_pages": 2, "page_texts": [{"page": 2, "text": "Two"}]}
    assert [c["text"] for c in content[1:]] == ["Two"]


def test_the_process_ends_with_its_input(root):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "quire.server", root], input=json.dumps(call("ping", 1)) + "\n", cwd=repo, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and json.loads(done.stdout.strip().splitlines()[-1]) == {"jsonrpc": "2.0", "id": 1, "result": {}}
    assert "serving" in done.stderr


def test_great_files_are_dealt_by_shares_of_their_pages(spark, tmp_path):
    pages = [[(f"page {n} é😀", 10, 700), ("tail", 10, 20)] for n in range(1, 41)]
    raw = pdf_writer.write(pages)
    assert [s for s, _ in pdf.page_layout(pdf.Document(raw), 7).runs] == ["page 7 é😀", "tail"]
    for n, content in enumerate((raw, raw, b"nothing", build([text_page((1, 1, "x")), None])), 1):
        (tmp_path / f"{n}.pdf").write_bytes(content)
    files = loader.scan(spark, str(tmp_path)).selectExpr("cast(regexp_extract(path, '([0-9]+).pdf', 1) as long) as doc_id", "path", "length", "content", "if(path like '%2.pdf', array(3L, 39L, 99L), null) as target")
    found = []
    for most in (400, 1 << 30):
        decoded = loader.decode(files, part_bytes=most)
        heads = {r.doc_id: (r.num_pages, r.error) for r in loader.heads(decoded).collect()}
        runs = sorted((r.doc_id, r.page, r.seq, r.str, r.y) for r in loader.runs(decoded).collect())
        errors = [(r.doc_id, r.page) for r in loader.page_errors(decoded).collect()]
        found.append((heads, runs, errors, sorted((r.doc_id, r.page) for r in loader.selected_pages(decoded).collect())))
    assert found[0] == found[1]
    heads, runs, errors, chosen = found[0]
    assert heads[1] == (40, None) == heads[2] and heads[3][0] is None and "Invalid PDF" in heads[3][1] and heads[4] == (2, None)
    assert chosen == [(1, n) for n in range(1, 41)] + [(2, 3), (2, 39), (4, 1), (4, 2)] and errors == [(4, 2)]
    assert len(runs) == 85
    decoded = loader.decode(files, part_bytes=400)
    # a row a page: no row holds a whole document; no exchange holds contents, and great files' contents aren't read
    assert decoded.where("doc_id = 1 and page is not null").count() == 40
    plan = decoded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not any("content" in line for line in plan.splitlines() if "Exchange" in line)
    assert [line for line in plan.splitlines() if "FileScan" in line and "content" not in line]


def test_images_are_rows_of_their_own(spark):
    gray = ("/Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray", b"\x10\x20")
    raw = build(["/A Do /B Do", "/A Do"], {"A": gray, "B": gray})
    files = spark.createDataFrame([(1, bytearray(raw), None)], "doc_id long, content binary, target array<long>")
    decoded = loader.decode(files, with_images=True).cache()
    assert sorted((r.page, r.name, bytes(r.data)) for r in loader.image_objects(decoded).collect()) == [(1, "A", b"\x10\x20"), (1, "B", b"\x10\x20"), (2, "A", b"\x10\x20")]
    assert sorted((r.page, r.op_pos, r.obj_name) for r in loader.paint_ops(decoded).collect()) == [(1, 0, "A"), (1, 1, "B"), (2, 0, "A")]
    assert loader.selected_pages(decoded).count() == 2
    decoded.unpersist()
