import base64
import json
import os
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pdf_writer import build, text_page  # noqa: E402

from quire import service  # noqa: E402
from quire.operators.paths import RequestError, resolve_path  # noqa: E402

GRAY = ("/Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray", b"\x00\x40\x80\xff")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("root")
    pages = [text_page((10, 700, "Page one")), "", text_page((10, 700, "Third "), (60, 700, "page"), (10, 100, "foot"), extra="q 9 0 0 9 0 400 cm /Im Do Q")]
    (top / "a.pdf").write_bytes(build(pages, {"Im": GRAY, "Jpg": ("/Width 1 /Height 1 /Filter /DCTDecode", b"x")}, info={"Title": "A"}))
    (top / "bad.pdf").write_bytes(b"nothing here")
    (top / "half.pdf").write_bytes(build([text_page((0, 1, "fine")), None], packed=True))
    (top.parent / (top.name + "-other")).mkdir()
    (top.parent / (top.name + "-other") / "x.pdf").write_bytes(b"")
    (top / "sub").mkdir()
    os.symlink(top.parent / (top.name + "-other"), top / "sub" / "out")
    return str(top)


def ask(spark, root, **args):
    answer = service.call_tool(spark, "read_pdf", args, root)["content"]
    return json.loads(answer[0]["text"])["results"], answer[1:]


def test_full_text_and_images_in_order(spark, root):
    results, parts = ask(spark, root, sources=[{"path": "a.pdf"}], include_full_text=True, include_images=True)
    data = results[0]["data"]
    assert results[0]["success"] and list(results[0]) == ["source", "success", "data"]
    assert (data["num_pages"], data["info"]["Title"], data["info"]["IsAcroFormPresent"]) == (3, "A", False)
    assert data["full_text"] == "Page one\n\n\n\nThird pagefoot"
    assert data["image_info"] == [{"page": 3, "index": 0, "width": 2, "height": 2, "format": "grayscale"}]
    assert [p["type"] for p in parts] == ["text", "text", "image", "text"] and parts[2]["mimeType"] == "image/png"
    png = base64.b64decode(parts[2]["data"])
    body = zlib.decompress(png[png.index(b"IDAT") + 4 :])
    assert body == b"\0" + bytes([0, 0, 0, 255, 64, 64, 64, 255]) + b"\0" + bytes([128, 128, 128, 255, 255, 255, 255, 255])


def test_mixed_batch_keeps_order_and_isolates_faults(spark, root):
    sources = [{"path": "a.pdf", "pages": "1,3-9"}, {"path": "none.pdf"}, {"path": "bad.pdf"}, {"path": "a.pdf", "pages": "5-3"}, {"path": "half.pdf"}, {"path": "../x.pdf"}, {"url": "http://h/x.pdf"}, {"path": "a.pdf", "pages": [9, 8, 9]}]
    results, _ = ask(spark, root, sources=sources, include_full_text=True, include_metadata=False)
    assert [r["success"] for r in results] == [True, False, False, False, True, False, False, True]
    assert results[0]["data"] == {"num_pages": 3, "warnings": ["Requested page numbers 4, 5, 6, 7, 8, 9 exceed total pages (3)."], "page_texts": [{"page": 1, "text": "Page one"}, {"page": 3, "text": "Third pagefoot"}]}
    assert results[1] == {"source": "none.pdf", "success": False, "error": "MCP error -32600: File not found at 'none.pdf'."}
    assert results[2]["error"].startswith("MCP error -32600: Failed to load PDF document from bad.pdf. Reason: Invalid PDF")
    assert results[3]["error"] == "MCP error -32602: Invalid page specification for source a.pdf: Invalid page range values: 5-3"
    assert results[4]["data"]["full_text"].startswith("fine\n\nError processing page: ")
    assert results[5]["error"].endswith("Path traversal detected. Access denied.")
    assert "fetching of urls is off" in results[6]["error"]
    assert results[7]["data"] == {"num_pages": 3, "warnings": ["Requested page numbers 8, 9 exceed total pages (3)."]}


def test_metadata_only_and_flags(spark, root):
    results, parts = ask(spark, root, sources=[{"path": "a.pdf"}])
    assert set(results[0]["data"]) == {"num_pages", "info", "metadata"} and parts == []
    results, _ = ask(spark, root, sources=[{"path": "a.pdf"}], include_metadata=False, include_page_count=False)
    assert results[0]["data"] == {}


def test_fetcher(spark, root):
    content = open(os.path.join(root, "a.pdf"), "rb").read()
    answer = service.handle(spark, {"sources": [{"url": "http://h/a.pdf", "pages": [1]}], "include_metadata": False}, root, fetch=lambda url: content)
    assert json.loads(answer["content"][0]["text"])["results"][0]["data"]["page_texts"] == [{"page": 1, "text": "Page one"}]

    def broken(url):
        raise OSError("no route")

    answer = service.handle(spark, {"sources": [{"url": "http://h/a.pdf"}]}, root, fetch=broken)
    assert "Failed to load PDF document from http://h/a.pdf. Reason: no route" in answer["content"][0]["text"]


@pytest.mark.parametrize(
    "args,told",
    [
        (None, "Expected object"), ({}, "sources (Required)"), ({"sources": []}, "at least 1"), ({"sources": "x"}, "Expected array"), ({"sources": [{}]}, "but not both"),
        ({"sources": [{"path": "a", "url": "http://x"}]}, "but not both"), ({"sources": [{"path": ""}]}, "sources.0.path"), ({"sources": [{"url": "nope"}]}, "Invalid url"),
        ({"sources": [{"path": "a", "pages": "1,abc,3"}]}, "only numbers, commas, and hyphens"), ({"sources": [{"path": "a", "pages": []}]}, "sources.0.pages"),
        ({"sources": [{"path": "a", "pages": [1, 0]}]}, "sources.0.pages"), ({"sources": [{"path": "a", "pages": [1.5]}]}, "sources.0.pages"), ({"sources": [{"path": "a", "x": 1}]}, "Unrecognized key"),
        ({"sources": [{"path": "a"}], "y": 1}, "Unrecognized key"), ({"sources": [{"path": "a"}], "include_images": "yes"}, "Expected boolean"), ({"sources": [{"path": 5}]}, "Expected string"),
    ],
)
def test_malformed_requests_are_refused_whole(args, told):
    with pytest.raises(RequestError) as e:
        service.validate(args)
    assert e.value.kind == "InvalidParams" and e.value.message.startswith("Invalid arguments: ") and told in e.value.message


def test_defaults_listing_and_unknown_tools(spark, root):
    request = service.validate({"sources": [{"path": "a", "pages": " 1 - 3 "}], "include_images": None})
    assert request.flags == {"include_full_text": False, "include_metadata": True, "include_page_count": True, "include_images": False}
    tool = service.list_tools()["tools"][0]
    assert tool["name"] == "read_pdf" and tool["inputSchema"]["required"] == ["sources"] and tool["inputSchema"]["additionalProperties"] is False
    with pytest.raises(RequestError, match="Unknown tool: x"):
        service.call_tool(spark, "x", {}, root)


def test_paths_are_confined(root):
    assert resolve_path("", root) == os.path.realpath(root)
    assert resolve_path("./sub/../a.pdf", root) == os.path.join(os.path.realpath(root), "a.pdf")
    assert resolve_path(f"../{os.path.basename(root)}/a.pdf", root).endswith("a.pdf")
    for path, kind in ((5, "InvalidParams"), ("/etc/passwd", "InvalidParams"), ("../up.pdf", "InvalidRequest"), ("../../../x", "InvalidRequest"), (f"../{os.path.basename(root)}-other/x.pdf", "InvalidRequest"), ("sub/out/x.pdf", "InvalidRequest")):
        with pytest.raises(RequestError) as e:
            resolve_path(path, root)
        assert e.value.kind == kind


def test_streamed_files(spark, root, tmp_path):
    from quire.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("one", "two"):
        (folder / f"{name}.pdf").write_bytes(build([text_page((0, 1, name))]))
        ingest.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "two"]
