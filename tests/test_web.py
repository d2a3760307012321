"""Urls against a local HTTP server: allow-list, redirects, sizes, repeated attempts, and the server process's own path."""

import io
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quire import server
from quire.sources import web

from .pdf_writer import build, text_page

PDF = build([text_page((1, 1, f"page {n}")) for n in (1, 2)])


@pytest.fixture(scope="module")
def site():
    asked = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] = asked.get(self.path, 0) + 1
            status, body, place = {
                "/a.pdf": (200, PDF, None),
                "/moved": (302, b"", "/a.pdf"),
                "/away": (302, b"", "http://elsewhere.invalid/a.pdf"),
                "/file": (302, b"", "file:///etc/hostname"),
                "/round": (302, b"", "/round"),
                "/busy": (503 if asked[self.path] < 3 else 200, PDF, None),
                "/large": (200, b"x" * 300_000, None),
            }.get(self.path, (404, b"", None))
            self.send_response(status)
            if place:
                self.send_header("Location", place)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    running = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{running.server_port}", asked
    running.shutdown()


def test_hosts_are_admitted_by_name():
    fetch = web.Fetcher(("example.org", ".below.net", "local:81"))
    yes = ["http://example.org/a", "https://EXAMPLE.org./", "http://x.below.net/", "http://local:81/"]
    no = ["http://sub.example.org/", "http://below.net.evil.org/", "http://evilbelow.net/", "http://example.org:8080/", "http://local/", "ftp://example.org/", "file:///etc/passwd", "http://example.org@evil.org/", "http://u:p@example.org/", "http:///x"]
    assert all(map(fetch.admits, yes)) and not any(map(fetch.admits, no))


def test_one_fetch(site):
    host, asked = site
    fetch = web.Fetcher((host,), most_bytes=100_000, wait=0.01)
    assert fetch(f"http://{host}/a.pdf") == PDF == fetch(f"http://{host}/moved") == fetch(f"http://{host}/busy")
    assert asked["/busy"] == 3
    for path, message in (("/away", "not an allowed host"), ("/file", "not an allowed host"), ("/round", "too many redirects"), ("/large", "more than 100000 bytes"), ("/none", "HTTP status 404")):
        with pytest.raises(web.WebError, match=message):
            fetch(f"http://{host}{path}")
    assert asked["/none"] == 1
    with pytest.raises(web.WebError, match="not an allowed host"):
        web.Fetcher(("other.org",))(f"http://{host}/a.pdf")
    with pytest.raises(web.WebError):
        web.Fetcher(("127.0.0.1:9",), tries=2, wait=0.01)("http://127.0.0.1:9/")


def test_urls_of_the_server(spark, site, tmp_path):
    host, asked = site
    before = asked.get("/a.pdf", 0)
    sources = [{"url": f"http://{host}/a.pdf", "pages": "2"}, {"url": f"http://{host}/a.pdf"}, {"url": f"http://{host}/none"}, {"url": "http://elsewhere.invalid/a.pdf"}]
    call = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "read_pdf", "arguments": {"sources": sources}}}

    def told(fetch):
        out = io.StringIO()
        server.serve(spark, [json.dumps(call)], out, str(tmp_path), fetch)
        return json.loads(json.loads(out.getvalue())["result"]["content"][0]["text"])["results"]

    found = told(web.Fetcher((host,), wait=0.01))
    assert [r["success"] for r in found] == [True, True, False, False]
    assert found[0]["data"]["page_texts"] == [{"page": 2, "text": "page 2"}] and found[1]["data"]["num_pages"] == 2
    assert "HTTP status 404" in found[2]["error"] and "not an allowed host" in found[3]["error"]
    assert asked["/a.pdf"] == before + 1  # two sources, one fetch
    assert not any(r["success"] for r in told(None))


def test_a_host_is_asked_by_a_few_tasks(spark):
    urls = spark.createDataFrame([(i, f"http://one.org/{i}") for i in range(60)] + [(100 + i, f"http://h{i}.org/") for i in range(20)], "doc_id long, url string")
    found = web.fetched(urls, lambda url: url.encode()).selectExpr("*", "spark_partition_id() as p").collect()
    assert {r.doc_id: bytes(r.content).decode() for r in found} == {r.doc_id: r.url for r in urls.collect()}
    assert len({r.p for r in found if r.doc_id < 60}) <= web.LANES
