"""Files behind urls as a source: fetched by the executors, hosts dealt to tasks, under an allow-list.

A host's urls go to LANES lanes at most, so no host is asked by more tasks at once than that, however many urls name it,
and a host that a third of all urls name is still several tasks. Every hop of a redirect has to pass the allow-list as
the first url did; answers beyond a size are refused while they come in, not after; a host that fails for a while is asked again."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that ask one host at once.
LANES = 4
#: Answers after which the same request may yet succeed.
_PASSING = (408, 429, 500, 502, 503, 504)


class WebError(ValueError):
    """A url that may not be fetched, or whose answer may not be taken."""


@dataclass(frozen=True)
class Fetcher:
    """fetch(url) for hosts of an allow-list: a name, or .name for all below it, with a port (host:port) where it isn't the scheme's own."""

    allowed: tuple[str, ...]
    most_bytes: int = 256 << 20
    seconds: float = 30.0
    tries: int = 3
    wait: float = 0.5
    hops: int = 5

    def admits(self, url: str) -> bool:
        parts = urlsplit(url)
        if parts.scheme.lower() not in ("http", "https") or not parts.hostname or parts.username is not None:
            return False
        host = parts.hostname.lower().rstrip(".")
        place = f"{host}:{parts.port}" if parts.port is not None else host
        return any(place == a.lower() or (a.startswith(".") and place.endswith(a.lower())) for a in self.allowed)

    def __call__(self, url: str) -> bytes:
        for attempt in range(1, self.tries + 1):
            try:
                return self._once(url)
            except urllib.error.HTTPError as e:
                if e.code not in _PASSING or attempt == self.tries:
                    raise WebError(f"HTTP status {e.code}") from e
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if attempt == self.tries:
                    raise WebError(f"{getattr(e, 'reason', e)}") from e
            time.sleep(self.wait * 2 ** (attempt - 1))
        raise WebError("no attempt was made")

    def _once(self, url: str) -> bytes:
        opener = urllib.request.build_opener(urllib.request.ProxyHandler({}), _NoRedirect())
        for _ in range(self.hops + 1):
            if not self.admits(url):
                raise WebError(f"not an allowed host: {urlsplit(url).hostname}")
            with opener.open(urllib.request.Request(url, headers={"User-Agent": "quire"}), timeout=self.seconds) as answer:
                if answer.status in (301, 302, 303, 307, 308):
                    url = urljoin(url, answer.headers.get("Location", ""))
                    continue
                out = bytearray()
                while piece := answer.read(1 << 16):
                    out += piece
                    if len(out) > self.most_bytes:
                        raise WebError(f"more than {self.most_bytes} bytes")
                return bytes(out)
        raise WebError("too many redirects")


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    """Redirects come back as answers, so that each hop is looked at."""

    def http_error_302(self, req, fp, code, msg, headers):
        return fp

    http_error_301 = http_error_303 = http_error_307 = http_error_308 = http_error_302


def fetched(urls: DataFrame, fetch) -> DataFrame:
    """doc_id, content, failure of each of urls (doc_id, url); a url that fails fails alone. fetch is picklable, Fetcher for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("failure", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    content, failure = fetch(row["url"]), None
                except Exception as e:
                    content, failure = None, str(e) or "Unknown loading error"
                yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"], "content": content, "failure": failure}], schema=schema)

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1))
    lane = F.pmod(F.xxhash64("url"), F.lit(LANES))
    spread = urls.sparkSession.sparkContext.defaultParallelism
    return urls.select("doc_id", "url", host.alias("host"), lane.alias("lane")).repartition(spread, "host", "lane").mapInArrow(run, "doc_id long, content binary, failure string")
