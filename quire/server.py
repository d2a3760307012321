"""The tool surface as a process: JSON-RPC requests, one a line, on the standard input, answers on the output.

    python -m quire.server [root] [--allow HOST]...

Urls are fetched from allowed hosts only (HOST, HOST:PORT, or .HOST for all below it); without any they are refused.

Methods: initialize, ping, tools/list, tools/call. A request without an id is a notification and has no answer. A
line that is no JSON or a request that fails is answered by an error, and the next one is served.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import SparkSession

from quire import service
from quire.operators.paths import RequestError
from quire.sources import web

NAME, VERSION, PROTOCOL = "quire", "0.2.0", "2024-11-05"


def _failure(code: int, message: str) -> dict:
    return {"error": {"code": code, "message": message}}


def answer(spark: SparkSession, request: object, root: str, fetch: service.Fetcher | None = None) -> dict | None:
    """The answer to one request, None to a notification."""
    if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
        return {"jsonrpc": "2.0", "id": None} | _failure(-32600, "Invalid Request")
    method, given = request["method"], request.get("params") or {}
    try:
        if method == "initialize":
            body = {"result": {"protocolVersion": given.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": VERSION}}}
        elif method == "ping":
            body = {"result": {}}
        elif method == "tools/list":
            body = {"result": service.list_tools()}
        elif method == "tools/call":
            body = {"result": service.call_tool(spark, given.get("name"), given.get("arguments"), root, fetch)}
        else:
            body = _failure(RequestError.CODES["MethodNotFound"], "Method not found")
    except RequestError as e:
        body = _failure(RequestError.CODES[e.kind], str(e))
    except Exception as e:
        body = _failure(-32603, f"{type(e).__name__}: {e}".splitlines()[0])
    return {"jsonrpc": "2.0", "id": request["id"]} | body if "id" in request else None


def serve(spark: SparkSession, lines: Iterable[str], out: TextIO, root: str, fetch: service.Fetcher | None = None) -> None:
    """Answer the requests of all lines in turn, until they end."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError:
            told: dict | None = {"jsonrpc": "2.0", "id": None} | _failure(-32700, "Parse error")
        else:
            told = answer(spark, request, root, fetch)
        if told is not None:
            out.write(json.dumps(told, ensure_ascii=False) + "\n")
            out.flush()


def main(arguments: list[str]) -> int:
    import os

    from quire.session import local_session, ship

    parser = argparse.ArgumentParser(prog="quire.server")
    parser.add_argument("root", nargs="?", default=os.getcwd())
    parser.add_argument("--allow", action="append", default=[], metavar="HOST")
    given = parser.parse_args(arguments)
    root, fetch = os.path.abspath(given.root), web.Fetcher(tuple(given.allow)) if given.allow else None
    try:
        spark = SparkSession.getActiveSession() or (SparkSession.builder.getOrCreate() if os.environ.get("SPARK_MASTER") else local_session())
        ship(spark)
    except Exception as e:
        print(f"quire: no session: {e}", file=sys.stderr)
        return 1
    print(f"quire: serving {root} on stdio", file=sys.stderr)
    serve(spark, sys.stdin, sys.stdout, root, fetch)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
