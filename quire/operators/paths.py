"""Confinement of user paths to a root, for one path on the driver and as a column.

Paths are folded segment by segment from the root's own segments, and the result must be the root or lie
below it by whole segments, so that a sibling folder whose name begins with the root's is refused.
"""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_STRING, ABSOLUTE, OUTSIDE = "Path must be a string.", "Absolute paths are not allowed.", "Path traversal detected. Access denied."


class RequestError(Exception):
    """A refusal with a code; its text carries the code as clients see it."""

    CODES = {"InvalidRequest": -32600, "MethodNotFound": -32601, "InvalidParams": -32602}

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(f"MCP error {self.CODES[kind]}: {message}")
        self.kind, self.code, self.message = kind, self.CODES[kind], message


def resolve_path(path: object, root: str) -> str:
    """The real path of a user's relative path; links that lead outside are refused."""
    if not isinstance(path, str):
        raise RequestError("InvalidParams", NOT_STRING)
    if os.path.isabs(path):
        raise RequestError("InvalidParams", ABSOLUTE)
    top = os.path.realpath(root)
    full = os.path.realpath(os.path.join(top, path))
    if full != top and not full.startswith(top.rstrip(os.sep) + os.sep):
        raise RequestError("InvalidRequest", OUTSIDE)
    return full


def folded(path: Column, root: str) -> Column:
    """The path from the root with . and .. resolved, as text."""

    def step(acc: Column, segment: Column) -> Column:
        return F.when(segment.isin("", "."), acc).when(segment == "..", F.regexp_replace(acc, r"/[^/]*\z", "")).otherwise(F.concat(acc, F.lit("/"), segment))

    return F.aggregate(F.split(path, "/", -1), F.lit(root), step)


def path_status(path: Column, root: str) -> Column:
    """struct<status, resolved>: ok, absolute, traversal or missing."""
    full = folded(path, root)
    inside = (full == root) | full.startswith(root + "/")
    status = F.when(path.isNull(), F.lit("missing")).when(path.startswith("/"), F.lit("absolute")).when(inside, F.lit("ok")).otherwise(F.lit("traversal"))
    return F.struct(status.alias("status"), F.when(status == "ok", full).alias("resolved"))
