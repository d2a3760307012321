"""Painted images: paint ordinals, object resolution, validity, formats, pixels and PNG."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType

from quire.functions import js
from quire.session import materialise

#: Operation codes that paint an image.
PAINT_CODES = (89, 92)


def paint_ordinals(paint_ops: DataFrame, codes: tuple[int, ...] = PAINT_CODES) -> DataFrame:
    """Painting operations with index: their ordinal on the page from 0, before anything else is filtered."""
    order = Window.partitionBy("doc_id", "page").orderBy("op_pos")
    return paint_ops.where(F.col("fn").isin(*codes)).withColumn("index", F.row_number().over(order) - 1)


def image_y(y: Column) -> Column:
    """Rounded height of an image; 0 without a matrix."""
    return F.coalesce(js.round_half_up(y), F.lit(0).cast("long"))


def resolve_objects(painted: DataFrame, objects: DataFrame) -> DataFrame:
    """Painted operations with their object's columns and origin (common, page, null).

    Names that begin with g_ are looked up among the document-wide objects first, then on the page, any
    other on the page only. Presence decides, not whether the object can be used."""
    named = painted.where(F.col("obj_name").isNotNull())
    value = F.struct("width", "height", "kind", "data")
    wide = objects.where("scope = 'common'").select("doc_id", F.col("name").alias("obj_name"), value.alias("wide"))
    own = objects.where("scope = 'page'").select("doc_id", "page", F.col("name").alias("obj_name"), value.alias("own"))
    joined = named.join(wide, ["doc_id", "obj_name"], "left").join(own, ["doc_id", "page", "obj_name"], "left")
    global_hit = F.col("obj_name").startswith("g_") & F.col("wide").isNotNull()
    chosen = F.when(global_hit, F.col("wide")).otherwise(F.col("own"))
    origin = F.when(global_hit, F.lit("common")).when(F.col("own").isNotNull(), F.lit("page"))
    return joined.withColumn("origin", origin).withColumn("_o", chosen).select(*painted.columns, "origin", F.col("_o.width").alias("width"), F.col("_o.height").alias("height"), F.col("_o.kind").alias("kind"), F.col("_o.data").alias("data"))


def valid_images(resolved: DataFrame) -> DataFrame:
    """Resolved operations with data and a width and height other than 0."""
    return resolved.where(F.col("data").isNotNull() & (F.coalesce("width", F.lit(0)) != 0) & (F.coalesce("height", F.lit(0)) != 0))


def channels(kind: Column) -> Column:
    return F.when(kind == 1, 1).when(kind == 3, 4).otherwise(3)


def image_format(kind: Column) -> Column:
    return F.when(kind == 1, F.lit("grayscale")).when(kind == 3, F.lit("rgba")).otherwise(F.lit("rgb"))


def pixel_statistics(images: DataFrame) -> DataFrame:
    """doc_id, index, n_bytes, byte_sum of the RGBA expansion of array<int> data, without expanding it.

    Missing bytes count as 0, bytes beyond the image are not read."""
    pixels = (F.col("width") * F.col("height")).cast("long")
    step = channels(F.col("kind"))
    used = F.slice(F.col("data"), 1, (pixels * step).cast("int"))
    total = F.aggregate(used, F.lit(0).cast("long"), lambda acc, v: acc + v.cast("long"))
    colour = F.when(step == 1, 3 * total).otherwise(total)
    return images.select("doc_id", "page", "index", (pixels * 4).alias("n_bytes"), (colour + F.when(step == 4, 0).otherwise(255 * pixels)).alias("byte_sum"))


def to_rgba(data: bytes, width: int, height: int, kind: int | None) -> np.ndarray:
    """height x width x 4 bytes; missing source bytes are 0."""
    step = {1: 1, 3: 4}.get(kind, 3)
    source = np.zeros(width * height * step, dtype=np.uint8)
    given = np.frombuffer(data, dtype=np.uint8)[: len(source)]
    source[: len(given)] = given
    source = source.reshape(height, width, step)
    if step == 4:
        return source
    out = np.full((height, width, 4), 255, dtype=np.uint8)
    out[:, :, :3] = source
    return out


def png_bytes(rgba: np.ndarray) -> bytes:
    """A PNG file of 8-bit RGBA pixels."""
    height, width = rgba.shape[:2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.concatenate([np.zeros((height, 1), dtype=np.uint8), rgba.reshape(height, width * 4)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def encode_png(data: bytes, width: int, height: int, kind: int | None) -> str:
    """Base64, on one line, of the image's PNG."""
    return base64.b64encode(png_bytes(to_rgba(data, width, height, kind))).decode("ascii")


@F.pandas_udf(StringType())
def png_udf(data: pd.Series, width: pd.Series, height: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else encode_png(bytes(d), int(w), int(h), None if pd.isna(k) else int(k)) for d, w, h, k in zip(data, width, height, kind)], dtype=object)


@F.pandas_udf(BinaryType())
def pack_bytes(values: pd.Series) -> pd.Series:
    """array<int> to bytes."""
    return pd.Series([np.asarray(v, dtype=np.uint8).tobytes() for v in values], dtype=object)


#: Bytes of encoded images that are sent to every task at most; a larger dictionary is joined by a shuffle.
DICTIONARY_SENT = 32 << 20


def content_key(data: Column, width: Column, height: Column, kind: Column) -> Column:
    """128 bits of an image's bytes and shape, as hex."""
    shape = [c.cast("string") for c in (width, height, F.coalesce(kind, F.lit(0)))]
    return F.md5(F.concat_ws(":", F.hex(data), *shape).cast("binary"))


def dictionary(images: DataFrame) -> DataFrame:
    """key, placements, width, height, kind, data: each different image of images (data binary) once. Copies are taken together where they are read, before any shuffle."""
    keyed = images.select(content_key(F.col("data"), F.col("width"), F.col("height"), F.col("kind")).alias("key"), "width", "height", "kind", "data")
    return keyed.groupBy("key").agg(F.count("*").alias("placements"), *[F.first(c).alias(c) for c in ("width", "height", "kind", "data")])


def shared_pngs(images: DataFrame) -> DataFrame:
    """doc_id, page, index, png of images: each different image is encoded once and joined back.

    The encoded images are kept in the shared folder and weighed: few bytes go to every task; more are joined by a shuffle,
    where adaptive execution splits an image that stands on a third of all pages."""
    encoded = materialise(dictionary(images).select("key", png_udf("data", "width", "height", "kind").alias("png")), "pngs")
    size = encoded.agg(F.sum(F.length("png"))).first()[0] or 0
    placed = images.select("doc_id", "page", "index", content_key(F.col("data"), F.col("width"), F.col("height"), F.col("kind")).alias("key"))
    return placed.join(F.broadcast(encoded) if size <= DICTIONARY_SENT else encoded, "key").select("doc_id", "page", "index", "png")


def image_info(images: DataFrame) -> DataFrame:
    """doc_id, page, index, width, height, format without the pixels."""
    return images.select("doc_id", "page", "index", "width", "height", image_format(F.col("kind")).alias("format"))


def png_statistics(png: str) -> dict:
    """Width, height, bytes of pixels and their sum, read back from an encoded PNG file as this package writes them."""
    raw = base64.b64decode(png, validate=True)
    if raw[:8] != b"\x89PNG\r\n\x1a\n" or raw[12:16] != b"IHDR":
        raise ValueError("no PNG file")
    width, height = struct.unpack(">II", raw[16:24])
    at, packed = 8, b""
    while at < len(raw):
        size, kind = struct.unpack(">I", raw[at : at + 4])[0], raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged PNG file")
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(height, 1 + 4 * width)
    if rows[:, 0].any():
        raise ValueError("rows with a filter")
    return {"width": width, "height": height, "n_bytes": 4 * width * height, "byte_sum": int(rows[:, 1:].sum())}


@F.pandas_udf(StructType().add("width", IntegerType()).add("height", IntegerType()).add("n_bytes", LongType()).add("byte_sum", LongType()))
def png_statistics_udf(png: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([png_statistics(p) for p in png], columns=["width", "height", "n_bytes", "byte_sum"])
