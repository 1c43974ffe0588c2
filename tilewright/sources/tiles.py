"""Readers of binary tiles and of polygon bytes, as DataFrame columns and row tables.

A tile is a 28-byte header (magic, version, total length, four section lengths), a feature table, a batch table and
an inner container of chunks (length, kind, bytes). All numbers are little-endian unsigned 32-bit.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Magic words, versions, chunk kinds, sizes of headers, limits.
TILE_MAGIC, INNER_MAGIC, TILE_VERSION, INNER_VERSION = "b3dm", "glTF", 1, 2
CHUNK_JSON, CHUNK_BIN = 0x4E4F534A, 0x004E4942
TILE_HEADER, INNER_HEADER, CHUNK_HEADER, MOST_PADDING = 28, 12, 8, 7
MOST_ELEMENTS = 100_000_000
MOST_POLYGONS, MOST_RINGS, MOST_POINTS = 100_000, 100_000, 2_000_000
SRID_FLAG = 0x20000000


def u32(content: Column, offset) -> Column:
    """Number at a byte offset (from 0); null where the bytes end before."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    # The lambda names the eight digits, which would otherwise be computed for every use.
    swapped = lambda h: F.when(F.length(h) == 8, F.conv(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long"))
    return F.get(F.transform(F.array(F.hex(F.substring(content, at.cast("int") + 1, F.lit(4)))), swapped), F.lit(0))


def put_u32(n: Column) -> Column:
    """The four bytes of a number."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


def _text(content: Column, at, size: int) -> Column:
    return F.substring(content, (at if isinstance(at, Column) else F.lit(at)).cast("int") + 1, F.lit(size)).cast("string")


def catalogue(tiles: DataFrame, content: str = "content") -> DataFrame:
    """One row a tile: section lengths, where the inner container starts, trailing bytes, and ``code``.

    The code is OK, COMPATIBLE (inner container aligned to 4 bytes only) or the first broken rule. The content itself
    is dropped. A null or short content is TOO_SHORT.
    """
    c = F.col(content)
    fields = {"version": 4, "total": 8, "feature_json": 12, "feature_bin": 16, "batch_json": 20, "batch_bin": 24}
    out = tiles.withColumns({"actual": F.coalesce(F.length(c), F.lit(0)).cast("long"), **{k: u32(c, v) for k, v in fields.items()}})
    out = out.withColumn("inner_offset", F.lit(TILE_HEADER) + F.col("feature_json") + F.col("feature_bin") + F.col("batch_json") + F.col("batch_bin"))
    out = out.withColumns({"inner_length": u32(c, F.col("inner_offset") + 8), "_magic": _text(c, 0, 4), "_inner": _text(c, F.col("inner_offset"), 4), "_iv": u32(c, F.col("inner_offset") + 4)})
    end = F.col("inner_offset") + F.col("inner_length")
    out = out.withColumn("padding", F.col("actual") - end)
    tail = F.hex(F.substring(c, end.cast("int") + 1, F.lit(MOST_PADDING + 1)))
    code = F.when(F.col("actual") < TILE_HEADER, "TOO_SHORT").when(F.col("_magic") != TILE_MAGIC, "BAD_MAGIC").when(F.col("version") != TILE_VERSION, "BAD_VERSION")
    code = code.when(F.col("total") != F.col("actual"), "BAD_LENGTH").when(F.col("inner_offset") + INNER_HEADER > F.col("actual"), "SECTION_BOUNDS").when(F.col("inner_offset") % 4 != 0, "MISALIGNED")
    code = code.when((F.col("_inner") != INNER_MAGIC) | (F.col("_iv") != INNER_VERSION), "BAD_INNER").when(F.col("padding") < 0, "INNER_BOUNDS")
    code = code.when((F.col("padding") > MOST_PADDING) | tail.rlike("[1-9A-F]"), "TRAILING_BYTES").when(F.col("inner_offset") % 8 != 0, "COMPATIBLE").otherwise("OK")
    return out.withColumn("code", code).drop("_magic", "_inner", "_iv", content)


def chunks(tiles: DataFrame, content: str = "content", inner: str = "inner_offset") -> DataFrame:
    """Chunks of the inner container: place in the chain, kind, offset of the bytes, length. The first must be JSON.

    A container holds a JSON chunk and at most one binary chunk, so the chain has two steps.
    """
    c, start = F.col(content), F.col(inner) + INNER_HEADER
    end = F.col(inner) + u32(c, F.col(inner) + 8)

    def step(no: int, at: Column) -> Column:
        return F.struct(F.lit(no).alias("chunk"), u32(c, at + 4).alias("kind"), (at + CHUNK_HEADER).alias("offset"), u32(c, at).alias("length"))

    first = step(0, start)
    second_at = start + CHUNK_HEADER + u32(c, start)
    listed = F.array(first, F.when(second_at + CHUNK_HEADER <= end, step(1, second_at)))
    out = tiles.withColumn("_c", F.explode(F.array_compact(listed))).drop(content)
    name = F.when(F.col("_c.kind") == CHUNK_JSON, "JSON").when(F.col("_c.kind") == CHUNK_BIN, "BIN").otherwise("OTHER")
    return out.select(*[k for k in out.columns if k != "_c"], "_c.chunk", name.alias("kind"), "_c.offset", "_c.length")


def chain_fault(content: Column, inner: Column) -> Column:
    """What is wrong with the chain of chunks of a container at byte ``inner``; null if nothing.

    A JSON chunk, then at most one binary chunk, then the end: CHUNK_END (header or bytes run past the container),
    CHUNK_ALIGNMENT (a length that is no multiple of four), CHUNK_ORDER (the first is not JSON, or there is none),
    CHUNK_UNSUPPORTED (a second chunk that is not binary, or a third one). Each chunk is judged whole before the next.
    """
    start, end = inner + INNER_HEADER, inner + u32(content, inner + 8)

    def judged(at: Column, kind: int | None, code: str) -> Column:
        size = u32(content, at)
        fault = F.when(at + CHUNK_HEADER > end, "CHUNK_END").when(size % 4 != 0, "CHUNK_ALIGNMENT").when(at + CHUNK_HEADER + size > end, "CHUNK_END")
        return fault.otherwise(F.lit(code)) if kind is None else fault.when(u32(content, at + 4) != kind, code)

    second = start + CHUNK_HEADER + u32(content, start)
    third = second + CHUNK_HEADER + u32(content, second)
    more = F.when(third < end, judged(third, None, "CHUNK_UNSUPPORTED"))
    return F.when(start >= end, "CHUNK_ORDER").otherwise(F.coalesce(judged(start, CHUNK_JSON, "CHUNK_ORDER"), F.when(second < end, F.coalesce(judged(second, CHUNK_BIN, "CHUNK_UNSUPPORTED"), more))))


def mesh(tiles: DataFrame, key: str, view: str = "layout", content: str = "content") -> DataFrame:
    """Vertices of binary chunks: (key, vid, x, y, z). ``layout`` is JSON with count, offset and stride in bytes.

    Rows whose layout is missing, runs past the bytes, passes 100 million elements or holds non-finite values
    give ``fault`` instead of vertices.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, text, raw in zip(pdf[key], pdf[view], pdf[content]):
                fault, at = None, np.zeros((0, 3))
                try:
                    m = json.loads(text)
                    n, low, stride = int(m["count"]), int(m["offset"]), int(m.get("stride") or 12)
                    if n < 0 or low < 0 or stride < 12 or n > MOST_ELEMENTS or (n and low + (n - 1) * stride + 12 > len(raw)):
                        fault = "RANGE"
                    elif n:
                        at = np.ndarray((n, 3), "<f4", raw, low, (stride, 4)).astype(float)
                        fault = None if np.isfinite(at).all() else "NOT_FINITE"
                except (TypeError, ValueError, KeyError, AttributeError):
                    fault = "LAYOUT"
                if fault:
                    yield pd.DataFrame({"key": [k], "vid": [None], "x": [None], "y": [None], "z": [None], "fault": [fault]}).astype({"x": float, "y": float, "z": float, "vid": "Int64"})
                for lo in range(0, 0 if fault else len(at), 1 << 16):
                    p = at[lo : lo + (1 << 16)]
                    yield pd.DataFrame({"key": k, "vid": pd.array(np.arange(lo, lo + len(p)), dtype="Int64"), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "fault": None})

    rows = tiles.select(F.col(key).cast("long").alias(key), F.col(view).alias(view), F.col(content).alias(content)).mapInPandas(decode, "key long, vid long, x double, y double, z double, fault string")
    return rows.withColumnRenamed("key", key)


def ring_points(raw: bytes) -> Iterator[tuple[int, int, np.ndarray, int | None]]:
    """(polygon, ring, points, srid) of a polygon or multipolygon in WKB, either byte order, with or without SRID."""
    at = 0

    def take(fmt: str, order: str) -> int:
        nonlocal at
        (v,) = struct.unpack_from(order + fmt, raw, at)
        at += struct.calcsize(fmt)
        return v

    def head() -> tuple[str, int, int | None]:
        flag = take("B", "<")
        if flag > 1:
            raise ValueError("byte order")
        order = "<" if flag else ">"
        kind = take("I", order)
        return order, kind & 0xFF if kind & ~SRID_FLAG < 256 else -1, take("I", order) if kind & SRID_FLAG else None

    order, kind, srid = head()
    if kind not in (3, 6):
        raise ValueError("kind")
    n = take("I", order) if kind == 6 else 1
    if n > MOST_POLYGONS:
        raise ValueError("polygons")
    for polygon in range(n):
        if kind == 6:
            order, inner, _ = head()
            if inner != 3:
                raise ValueError("kind")
        rings = take("I", order)
        if rings > MOST_RINGS:
            raise ValueError("rings")
        for ring in range(rings):
            points = take("I", order)
            if points > MOST_POINTS or at + 16 * points > len(raw):
                raise ValueError("points")
            xy = np.frombuffer(raw, order + "f8", 2 * points, at).reshape(-1, 2).astype(float)
            at += 16 * points
            if not np.isfinite(xy).all():
                raise ValueError("not finite")
            yield polygon, ring, xy, srid
    if at != len(raw):
        raise ValueError("trailing bytes")


def scope_rings(scopes: DataFrame, key: str, wkb: str = "wkb") -> DataFrame:
    """Ring points of base64 WKB: (key, polygon_id, ring_id, seq, lon, lat, srid); a broken text gives one ``fault`` row."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, raw in zip(pdf[key], pdf[wkb]):
                try:
                    mine = [(k, p, r, s, x, y, srid, None) for p, r, xy, srid in ring_points(raw) for s, (x, y) in enumerate(xy.tolist())]
                except (TypeError, ValueError, struct.error):
                    mine = [(k, None, None, None, None, None, None, "WKB")]
                out += mine
                if len(out) > 1 << 16:
                    yield _frame(out)
                    out = []
            yield _frame(out)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = ["key", "polygon_id", "ring_id", "seq", "lon", "lat", "srid", "fault"]
        return pd.DataFrame(rows, columns=names).astype({"key": "Int64", "polygon_id": "Int32", "ring_id": "Int32", "seq": "Int32", "lon": float, "lat": float, "srid": "Int64"})

    rows = scopes.select(F.col(key).cast("long").alias(key), F.try_to_binary(F.col(wkb), F.lit("base64")).alias(wkb))
    return rows.mapInPandas(decode, "key long, polygon_id int, ring_id int, seq int, lon double, lat double, srid long, fault string").withColumnRenamed("key", key)
