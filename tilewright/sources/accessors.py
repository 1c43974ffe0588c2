"""Strided accessors of binary chunks: vertices with all their attributes, and triangles of indices.

A primitive's layout is JSON: ``attributes`` (POSITION, and NORMAL, TEXCOORD_0, COLOR_0 if it has them) and ``indices``
if it has any, each an accessor with count, componentType, offset (of its view), length (of its view), at (within
the view) and stride. Rows of many primitives leave in batches; a broken primitive leaves one row with its fault.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import MOST_ELEMENTS

# Component types with their bytes, components of each attribute, the longest stride.
FLOAT, INDEX_TYPES = 5126, {5121: "<u1", 5123: "<u2", 5125: "<u4"}
WIDTHS = {"POSITION": 3, "NORMAL": 3, "TEXCOORD_0": 2, "COLOR_0": 4}
MOST_STRIDE = 252
ROWS = 1 << 16  # a batch

VERTEX = "key long, vid long, position array<float>, normal array<float>, uv array<float>, color array<float>, fault string"
INDEX = "key long, tri_id long, i0 long, i1 long, i2 long, fault string"


class Fault(ValueError):
    """A rule that a primitive breaks."""


def view(accessor: dict, raw: bytes, kind: str, width: int) -> np.ndarray:
    """The accessor's elements, count x width, without a copy; faults as the rules name them."""
    if accessor.get("sparse") or accessor.get("normalized"):
        raise Fault("UNSUPPORTED")
    size = np.dtype(kind).itemsize
    n, element = int(accessor["count"]), size * width
    if not 0 < n <= MOST_ELEMENTS:
        raise Fault("COUNT")
    stride = int(accessor.get("stride") or element)
    if stride < element or stride > MOST_STRIDE or stride % size:
        raise Fault("STRIDE")
    start, length, at = int(accessor.get("offset", 0)), int(accessor["length"]), int(accessor.get("at", 0))
    needed = (n - 1) * stride + element
    if min(start, length, at) < 0 or at + needed > length or start + at + needed > len(raw):
        raise Fault("RANGE")
    return np.ndarray((n, width), kind, raw, start + at, (stride, size))


def attributes_of(layout: dict, raw: bytes) -> dict[str, np.ndarray]:
    found = {}
    for name, accessor in layout["attributes"].items():
        if name not in WIDTHS:
            raise Fault("UNSUPPORTED")
        if accessor.get("componentType") != FLOAT:
            raise Fault("TYPE")
        width = int(accessor.get("width", WIDTHS[name]))
        if width != WIDTHS[name] and not (name == "COLOR_0" and width == 3):
            raise Fault("TYPE")
        found[name] = view(accessor, raw, "<f4", width)
        if not np.isfinite(found[name]).all():
            raise Fault("NOT_FINITE")
    if "POSITION" not in found:
        raise Fault("NO_POSITION")
    if len({len(v) for v in found.values()}) > 1:
        raise Fault("COUNTS_DIFFER")
    return found


def indices_of(layout: dict, raw: bytes, vertices: int) -> np.ndarray:
    """Triples of vertex numbers; without an index list all vertices in order."""
    accessor = layout.get("indices")
    if accessor is None:
        flat = np.arange(vertices, dtype=np.int64)
    else:
        if accessor.get("componentType") not in INDEX_TYPES:
            raise Fault("TYPE")
        flat = view(accessor, raw, INDEX_TYPES[accessor["componentType"]], 1)[:, 0].astype(np.int64)
    if len(flat) % 3:
        raise Fault("INDEX_COUNT")
    if len(flat) and flat.max() >= vertices:
        raise Fault("INDEX_RANGE")
    return flat.reshape(-1, 3)


def _parsed(text: str | None, raw: bytes | None) -> tuple[dict, bytes]:
    layout = json.loads(text or "")
    if raw is None or not isinstance(layout, dict) or not isinstance(layout.get("attributes"), dict):
        raise Fault("LAYOUT")
    return layout, raw


def _rows(decode, empty):
    """Batches of about ``ROWS`` rows from what ``decode`` makes of each primitive, or of its fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for key, text, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    part = decode(key, *_parsed(text, raw))
                except Fault as e:
                    part = empty(key, str(e))
                except (TypeError, ValueError, KeyError, AttributeError):
                    part = empty(key, "LAYOUT")
                for at in range(0, part.num_rows, ROWS):
                    held.append(part.slice(at, ROWS))
                    n += held[-1].num_rows
                    if n >= ROWS:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches(ROWS)
                        held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(ROWS)

    return run


def _lists(values: np.ndarray | None, n: int) -> pa.Array:
    if values is None:
        return pa.nulls(n, pa.list_(pa.float32()))
    flat = np.ascontiguousarray(values, dtype=np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.reshape(-1)))


def vertices(primitives: DataFrame, key: str, layout: str = "layout", content: str = "content") -> DataFrame:
    """key, vid, position, normal, uv, color of every vertex (null where the primitive has no such attribute), or a fault."""
    names = ["key", "vid", "position", "normal", "uv", "color", "fault"]

    def batch(keys, vids, lists, faults):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(vids, pa.int64()), *lists, pa.array(faults, pa.string())], names=names)

    def decode(k, parsed, raw):
        found = attributes_of(parsed, raw)
        n = len(found["POSITION"])
        return batch(np.full(n, k), np.arange(n), [_lists(found.get(a), n) for a in WIDTHS], [None] * n)

    empty = lambda k, fault: batch([k], [None], [_lists(None, 1)] * 4, [fault])
    return _read(primitives, key, layout, content, _rows(decode, empty), VERTEX)


def index(primitives: DataFrame, key: str, layout: str = "layout", content: str = "content") -> DataFrame:
    """key, tri_id, i0, i1, i2 of every triangle, or a fault; also that of the primitive's vertices."""
    names = ["key", "tri_id", "i0", "i1", "i2", "fault"]

    def batch(keys, *columns_and_faults):
        *columns, faults = columns_and_faults
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(c, pa.int64()) for c in columns], pa.array(faults, pa.string())], names=names)

    def decode(k, parsed, raw):
        t = indices_of(parsed, raw, len(attributes_of(parsed, raw)["POSITION"]))
        return batch(np.full(len(t), k), np.arange(len(t)), t[:, 0], t[:, 1], t[:, 2], [None] * len(t))

    return _read(primitives, key, layout, content, _rows(decode, lambda k, fault: batch([k], [None], [None], [None], [None], [fault])), INDEX)


def _read(primitives: DataFrame, key: str, layout: str, content: str, run, schema: str) -> DataFrame:
    rows = primitives.select(F.col(key).cast("long").alias("key"), F.col(layout).cast("string").alias("layout"), F.col(content).alias("content"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
