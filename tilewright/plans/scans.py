"""Byte scans: tiles and polygons are written as bytes from the supplied tables, then read by `sources.tiles`."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.sources import accessors, tiles
from tilewright.sources.derived import derived


def _tiles(spark, sf_dir) -> DataFrame:
    """A tile an order: a feature table of 20, 24 or 26 bytes, no batch table, a JSON chunk, mostly a binary chunk; some broken."""
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k)
    feature = F.rpad(F.lit('{"BATCH_LENGTH":1}'), F.when(k % 11 == 0, 26).when(k % 3 == 0, 24).otherwise(20), " ").cast("binary")
    js = F.rpad(F.lit('{"asset":{}}'), (F.lit(12) + 4 * (k % 5)).cast("int"), " ").cast("binary")
    body = F.unhex(F.repeat(F.lit("AB"), (4 * (k % 6)).cast("int")))
    joined = lambda *c: F.concat(*c)
    binary = F.when(k % 6 == 0, F.unhex(F.lit(""))).otherwise(joined(tiles.put_u32(F.length(body)), tiles.put_u32(F.lit(tiles.CHUNK_BIN)), body))
    inner_body = joined(tiles.put_u32(F.length(js)), tiles.put_u32(F.lit(tiles.CHUNK_JSON)), js, binary)
    inner = joined(F.lit("glTF").cast("binary"), tiles.put_u32(F.lit(2)), tiles.put_u32(F.length(inner_body) + 12), inner_body)
    padding = F.unhex(F.when(k % 13 == 0, "0000").when(k % 17 == 0, "0001").otherwise(""))
    rest = joined(feature, inner, padding)
    total = F.length(rest) + tiles.TILE_HEADER + F.when(k % 19 == 0, 1).otherwise(0)
    zero = tiles.put_u32(F.lit(0))
    magic = F.when(k % 23 == 0, "nope").otherwise("b3dm").cast("binary")
    return o.withColumn("content", joined(magic, tiles.put_u32(F.lit(1)), tiles.put_u32(total), tiles.put_u32(F.length(feature)), zero, zero, zero, rest))


def tile_catalog_scan(spark, sf_dir):
    c = tiles.catalogue(_tiles(spark, sf_dir))
    return c.select("o_orderkey", "actual", "inner_offset", "inner_length", "padding", "code")


def tile_chunk_list(spark, sf_dir):
    t = _tiles(spark, sf_dir).withColumn("inner_offset", tiles.TILE_HEADER + tiles.u32(F.col("content"), 12))
    return tiles.chunks(t).select("o_orderkey", "chunk", "kind", "offset", "length")


def _binary_chunks(spark, sf_dir) -> DataFrame:
    """Vectors as binary chunks of 20 vertices, tightly packed or with a stride of 16; every seventh layout is too long."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, v in zip(pdf["vec_id"], pdf["embedding"]):
                xyz = np.asarray(v, dtype="<f4")[:60].reshape(20, 3)
                wide = np.pad(xyz, ((0, 0), (0, k % 2)))
                out.append((k, f'{{"count":{21 if k % 7 == 0 else 20},"offset":4,"stride":{wide.shape[1] * 4}}}', b"\0\0\0\0" + wide.tobytes()))
            yield pd.DataFrame(out, columns=["vec_id", "layout", "content"])

    return e.where("size(embedding) >= 60 AND vec_id IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)").mapInPandas(pack, "vec_id long, layout string, content binary")


def mesh_scan(spark, sf_dir):
    m = tiles.mesh(_binary_chunks(spark, sf_dir), "vec_id")
    return m.select("vec_id", "vid", *[F.round(c, 5).alias(c) for c in "xyz"], "fault")


def _primitives(spark, sf_dir) -> DataFrame:
    """Vectors of 64 values as primitives of 8 vertices with position, normal and texture coordinates.

    Even ones interleave their attributes; indices are bytes, shorts, words or absent (six vertices, then); some faults.
    """
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, v in zip(pdf["vec_id"], pdf["embedding"]):
                n, per = (6 if k % 4 == 3 else 8), 32 if k % 2 == 0 else 0
                table = np.asarray(v, dtype="<f4").reshape(8, 8)[:n]
                bounds = ((0, 3), (3, 6), (6, 8))
                raw = table.tobytes() if per else b"".join(table[:, a:b].tobytes() for a, b in bounds)
                at = [4 * a for a, _ in bounds] if per else [4 * n * a for a, _ in bounds]
                attributes = {name: {"count": n, "componentType": accessors.FLOAT, "length": 32 * n, "at": x, "stride": per} for name, x in zip(("POSITION", "NORMAL", "TEXCOORD_0"), at)}
                layout = {"attributes": attributes}
                if k % 4 < 3:
                    kind, size = ((5121, 1), (5123, 2), (5125, 4))[k % 4]
                    numbers = np.array([7, 6, 5, 4, 3, 2 + 6 * (k % 13 == 5)], dtype=f"<u{size}")
                    layout["indices"] = {"count": 6 - (k % 17 == 2), "componentType": kind, "offset": len(raw), "length": 6 * size}
                    raw += numbers.tobytes()
                if k % 19 == 4:
                    attributes["NORMAL"]["count"] = n - 1
                out.append((k, json.dumps(layout), raw))
            yield pd.DataFrame(out, columns=["vec_id", "layout", "content"])

    return e.where("size(embedding) = 64 AND vec_id IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)").mapInPandas(pack, "vec_id long, layout string, content binary")


def mesh_vertices(spark, sf_dir):
    """All 64 values of a vector, as attributes of its vertices."""
    v = accessors.vertices(_primitives(spark, sf_dir), "vec_id")
    each = [(F.round(F.col(c)[i].cast("double"), 5) + 0.0).alias(f"{c[0]}{i}") for c, w in (("position", 3), ("normal", 3), ("uv", 2)) for i in range(w)]
    return v.select("vec_id", "vid", *each, "fault")


def mesh_indices(spark, sf_dir):
    return accessors.index(_primitives(spark, sf_dir), "vec_id").select("vec_id", "tri_id", "i0", "i1", "i2", "fault")


def _wkb(spark, sf_dir) -> DataFrame:
    """Triangles as polygons in base64: odd ids big-endian, every third with SRID, every tenth as a multipolygon, some cut short."""
    t = derived(spark, sf_dir, "tri").select("tri_id", "ax", "ay", "bx", "by_", "cx", "cy")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                k = int(r.tri_id)
                o, flag = (">", 0) if k % 2 else ("<", 1)
                srid = struct.pack(o + "I", 4490) if k % 3 == 0 else b""
                points = struct.pack(o + "II8d", 1, 4, r.ax, r.ay, r.bx, r.by_, r.cx, r.cy, r.ax, r.ay)
                head = lambda kind, s: struct.pack(o + "BI", flag, kind | (tiles.SRID_FLAG if s else 0)) + s  # noqa: B023, E731
                raw = head(6, srid) + struct.pack(o + "I", 1) + head(3, b"") + points if k % 10 == 0 else head(3, srid) + points
                out.append((k, raw[:-3] if k % 31 == 0 else raw))
            yield pd.DataFrame(out, columns=["tri_id", "raw"])

    return t.mapInPandas(write, "tri_id long, raw binary").select("tri_id", F.base64("raw").alias("wkb"))


def scope_ring_scan(spark, sf_dir):
    return tiles.scope_rings(_wkb(spark, sf_dir), "tri_id").drop("polygon_id", "ring_id")


QUERIES = {f.__name__: f for f in (tile_catalog_scan, tile_chunk_list, mesh_scan, mesh_vertices, mesh_indices, scope_ring_scan)}

_LAYOUT = """layout AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 26 WHEN o_orderkey % 3 = 0 THEN 24 ELSE 20 END + 28 AS inner_offset, 12 + 4 * (o_orderkey % 5) AS js, 4 * (o_orderkey % 6) AS body, o_orderkey % 6 = 0 AS short,
    CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 2 ELSE 0 END AS padding FROM orders), sized AS (SELECT *, 12 + 8 + js + CASE WHEN short THEN 0 ELSE 8 + body END AS inner_length FROM layout)"""

ORACLE_SQL = {
    "tile_catalog_scan": f"""WITH {_LAYOUT} SELECT o_orderkey, CAST(inner_offset + inner_length + padding AS BIGINT) AS actual, CAST(inner_offset AS BIGINT) AS inner_offset, CAST(inner_length AS BIGINT) AS inner_length, CAST(padding AS BIGINT) AS padding,
        CASE WHEN o_orderkey % 23 = 0 THEN 'BAD_MAGIC' WHEN o_orderkey % 19 = 0 THEN 'BAD_LENGTH' WHEN o_orderkey % 11 = 0 THEN 'MISALIGNED' WHEN o_orderkey % 17 = 0 AND o_orderkey % 13 <> 0 THEN 'TRAILING_BYTES' WHEN inner_offset % 8 <> 0 THEN 'COMPATIBLE' ELSE 'OK' END AS code FROM sized""",
    "tile_chunk_list": f"""WITH {_LAYOUT} SELECT o_orderkey, 0 AS chunk, 'JSON' AS kind, CAST(inner_offset + 20 AS BIGINT) AS "offset", CAST(js AS BIGINT) AS length FROM sized
        UNION ALL SELECT o_orderkey, 1, 'BIN', CAST(inner_offset + 20 + js + 8 AS BIGINT), CAST(body AS BIGINT) FROM sized WHERE NOT short""",
    "mesh_scan": """SELECT vec_id, CAST(i AS BIGINT) AS vid, round(CAST(embedding[3 * i + 1] AS DOUBLE), 5) AS x, round(CAST(embedding[3 * i + 2] AS DOUBLE), 5) AS y, round(CAST(embedding[3 * i + 3] AS DOUBLE), 5) AS z, CAST(NULL AS VARCHAR) AS fault
        FROM (SELECT vec_id, embedding, unnest(range(20)) AS i FROM embeddings WHERE vec_id % 7 <> 0) e UNION ALL SELECT vec_id, NULL, NULL, NULL, NULL, 'RANGE' FROM embeddings WHERE vec_id % 7 = 0""",
    "mesh_vertices": f"""SELECT vec_id, CAST(i AS BIGINT) AS vid, {', '.join(f'round(CAST(embedding[8 * i + {k + 1}] AS DOUBLE), 5) + 0.0 AS {c}' for k, c in enumerate(('p0', 'p1', 'p2', 'n0', 'n1', 'n2', 'u0', 'u1')))}, CAST(NULL AS VARCHAR) AS fault
        FROM (SELECT *, unnest(range(CASE WHEN vec_id % 4 = 3 THEN 6 ELSE 8 END)) AS i FROM embeddings WHERE vec_id % 19 <> 4) e UNION ALL SELECT vec_id, {', '.join(['NULL'] * 9)}, 'COUNTS_DIFFER' FROM embeddings WHERE vec_id % 19 = 4""",
    "mesh_indices": """WITH f AS (SELECT vec_id, CASE WHEN vec_id % 19 = 4 THEN 'COUNTS_DIFFER' WHEN vec_id % 4 < 3 AND vec_id % 17 = 2 THEN 'INDEX_COUNT' WHEN vec_id % 4 < 3 AND vec_id % 13 = 5 THEN 'INDEX_RANGE' END AS fault FROM embeddings)
        SELECT vec_id, CAST(t AS BIGINT) AS tri_id, CASE WHEN vec_id % 4 = 3 THEN 3 * t ELSE 7 - 3 * t END AS i0, CASE WHEN vec_id % 4 = 3 THEN 3 * t + 1 ELSE 6 - 3 * t END AS i1, CASE WHEN vec_id % 4 = 3 THEN 3 * t + 2 ELSE 5 - 3 * t END AS i2, fault FROM (SELECT *, unnest(range(2)) AS t FROM f WHERE fault IS NULL) g
        UNION ALL SELECT vec_id, NULL, NULL, NULL, NULL, fault FROM f WHERE fault IS NOT NULL""",
    "scope_ring_scan": """SELECT tri_id, CAST(s AS INTEGER) AS seq, CASE s WHEN 1 THEN bx WHEN 2 THEN cx ELSE ax END AS lon, CASE s WHEN 1 THEN by_ WHEN 2 THEN cy ELSE ay END AS lat, CAST(CASE WHEN tri_id % 3 = 0 THEN 4490 END AS BIGINT) AS srid, CAST(NULL AS VARCHAR) AS fault
        FROM (SELECT *, unnest(range(4)) AS s FROM tri WHERE tri_id % 31 <> 0) t UNION ALL SELECT tri_id, NULL, NULL, NULL, NULL, 'WKB' FROM tri WHERE tri_id % 31 = 0""",
}
