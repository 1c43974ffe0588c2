"""Geometry, resource and task tables derived from the supplied tables, in SQL that Spark and other engines share.

All values are integers or dyadic fractions, so every engine derives the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

DERIVED = {
    # One triangle an order: corners a, b, c in local metres, height from the customer.
    "tri": """SELECT k AS tri_id, k % 200 AS asset_id, k % 3 AS prim, (k % 200) % 25 AS scope_id, ox AS ax, oy AS ay, ox + 20 + 10 * (k % 7) AS bx, oy + k % 3 AS by_, ox + k % 4 AS cx, oy + 20 + 10 * (k % 5) AS cy, CAST(c % 16 AS DOUBLE) AS h
        FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST((7919 * o_orderkey + 31 * o_custkey) % 1000 + CASE WHEN o_orderkey % 200 < 10 THEN 5000 ELSE 0 END AS DOUBLE) AS ox, CAST((6007 * o_orderkey + 17 * o_custkey) % 1000 AS DOUBLE) AS oy FROM orders) t""",
    "corner": """SELECT * FROM (SELECT 0 AS corner UNION ALL SELECT 1 UNION ALL SELECT 2) t""",
    # Vertices of the triangles; vid is dense within (asset, prim) only by construction of the key.
    "vertex": """SELECT asset_id, prim, 3 * tri_id + corner AS vid, CASE corner WHEN 0 THEN ax WHEN 1 THEN bx ELSE cx END AS x, CASE corner WHEN 0 THEN ay WHEN 1 THEN by_ ELSE cy END AS y, h + corner AS z FROM tri CROSS JOIN corner""",
    "triangle_index": """SELECT asset_id, prim, tri_id, 3 * tri_id AS i0, 3 * tri_id + 1 AS i1, 3 * tri_id + 2 AS i2 FROM tri""",
    # A square with a square hole a nation; every fifth outer ring has a notch.
    "ring_corner": """SELECT * FROM (SELECT 0 AS ring_id, 0 AS seq, 0 AS dx, 0 AS dy UNION ALL SELECT 0, 1, 400, 0 UNION ALL SELECT 0, 2, 400, 400 UNION ALL SELECT 0, 4, 0, 400 UNION ALL SELECT 0, 5, 0, 0
        UNION ALL SELECT 1, 0, 150, 150 UNION ALL SELECT 1, 1, 150, 250 UNION ALL SELECT 1, 2, 250, 250 UNION ALL SELECT 1, 3, 250, 150 UNION ALL SELECT 1, 4, 150, 150 UNION ALL SELECT 2, 3, 200, 300) t""",
    "scope_point": """SELECT CAST(n_nationkey AS BIGINT) AS scope_id, 0 AS polygon_id, CASE ring_id WHEN 2 THEN 0 ELSE ring_id END AS ring_id, seq, CAST(n_nationkey % 5 * 120 + dx AS DOUBLE) AS x, CAST(CAST(floor(n_nationkey / 5) AS BIGINT) * 120 + dy AS DOUBLE) AS y
        FROM nation CROSS JOIN ring_corner WHERE ring_id < 2 OR n_nationkey % 5 = 0""",
    # The same rings in degrees around (120, 30).
    "scope_geo": """SELECT scope_id, polygon_id, ring_id, seq, 120e0 + x / 65536e0 AS lon, 30e0 + y / 65536e0 AS lat, CASE WHEN scope_id % 7 = 6 THEN 4326 ELSE 4490 END AS srid FROM scope_point""",
    # Axis-aligned pieces for the plain clip: outer square less hole, as four rectangles.
    "rect": """SELECT * FROM (SELECT 0 AS piece_id, 0 AS x0, 0 AS y0, 400 AS x1, 150 AS y1 UNION ALL SELECT 1, 0, 150, 150, 250 UNION ALL SELECT 2, 250, 150, 400, 250 UNION ALL SELECT 3, 0, 250, 400, 400) t""",
    "piece": """SELECT CAST(n_nationkey AS BIGINT) AS scope_id, piece_id, CAST(n_nationkey % 5 * 120 + x0 AS DOUBLE) AS minx, CAST(CAST(floor(n_nationkey / 5) AS BIGINT) * 120 + y0 AS DOUBLE) AS miny, CAST(n_nationkey % 5 * 120 + x1 AS DOUBLE) AS maxx, CAST(CAST(floor(n_nationkey / 5) AS BIGINT) * 120 + y1 AS DOUBLE) AS maxy FROM nation CROSS JOIN rect""",
    "node": """SELECT p_partkey AS node_id, CASE WHEN p_partkey = 1 THEN NULL ELSE CAST(floor((p_partkey + 2) / 4) AS BIGINT) END AS parent_id, CASE WHEN p_partkey % 5 = 0 THEN p_partkey END AS mesh, p_size % 10 AS step FROM part""",
    # The same tree with double parents, self-parents, and rings of three nodes apart from it with a node hanging on each.
    "edge_fault": """SELECT node_id, parent_id FROM node WHERE parent_id IS NOT NULL UNION ALL SELECT node_id, node_id - 1 FROM node WHERE node_id % 97 = 2 AND node_id > 2 UNION ALL SELECT node_id, node_id FROM node WHERE node_id % 89 = 7
        UNION ALL SELECT -4 * node_id, -4 * node_id - 1 FROM node WHERE node_id % 83 = 5 UNION ALL SELECT -4 * node_id - 1, -4 * node_id - 2 FROM node WHERE node_id % 83 = 5 UNION ALL SELECT -4 * node_id - 2, -4 * node_id FROM node WHERE node_id % 83 = 5 UNION ALL SELECT -4 * node_id - 3, -4 * node_id FROM node WHERE node_id % 83 = 5""",
    "uv_use": """SELECT s_suppkey AS use_id, s_suppkey % 10 AS image, CAST(s_suppkey % 16 AS DOUBLE) / 8 - 0.5e0 AS u0, CAST(s_suppkey % 7 AS DOUBLE) / 8 AS v0, CAST(s_suppkey % 16 AS DOUBLE) / 8 + 0.25e0 AS u1, CAST(s_suppkey % 7 AS DOUBLE) / 8 + 0.125e0 AS v1, CAST(s_suppkey % 16 AS DOUBLE) / 8 AS u2, CAST(s_suppkey % 7 AS DOUBLE) / 8 + 0.5e0 AS v2, CASE WHEN s_suppkey % 3 = 0 THEN 33071 ELSE 10497 END AS wrap_s, CASE WHEN s_suppkey % 4 = 0 THEN 33071 ELSE 10497 END AS wrap_t FROM supplier""",
    "material": """SELECT p_partkey % 40 AS material, p_partkey AS prim_id, p_partkey % 200 AS asset_id, p_size % 2 AS survives FROM part""",
    "sampler": """SELECT s_suppkey AS sampler, CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 33071 WHEN 2 THEN 33648 ELSE 10497 END AS wrap_s, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 33071 ELSE 10497 END AS wrap_t, CASE s_suppkey % 7 WHEN 0 THEN 33648 WHEN 1 THEN 33071 WHEN 2 THEN 10497 WHEN 3 THEN -1 END AS wrap_r FROM supplier""",
    # Lifecycle events of the worker, from the user events.
    "task_event": """SELECT event_id, ts, user_id AS asset_id, user_id % 8 AS worker_id, CASE event_type WHEN 'signup' THEN 'claimed' WHEN 'view' THEN 'heartbeat' WHEN 'click' THEN 'download.completed' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS event,
        CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level, CAST(floor(value * 10) AS BIGINT) AS duration_ms, event_id % 5 AS fault, event_id % 1000 + 100 AS input_bytes, event_id % 700 AS output_bytes FROM events""",
    "object": """SELECT doc_id AS object_id, n_chars AS size, CASE doc_id % 4 WHEN 0 THEN 'W/"e' || CAST(doc_id % 50 AS STRING) || '"' WHEN 1 THEN '  "e' || CAST(doc_id % 50 AS STRING) || '" ' WHEN 2 THEN 'e' || CAST(doc_id % 50 AS STRING) ELSE 'w/"x' || CAST(doc_id % 50 AS STRING) || '"' END AS etag, '"e' || CAST(doc_id % 50 AS STRING) || '"' AS expected, text FROM documents""",
    "task": """SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN ' \t' ELSE 'asset-' || CAST(o_orderkey % 200 AS STRING) END AS asset, CASE o_orderkey % 9 WHEN 0 THEN 'X' WHEN 1 THEN 'z' WHEN 2 THEN 'Z' ELSE 'Y' END AS up_axis, CASE o_orderkey % 8 WHEN 0 THEN 'glb' WHEN 1 THEN 'obj' ELSE 'b3dm' END AS content_format,
        CASE WHEN o_orderkey % 13 = 0 THEN 4326 ELSE 4490 END AS srid, o_orderkey % 17 <> 0 AS mask_textures, o_orderkey % 19 <> 0 AS compact_metadata, o_orderkey % 23 = 0 AS cap_surface, CASE WHEN o_orderkey % 29 = 0 THEN 3 ELSE 16 END AS matrix_length, o_orderkey % 3000 * 40000 AS input_size, o_custkey, o_orderkey % 200 AS asset_id, CASE o_orderkey % 5 WHEN 0 THEN 'v7' ELSE 'v8' END AS algorithm_version FROM orders""",
    "line_count": """SELECT o_orderkey AS order_id, o_orderkey % 200 AS asset_id, o_orderkey % 8 AS declared, CAST(coalesce(actual, 0) AS BIGINT) AS actual FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS actual FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey""",
}


def needed(sql: str) -> list[str]:
    """Derived tables that the text names, in order of definition."""
    found: set[str] = set()

    def visit(text: str) -> None:
        for name in DERIVED:
            if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                found.add(name)
                visit(DERIVED[name])

    visit(sql)
    order, done = [], set()
    while len(order) < len(found):
        for name in DERIVED:
            if name in found and name not in done and all(n in done for n in found - {name} if re.search(rf"\b(FROM|JOIN)\s+{n}\b", DERIVED[name])):
                order.append(name)
                done.add(name)
    return order


def with_tables(sql: str) -> str:
    """The text with the derived tables it needs as common table expressions in front."""
    parts = ", ".join(f"{n} AS ({DERIVED[n]})" for n in needed(sql))
    if not parts:
        return sql
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {parts}, {body[len('WITH'):]}"
    return f"WITH {parts} {body}"


#: So many rows of the largest table dealt by a key (`run_sql`) go to a task on average.
PART_ROWS = 500_000


def register(spark: SparkSession, sf_dir: str, sql: str, dealt: dict[str, str] | None = None) -> None:
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in BASE_TABLES if re.search(rf"\b{name}\b", sql)}
    if dealt:
        rows = max(tables[name].count() for name in dealt)
        parts = max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))
        tables |= {name: tables[name].repartition(parts, key) for name, key in dealt.items()}
    for name, table in tables.items():
        table.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sf_dir: str, sql: str, dealt: dict[str, str] | None = None) -> DataFrame:
    """The text over the supplied and derived tables.

    ``dealt`` names supplied tables and the key by which each is dealt to tasks, in as many parts as its rows ask for:
    joins, windows and groups by that key then sort within these, so a task's memory does not grow with the tables.
    """
    text = with_tables(sql)
    register(spark, sf_dir, text, dealt)
    return spark.sql(text)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")
