"""Queries whose plan is one SQL statement that Spark and any other engine read alike.

Rules name the first broken rule of a row as its code; joins, rollups and rankings are plain SQL over the derived
tables. Spark plans them like any DataFrame (`sources.derived.run_sql`).
"""

SHARED = {
    # Scans and sinks over tables.
    "failure_report": """SELECT event_id, asset_id, CASE fault WHEN 0 THEN 'SOURCE_FORMAT_INVALID' WHEN 1 THEN 'TRANSFER_FAILED' WHEN 2 THEN 'CONTROL_PLANE_FAILED' WHEN 3 THEN 'SCOPE_INVALID' ELSE 'PROCESSING_FAILED' END AS error_code, fault IN (1, 2) AS retryable, CASE WHEN trim(CASE WHEN fault = 4 THEN ' ' ELSE 'fault ' || CAST(fault AS STRING) END) = '' THEN 'processing failed' ELSE 'fault ' || CAST(fault AS STRING) END AS message FROM task_event WHERE event = 'failed'""",
    # Rules: the first broken one is the row's code.
    "rule_not_blank": """SELECT task_id, CASE WHEN asset IS NULL THEN 'MISSING' WHEN trim(replace(replace(replace(asset, chr(9), ''), chr(10), ''), chr(13), '')) = '' THEN 'BLANK' ELSE 'OK' END AS code FROM task""",
    "rule_enum_domain": """SELECT task_id, CASE WHEN up_axis IN ('Y', 'Z') THEN 'OK' WHEN up_axis = 'X' THEN 'DISABLED' ELSE 'UNKNOWN' END AS axis, CASE WHEN content_format = 'b3dm' THEN 'OK' WHEN content_format IN ('glb', 'gltf') THEN 'DISABLED' ELSE 'UNKNOWN' END AS format FROM task""",
    "rule_size_cap": """SELECT task_id, input_size FROM task WHERE input_size BETWEEN 1 AND 67108864""",
    "rule_srid": """SELECT DISTINCT scope_id, srid FROM scope_geo WHERE srid = 4490""",
    "rule_clip_options": """SELECT task_id FROM task WHERE mask_textures AND compact_metadata AND NOT cap_surface""",
    "rule_ring_valid": """SELECT scope_id, polygon_id, ring_id, n, CASE WHEN bad > 0 THEN 'NOT_FINITE' WHEN n < 4 THEN 'TOO_FEW_POINTS' WHEN fx <> lx OR fy <> ly THEN 'NOT_CLOSED' ELSE 'OK' END AS code
        FROM (SELECT scope_id, polygon_id, ring_id, count(*) AS n, count(*) FILTER (WHERE lon IS NULL OR lat IS NULL) AS bad, min_by(lon, seq) AS fx, max_by(lon, seq) AS lx, min_by(lat, seq) AS fy, max_by(lat, seq) AS ly FROM (SELECT * FROM scope_geo WHERE NOT (scope_id % 6 = 1 AND ring_id = 1 AND seq = 4) AND NOT (scope_id % 9 = 2 AND ring_id = 1 AND seq > 2)) r GROUP BY scope_id, polygon_id, ring_id) x""",
    "layout_class": """SELECT task_id, CASE WHEN input_size % 16 = 0 THEN 'STANDARD' WHEN (input_size + o_custkey) % 8 = 0 THEN 'STANDARD' WHEN (input_size + o_custkey) % 4 = 0 THEN 'COMPATIBLE' ELSE 'REJECT' END AS layout FROM task""",
    "rule_section_bounds": """SELECT order_id, max(ends) AS used, CASE WHEN max(ends) <= max(total) THEN 'OK' ELSE 'SECTION_OUT_OF_BOUNDS' END AS code FROM (SELECT l_orderkey AS order_id, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ends, CAST(floor(o_totalprice / 1000) AS BIGINT) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey) s GROUP BY order_id""",
    "rule_index_bounds": """SELECT i.asset_id, i.prim, count(*) AS n_index, count(*) % 3 AS remainder, count(*) FILTER (WHERE v.vid IS NULL) AS dangling FROM (SELECT asset_id, prim, i0 AS vid FROM triangle_index UNION ALL SELECT asset_id, prim, i1 FROM triangle_index UNION ALL SELECT asset_id, prim, i2 + CASE WHEN tri_id % 37 = 0 THEN 1 ELSE 0 END FROM triangle_index) i LEFT JOIN vertex v ON i.asset_id = v.asset_id AND i.prim = v.prim AND i.vid = v.vid GROUP BY i.asset_id, i.prim""",
    "rule_attribute_counts": """SELECT asset_id, prim, count(*) AS n_position, count(*) FILTER (WHERE vid % 41 <> 0) AS n_uv, count(*) = count(*) FILTER (WHERE vid % 41 <> 0) AS equal_counts FROM vertex GROUP BY asset_id, prim""",
    "rule_batch_zero": """SELECT asset_id, prim, CAST(max(CASE WHEN vid % 1201 = 7 THEN 1 ELSE 0 END) AS BIGINT) AS max_batch, max(CASE WHEN vid % 1201 = 7 THEN 1 ELSE 0 END) = 0 AS accepted FROM vertex GROUP BY asset_id, prim""",
    "sampler_normalize": """SELECT sampler, coalesce(wrap_s, 10497) AS wrap_s, coalesce(wrap_t, 10497) AS wrap_t, CASE WHEN wrap_s = 33648 OR wrap_t = 33648 THEN 'MIRRORED' WHEN wrap_r IS NOT NULL AND wrap_r NOT IN (33071, 33648, 10497) THEN 'BAD_THIRD_AXIS' ELSE 'OK' END AS code FROM sampler""",
    "error_taxonomy": """SELECT e.event_id, t.type, t.code, t.retryable FROM task_event e JOIN (SELECT 0 AS fault, 'format' AS type, 'SOURCE_FORMAT_INVALID' AS code, false AS retryable UNION ALL SELECT 1, 'transfer', 'TRANSFER_FAILED', true UNION ALL SELECT 2, 'control', 'CONTROL_PLANE_FAILED', true UNION ALL SELECT 3, 'scope', 'SCOPE_INVALID', false UNION ALL SELECT 4, 'processing', 'PROCESSING_FAILED', false) t ON e.fault = t.fault WHERE e.event = 'failed'""",
    "event_redact": """SELECT event_id, ts, level, event, asset_id, worker_id, duration_ms FROM task_event""",
    # Joins.
    "triangle_gather": """SELECT i.asset_id, i.prim, i.tri_id, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM triangle_index i JOIN vertex a ON a.asset_id = i.asset_id AND a.prim = i.prim AND a.vid = i.i0 JOIN vertex b ON b.asset_id = i.asset_id AND b.prim = i.prim AND b.vid = i.i1 JOIN vertex c ON c.asset_id = i.asset_id AND c.prim = i.prim AND c.vid = i.i2""",
    "mesh_placement": """SELECT mesh, count(*) AS placements, min(node_id) AS first_node FROM (SELECT node_id, CASE WHEN node_id % 30 = 0 THEN node_id - 5 ELSE mesh END AS mesh FROM node) n WHERE mesh IS NOT NULL GROUP BY mesh HAVING count(*) > 1""",
    "resource_chain": """SELECT m.prim_id, m.material, t.texture, i.image, s.sampler, CASE WHEN t.texture IS NULL THEN 'NO_TEXTURE' WHEN i.image IS NULL THEN 'DANGLING_IMAGE' WHEN s.sampler IS NULL THEN 'DANGLING_SAMPLER' ELSE 'OK' END AS code FROM material m LEFT JOIN (SELECT DISTINCT material % 20 AS texture FROM material WHERE material % 20 <> 13) t ON t.texture = m.material % 20 LEFT JOIN (SELECT DISTINCT s_suppkey % 10 AS image FROM supplier WHERE s_suppkey % 10 <> 7) i ON i.image = t.texture % 10 LEFT JOIN (SELECT DISTINCT s_suppkey % 4 AS sampler FROM supplier WHERE s_suppkey % 4 <> 3) s ON s.sampler = t.texture % 4""",
    "used_resources": """SELECT material, CAST(material % 20 AS BIGINT) AS texture, CAST(material % 20 % 10 AS BIGINT) AS image FROM (SELECT DISTINCT material FROM material) m WHERE EXISTS (SELECT 1 FROM material p WHERE p.material = m.material AND p.survives = 1)""",
    "count_reconcile": """SELECT order_id, declared, actual FROM line_count WHERE declared <> actual""",
    # Aggregates.
    "scope_center": """SELECT scope_id, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM (SELECT g.*, max(seq) OVER (PARTITION BY scope_id, polygon_id, ring_id) AS last FROM scope_geo g) x WHERE ring_id = 0 AND seq < last GROUP BY scope_id""",
    "bounds_rollup": """SELECT scope_id, min(least(ax, bx, cx)) AS minx, min(least(ay, by_, cy)) AS miny, max(greatest(ax, bx, cx)) AS maxx, max(greatest(ay, by_, cy)) AS maxy, count(*) AS n FROM tri GROUP BY scope_id""",
    "position_extent": """SELECT asset_id, prim, CAST(min(CAST(x AS FLOAT)) AS DOUBLE) AS min_x, CAST(max(CAST(x AS FLOAT)) AS DOUBLE) AS max_x, CAST(min(CAST(y AS FLOAT)) AS DOUBLE) AS min_y, CAST(max(CAST(y AS FLOAT)) AS DOUBLE) AS max_y, CAST(min(CAST(z AS FLOAT)) AS DOUBLE) AS min_z, CAST(max(CAST(z AS FLOAT)) AS DOUBLE) AS max_z FROM vertex GROUP BY asset_id, prim""",
    "count_diagnostics": """SELECT asset_id, count(*) FILTER (WHERE declared <> actual) AS affected, CAST(coalesce(sum(CASE WHEN declared <> actual THEN declared END), 0) AS BIGINT) AS declared_total, max(CASE WHEN declared <> actual THEN declared END) AS max_declared, max(CASE WHEN declared <> actual THEN actual END) AS max_actual FROM line_count GROUP BY asset_id""",
    "object_digest": """SELECT digest, count(*) AS copies, min(object_id) AS first_object FROM (SELECT object_id, DIGEST(text) AS digest FROM object) o GROUP BY digest HAVING count(*) > 1""",
    "failure_breakdown": """SELECT fault AS stage, level, fault IN (1, 2) AS retryable, count(*) AS n FROM task_event WHERE event = 'failed' GROUP BY fault, level, fault IN (1, 2)""",
    "throughput_minute": """SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM task_event WHERE event = 'succeeded' GROUP BY date_trunc('minute', ts)""",
    "size_reduction": """SELECT event, CAST(sum(input_bytes) AS BIGINT) AS bytes_in, CAST(sum(output_bytes) AS BIGINT) AS bytes_out, round(CAST(sum(output_bytes) AS DOUBLE) / CAST(sum(input_bytes) AS DOUBLE), 6) AS ratio FROM task_event WHERE event IN ('succeeded', 'failed') GROUP BY event""",
    # Windows.
    "index_triples": """SELECT asset_id, prim, tri_no, max(CASE WHEN pos % 3 = 0 THEN vid END) AS i0, max(CASE WHEN pos % 3 = 1 THEN vid END) AS i1, max(CASE WHEN pos % 3 = 2 THEN vid END) AS i2 FROM (SELECT asset_id, prim, vid, pos, CAST(floor(pos / 3) AS BIGINT) AS tri_no FROM (SELECT asset_id, prim, vid, row_number() OVER (PARTITION BY asset_id, prim ORDER BY vid) - 1 AS pos FROM vertex) v) w GROUP BY asset_id, prim, tri_no""",
    "dense_reindex": """SELECT asset_id, prim_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY prim_id) - 1 AS BIGINT) AS new_index FROM material WHERE survives = 1""",
    "terminal_event": """SELECT asset_id, event_id, event, n_terminal > 1 AS repeated FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY asset_id) AS n_terminal FROM task_event WHERE event IN ('succeeded', 'failed')) x WHERE rn = 1""",
    "slowest_assets": """SELECT asset_id, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM task_event GROUP BY asset_id ORDER BY total_ms DESC, asset_id LIMIT 20""",
    # Sets.
    "accounting_closed": """SELECT count(*) AS tasks, count(*) FILTER (WHERE n <> 1) AS wrong FROM (SELECT t.task_id, count(o.task_id) AS n FROM task t LEFT JOIN (SELECT task_id FROM task WHERE srid = 4490 UNION ALL SELECT task_id FROM task WHERE srid <> 4490 OR srid IS NULL) o ON t.task_id = o.task_id GROUP BY t.task_id) x""",
    # Scalar functions over whole tables.
    "lon_delta": """SELECT c_custkey, CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END AS delta FROM (SELECT c_custkey, CAST(c_custkey * 7919 % 360 - 180 - (c_custkey * 31 % 360 - 180) AS DOUBLE) AS d FROM customer) t""",
    "segment_metres": """SELECT scope_id, polygon_id, ring_id, seq, round(sqrt(power((lon2 - lon) * cos(radians((lat + lat2) / 2)) * 111319.49079327358e0, 2) + power((lat2 - lat) * 111319.49079327358e0, 2)), 6) AS metres FROM (SELECT g.*, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM scope_geo g WINDOW w AS (PARTITION BY scope_id, polygon_id, ring_id ORDER BY seq)) s WHERE lon2 IS NOT NULL""",
    "ccw_orient": """SELECT tri_id, d < 0 AS swapped, CASE WHEN d < 0 THEN cx ELSE bx END AS bx, CASE WHEN d < 0 THEN cy ELSE by_ END AS by_, CASE WHEN d < 0 THEN bx ELSE cx END AS cx, CASE WHEN d < 0 THEN by_ ELSE cy END AS cy FROM (SELECT *, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS d FROM tri) t""",
    "signed_distance": """SELECT tri_id, round(((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 6) AS distance FROM tri""",
    "etag_normalize": """SELECT object_id, regexp_replace(regexp_replace(trim(etag), '^W/', ''), '^"(.*)"$', 'CAPTURE') AS etag FROM object""",
    "etag_mismatch": """SELECT object_id FROM (SELECT object_id, regexp_replace(regexp_replace(trim(etag), '^W/', ''), '^"(.*)"$', 'CAPTURE') AS e, regexp_replace(trim(expected), '^"(.*)"$', 'CAPTURE') AS x FROM object) o WHERE e <> x""",
    "ring_segments": """SELECT scope_id, polygon_id, ring_id, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS next_x, coalesce(lead(y) OVER w, first_value(y) OVER w) AS next_y FROM (SELECT p.*, max(seq) OVER (PARTITION BY scope_id, polygon_id, ring_id) AS last FROM scope_point p) q WHERE seq < last WINDOW w AS (PARTITION BY scope_id, polygon_id, ring_id ORDER BY seq)""",
}

#: Supplied tables that a query deals to tasks by a key beforehand (`sources.derived.run_sql`): it sorts them more than once.
DEALT = {"rule_section_bounds": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}

#: Where function names differ: (Spark, DuckDB).
DIALECT = {"DIGEST(text)": ("sha2(text, 256)", "sha256(text)"), "'CAPTURE'": ("'$1'", r"'\1'")}


def spark_text(sql: str) -> str:
    for k, (spark, _) in DIALECT.items():
        sql = sql.replace(k, spark)
    return sql


def duckdb_text(sql: str) -> str:
    for k, (_, duck) in DIALECT.items():
        sql = sql.replace(k, duck)
    return sql
