"""Queries composed of the DataFrame operators, and the same results in SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions.storage import stored
from tilewright.operators import diagnostics, geometry, graph, matrices, meshes, polygons, projection, quantiles, raster, resources, spatial
from tilewright.sources.derived import derived, run_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- Clipping -----------------------------------------------------------------------------------------------------

_PIECES = "SELECT scope_id, piece_id, minx, miny, maxx, maxy FROM piece"
_SOURCE = """pairs AS (SELECT t.asset_id, t.tri_id, p.piece_id, p.minx AS x0, p.miny AS y0, p.maxx AS x1, p.maxy AS y1,
    CASE WHEN (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) < 0 THEN [{'x': ax, 'y': ay, 'z': h}, {'x': cx, 'y': cy, 'z': h + 2}, {'x': bx, 'y': by_, 'z': h + 1}] ELSE [{'x': ax, 'y': ay, 'z': h}, {'x': bx, 'y': by_, 'z': h + 1}, {'x': cx, 'y': cy, 'z': h + 2}] END AS p
    FROM tri t JOIN piece p ON t.scope_id = p.scope_id AND least(ax, bx, cx) <= maxx + 0.01 AND greatest(ax, bx, cx) >= minx - 0.01 AND least(ay, by_, cy) <= maxy + 0.01 AND greatest(ay, by_, cy) >= miny - 0.01)"""


_SIDES = [lambda v: f"(1 * ({v}.y - y0))", lambda v: f"(-1 * ({v}.x - x1))", lambda v: f"(-1 * ({v}.y - y1))", lambda v: f"(1 * ({v}.x - x0))"]


def _oracle_steps(source: str = _SOURCE, sides=_SIDES, fields=tuple("xyz")) -> str:
    """Half-plane by half-plane over lists, for four sides (distances of a corner, positive inside), of a rectangle unless given; ``fields`` are a corner's."""
    out, before = [source], "pairs"
    for k, d in enumerate(sides):
        q, c = "p[CASE WHEN i = 1 THEN len(p) ELSE i - 1 END]", "p[i]"
        t = f"greatest(0.0, least(1.0, {d(q)} / ({d(q)} - {d(c)})))"
        cut = "{" + ", ".join(f"'{a}': {q}.{a} + ({c}.{a} - {q}.{a}) * {t}" for a in fields) + "}"
        out.append(f"s{k} AS (SELECT * EXCLUDE (p), CASE WHEN len(p) < 3 THEN list_filter(p, lambda v: false) ELSE flatten(list_transform(range(1, len(p) + 1), lambda i: list_concat(CASE WHEN ({d(c)} >= -0.01) <> ({d(q)} >= -0.01) THEN [{cut}] ELSE list_filter([{c}], lambda v: false) END, list_filter([{c}], lambda v: {d('v')} >= -0.01)))) END AS p FROM {before})")
        before = f"s{k}"
    u = [f"(b.{a} - a.{a})" for a in "xyz"]
    v = [f"(c.{a} - a.{a})" for a in "xyz"]
    parts = [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]
    out.append(f"frags AS (SELECT *, 0.5 * sqrt({' + '.join(f'{x} * {x}' for x in parts)}) AS area FROM (SELECT asset_id, tri_id, piece_id, len(p) AS corners, i - 2 AS frag_id, p[1] AS a, p[i] AS b, p[i + 1] AS c FROM (SELECT *, unnest(range(2, len(p))) AS i FROM s3 WHERE len(p) >= 3) f) g)")
    return "WITH " + ", ".join(out) + " "


_CLIP = _oracle_steps()


def _tri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.with_polygon(derived(spark, sf_dir, "tri"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.grown(derived(spark, sf_dir, "piece").withColumn("corners", geometry.rectangle()))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.box_overlap_join(_tri(spark, sf_dir), _pieces(spark, sf_dir), "scope_id")


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.fragments(_pairs(spark, sf_dir))


@query("SELECT t.tri_id, p.piece_id FROM tri t JOIN piece p ON t.scope_id = p.scope_id AND least(ax, bx, cx) <= maxx + 0.01 AND greatest(ax, bx, cx) >= minx - 0.01 AND least(ay, by_, cy) <= maxy + 0.01 AND greatest(ay, by_, cy) >= miny - 0.01")
def box_overlap_join(spark, sf_dir):
    return _pairs(spark, sf_dir).select("tri_id", "piece_id")


@query("SELECT DISTINCT t.tri_id FROM tri t JOIN piece p ON t.scope_id = p.scope_id AND least(ax, bx, cx) <= maxx + 0.01 AND greatest(ax, bx, cx) >= minx - 0.01 AND least(ay, by_, cy) <= maxy + 0.01 AND greatest(ay, by_, cy) >= miny - 0.01")
def triangle_prefilter(spark, sf_dir):
    return _tri(spark, sf_dir).join(_pairs(spark, sf_dir).select("tri_id"), "tri_id", "left_semi").select("tri_id")


@query("SELECT scope_id, piece_id, round(minx - 0.01 - abs(minx) * 1e-12, 6) AS minx, round(miny - 0.01 - abs(miny) * 1e-12, 6) AS miny, round(maxx + 0.01 + abs(maxx) * 1e-12, 6) AS maxx, round(maxy + 0.01 + abs(maxy) * 1e-12, 6) AS maxy FROM piece")
def piece_bounds_grown(spark, sf_dir):
    return _pieces(spark, sf_dir).select("scope_id", "piece_id", *[F.round(c, 6).alias(c) for c in spatial.BOX])


@query(_CLIP + "SELECT tri_id, piece_id, CAST(len(p) AS INTEGER) AS corners, round(list_sum(list_transform(p, lambda v: v.x)), 4) AS sum_x, round(list_sum(list_transform(p, lambda v: v.y)), 4) AS sum_y, round(list_sum(list_transform(p, lambda v: v.z)), 4) AS sum_z FROM s3 WHERE len(p) >= 3")
def clip_polygon(spark, sf_dir):
    cut = geometry.within(_pairs(spark, sf_dir))
    total = lambda a: F.round(F.expr(f"aggregate(cut, 0D, (s, v) -> s + v.{a})"), 4)
    return cut.select("tri_id", "piece_id", F.size("cut").alias("corners"), total("x").alias("sum_x"), total("y").alias("sum_y"), total("z").alias("sum_z"))


@query(_CLIP + "SELECT tri_id, piece_id, count(*) AS fragments FROM frags GROUP BY tri_id, piece_id")
def fan_split(spark, sf_dir):
    cut = geometry.within(_pairs(spark, sf_dir))
    return cut.select("tri_id", "piece_id", F.explode(geometry.fan("cut")).alias("frag")).groupBy("tri_id", "piece_id").agg(F.count("*").alias("fragments"))


@query(_CLIP + "SELECT tri_id, piece_id, CAST(frag_id AS INTEGER) AS frag_id, round(area, 4) AS area FROM frags WHERE area > 1e-8")
def area_filter(spark, sf_dir):
    return _fragments(spark, sf_dir).select("tri_id", "piece_id", "frag_id", F.round("area", 4).alias("area"))


@query(_CLIP + "SELECT asset_id, tri_id, piece_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY tri_id, piece_id, frag_id) AS INTEGER) AS place FROM frags WHERE area > 1e-8")
def fragment_order(spark, sf_dir):
    w = Window.partitionBy("asset_id").orderBy("tri_id", "piece_id", "frag_id")
    return _fragments(spark, sf_dir).select("asset_id", "tri_id", "piece_id", F.row_number().over(w).alias("place"))


@query(_CLIP + "SELECT tri_id, count(*) AS fragments, round(sum(area), 3) AS area FROM frags WHERE area > 1e-8 GROUP BY tri_id")
def clip_exhaustive(spark, sf_dir):
    pairs = spatial.exhaustive_pairs(_tri(spark, sf_dir), _pieces(spark, sf_dir), "scope_id")
    return geometry.fragments(pairs).groupBy("tri_id").agg(F.count("*").alias("fragments"), F.round(F.sum("area"), 3).alias("area"))


_STATS = _CLIP + """, f AS (SELECT asset_id, count(*) AS n, sum(area) AS area FROM frags WHERE area > 1e-8 GROUP BY asset_id) SELECT b.asset_id, b.vertices_before, b.triangles_before, CAST(3 * coalesce(n, 0) AS BIGINT) AS vertices_after, CAST(coalesce(n, 0) AS BIGINT) AS triangles_after, @AREA@ FROM (SELECT asset_id, CAST(3 * count(*) AS BIGINT) AS vertices_before, count(*) AS triangles_before FROM tri GROUP BY asset_id) b LEFT JOIN f ON b.asset_id = f.asset_id"""


def _statistics(spark, sf_dir):
    before = derived(spark, sf_dir, "tri").groupBy("asset_id").agg((3 * F.count("*")).alias("vertices_before"), F.count("*").alias("triangles_before"))
    after = _fragments(spark, sf_dir).groupBy("asset_id").agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    n = F.coalesce("n", F.lit(0))
    return before.join(after, "asset_id", "left").select("asset_id", "vertices_before", "triangles_before", (3 * n).alias("vertices_after"), n.alias("triangles_after"), "area")


@query(_STATS.replace("@AREA@", "round(coalesce(area, 0), 2) AS area"))
def clip_statistics(spark, sf_dir):
    return _statistics(spark, sf_dir).withColumn("area", F.round(F.coalesce("area", F.lit(0.0)), 2))


@query("SELECT asset_id, result, triangles_after FROM (" + _STATS.replace("@AREA@", "CASE WHEN coalesce(n, 0) = 0 THEN 'EMPTY' ELSE 'READY' END AS result") + ") x")
def clip_outcome(spark, sf_dir):
    """READY or EMPTY for every asset, also for those without any fragment."""
    s = _statistics(spark, sf_dir)
    return s.select("asset_id", F.when(F.col("triangles_after") == 0, "EMPTY").otherwise("READY").alias("result"), "triangles_after")


@query("SELECT asset_id, result, CASE WHEN triangles_after > 0 THEN triangles_after END AS output_rows FROM (" + _STATS.replace("@AREA@", "CASE WHEN coalesce(n, 0) = 0 THEN 'EMPTY' ELSE 'READY' END AS result") + ") x")
def completion_report(spark, sf_dir):
    """The outcome of the clip with its number of fragments; EMPTY carries none."""
    return clip_outcome(spark, sf_dir).select("asset_id", "result", F.when(F.col("triangles_after") > 0, F.col("triangles_after")).alias("output_rows"))


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra")
def indexed_equals_exhaustive(spark, sf_dir):
    """Rows that only one of grid join and exhaustive pairing gives; both counts must be 0."""
    keys = ["tri_id", "piece_id", "frag_id"]
    a = _fragments(spark, sf_dir).select(*keys).withColumn("s", F.lit(1))
    b = geometry.fragments(spatial.exhaustive_pairs(_tri(spark, sf_dir), _pieces(spark, sf_dir), "scope_id")).select(*keys).withColumn("s", F.lit(-1))
    d = a.unionByName(b).groupBy(*keys).agg(F.sum("s").alias("s"))
    return d.agg(F.coalesce(F.sum(F.when(F.col("s") < 0, -F.col("s"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col("s") > 0, F.col("s"))), F.lit(0)).alias("extra"))


@query("SELECT asset_id, count(*) AS n, true AS same FROM (" + _CLIP + "SELECT * FROM frags WHERE area > 1e-8) x GROUP BY asset_id")
def rerun_diff(spark, sf_dir):
    """Two runs' fragments per asset, compared by an order-free hash."""
    def run():
        f = _fragments(spark, sf_dir)
        return f.groupBy("asset_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("tri_id", "piece_id", "frag_id", "area")).alias("hash"))

    a, b = run(), run().withColumnsRenamed({"n": "n2", "hash": "hash2"})
    return a.join(b, "asset_id", "full").select("asset_id", "n", ((F.col("n") == F.col("n2")) & (F.col("hash") == F.col("hash2"))).alias("same"))


@query("SELECT tri_id, round(ax + (bx - ax) * 0.25, 6) AS x, round(ay + (by_ - ay) * 0.25, 6) AS y, round(h + 0.25, 6) AS z FROM tri")
def lerp_vertex(spark, sf_dir):
    t = derived(spark, sf_dir, "tri").select("tri_id", F.array("ax", "ay", "h").alias("a"), F.array(F.col("bx"), F.col("by_"), F.col("h") + 1).alias("b"))
    v = F.zip_with("a", "b", lambda p, q: p + (q - p) * 0.25)
    return t.select("tri_id", *[F.round(v[i], 6).alias(n) for i, n in enumerate("xyz")])


# --- Polygons -----------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT g.*, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM scope_geo g WINDOW w AS (PARTITION BY scope_id, polygon_id, ring_id ORDER BY seq)),
n AS (SELECT *, greatest(1, CAST(ceil(sqrt(power((lon2 - lon) * cos(radians((lat + lat2) / 2)) * 111319.49079327358, 2) + power((lat2 - lat) * 111319.49079327358, 2)) / 10) AS BIGINT)) AS n FROM s WHERE lon2 IS NOT NULL)
SELECT scope_id, polygon_id, ring_id, seq, i, round(lon + (lon2 - lon) * (CAST(i AS DOUBLE) / n), 9) AS lon, round(lat + (lat2 - lat) * (CAST(i AS DOUBLE) / n), 9) AS lat FROM (SELECT *, unnest(range(0, n)) AS i FROM n) x""")
def ring_densify(spark, sf_dir):
    d = polygons.ring_densify(derived(spark, sf_dir, "scope_geo"))
    return d.withColumn("lon", F.round("lon", 9)).withColumn("lat", F.round("lat", 9))


@query("""WITH o AS (SELECT p.*, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM scope_point p WINDOW w AS (PARTITION BY scope_id, ring_id ORDER BY seq)),
seg AS (SELECT scope_id, ring_id, seq, least(y, ny) AS ya, greatest(y, ny) AS yb, CASE WHEN y < ny THEN x ELSE nx END AS xa, CASE WHEN y < ny THEN nx ELSE x END AS xb FROM o WHERE nx IS NOT NULL AND y <> ny),
slab AS (SELECT scope_id, y AS y0, lead(y) OVER (PARTITION BY scope_id ORDER BY y) AS y1, row_number() OVER (PARTITION BY scope_id ORDER BY y) - 1 AS slab FROM (SELECT DISTINCT scope_id, y FROM scope_point) d),
hit AS (SELECT s.scope_id, slab, y0, y1, xa + (xb - xa) * (y0 - ya) / (yb - ya) AS xl, xa + (xb - xa) * (y1 - ya) / (yb - ya) AS xh, ring_id, seq FROM seg s JOIN slab b ON s.scope_id = b.scope_id AND ya <= y0 AND y1 <= yb WHERE y1 IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY scope_id, slab ORDER BY xl + xh, ring_id, seq) - 1 AS rn FROM hit)
SELECT scope_id, CAST(slab AS INTEGER) AS slab, CAST(floor(rn / 2) AS BIGINT) AS pair, y0, y1, round(max(CASE WHEN rn % 2 = 0 THEN xl END), 6) AS left_low, round(max(CASE WHEN rn % 2 = 1 THEN xl END), 6) AS right_low, round(max(CASE WHEN rn % 2 = 0 THEN xh END), 6) AS left_high, round(max(CASE WHEN rn % 2 = 1 THEN xh END), 6) AS right_high
FROM r GROUP BY scope_id, slab, floor(rn / 2), y0, y1 HAVING max(CASE WHEN rn % 2 = 1 THEN xl END) > max(CASE WHEN rn % 2 = 0 THEN xl END) OR max(CASE WHEN rn % 2 = 1 THEN xh END) > max(CASE WHEN rn % 2 = 0 THEN xh END)""")
def scope_decompose(spark, sf_dir):
    d = polygons.scope_decompose(derived(spark, sf_dir, "scope_point"))
    return d.select("scope_id", "slab", "pair", "y0", "y1", *[F.round(c, 6).alias(c) for c in ("left_low", "right_low", "left_high", "right_high")])


_TWISTED = "SELECT scope_id, polygon_id, ring_id, CASE WHEN scope_id % 6 = 2 AND ring_id = 0 AND seq IN (1, 2) THEN 3 - seq ELSE seq END AS seq, x, y FROM scope_point"


@query(f"""WITH t AS ({_TWISTED}), s AS (SELECT * FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM t WINDOW w AS (PARTITION BY scope_id, polygon_id, ring_id ORDER BY seq)) l WHERE nx IS NOT NULL)
SELECT a.scope_id, a.polygon_id, a.ring_id, a.seq, b.ring_id AS ring_id2, b.seq AS seq2, 'RINGS_CROSS' AS code FROM s a JOIN s b ON a.scope_id = b.scope_id AND a.polygon_id = b.polygon_id AND (a.ring_id < b.ring_id OR (a.ring_id = b.ring_id AND a.seq < b.seq))
WHERE sign((a.nx - a.x) * (b.y - a.y) - (a.ny - a.y) * (b.x - a.x)) * sign((a.nx - a.x) * (b.ny - a.y) - (a.ny - a.y) * (b.nx - a.x)) < 0 AND sign((b.nx - b.x) * (a.y - b.y) - (b.ny - b.y) * (a.x - b.x)) * sign((b.nx - b.x) * (a.ny - b.y) - (b.ny - b.y) * (a.nx - b.x)) < 0""")
def ring_crossings(spark, sf_dir):
    """Pairs of segments that cross, in scopes of which every sixth has a twisted outer ring."""
    return polygons.ring_crossings(run_sql(spark, sf_dir, _TWISTED))


_SCOPE_SIDES = [
    lambda v: f"(CASE WHEN rl = ll THEN 1.0::double ELSE {v}.y - y0 END)",
    lambda v: f"(((rh - rl) * ({v}.y - y0) - (y1 - y0) * ({v}.x - rl)) / sqrt(power(rh - rl, 2) + power(y1 - y0, 2)))",
    lambda v: f"(CASE WHEN rh = lh THEN 1.0::double ELSE y1 - {v}.y END)",
    lambda v: f"(((ll - lh) * ({v}.y - y1) - (y0 - y1) * ({v}.x - lh)) / sqrt(power(ll - lh, 2) + power(y0 - y1, 2)))",
]
_SCOPE_CLIP = _oracle_steps("cut AS (" + ORACLE_SQL["scope_decompose"].replace("6)", "12)") + """),
pairs AS (SELECT t.asset_id, t.tri_id, slab * 1000 + pair AS piece_id, y0, y1, left_low AS ll, right_low AS rl, left_high AS lh, right_high AS rh,
    CASE WHEN (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) < 0 THEN [{'x': ax, 'y': ay, 'z': h}, {'x': cx, 'y': cy, 'z': h + 2}, {'x': bx, 'y': by_, 'z': h + 1}] ELSE [{'x': ax, 'y': ay, 'z': h}, {'x': bx, 'y': by_, 'z': h + 1}, {'x': cx, 'y': cy, 'z': h + 2}] END AS p
    FROM tri t JOIN cut c ON t.scope_id = c.scope_id)""", _SCOPE_SIDES)


@query(_SCOPE_CLIP + "SELECT asset_id, count(*) AS fragments, round(sum(area), 2) AS area FROM frags WHERE area > 1e-8 GROUP BY asset_id")
def scope_clip(spark, sf_dir):
    """From rings to fragments in one plan: scopes are cut into trapezoids, and these clip the triangles they meet."""
    cut = polygons.scope_decompose(derived(spark, sf_dir, "scope_point"))
    pieces = spatial.grown(cut.select("scope_id", "slab", "pair", polygons.trapezoid_corners().alias("corners")))
    parts = geometry.fragments(spatial.box_overlap_join(_tri(spark, sf_dir), pieces, "scope_id"))
    return parts.groupBy("asset_id").agg(F.count("*").alias("fragments"), F.round(F.sum("area"), 2).alias("area"))


# --- Graph --------------------------------------------------------------------------------------------------------

_WALK = "WITH RECURSIVE w AS (SELECT node_id, CAST(step AS BIGINT) AS x, 0 AS level, mesh FROM node WHERE parent_id IS NULL UNION ALL SELECT n.node_id, w.x + n.step, w.level + 1, n.mesh FROM node n JOIN w ON n.parent_id = w.node_id) "


def _world(spark, sf_dir):
    step = matrices.translation(F.col("step").cast("double"), F.lit(0.0), F.lit(0.0))
    return graph.composed_to_root(derived(spark, sf_dir, "node"), step, matrices.multiply, stored)


#: Column-major elements of a node's own matrix: every other node turns by a right angle, and all move in three directions.
_OWN = ["CASE WHEN node_id % 2 = 0 THEN 0e0 ELSE 1e0 END", "CASE WHEN node_id % 2 = 0 THEN 1e0 ELSE 0e0 END", "0e0", "0e0", "CASE WHEN node_id % 2 = 0 THEN -1e0 ELSE 0e0 END", "CASE WHEN node_id % 2 = 0 THEN 0e0 ELSE 1e0 END", "0e0", "0e0",
        "0e0", "0e0", "1e0", "0e0", "CAST(step AS DOUBLE)", "CAST(node_id % 3 AS DOUBLE)", "CAST(node_id % 5 AS DOUBLE) / 4", "1e0"]


def _product(a: str, b: str, k: int) -> str:
    c, r = divmod(k, 4)
    return "(" + " + ".join(f"{a}[{r + 4 * j + 1}] * {b}[{4 * c + j + 1}]" for j in range(4)) + ")"


@query(f"""WITH RECURSIVE own AS (SELECT node_id, parent_id, [{', '.join(_OWN)}] AS m FROM node), w AS (SELECT node_id, m, 0 AS level FROM own WHERE parent_id IS NULL
    UNION ALL SELECT n.node_id, [{', '.join(_product('w.m', 'n.m', k) for k in range(16))}], w.level + 1 FROM own n JOIN w ON n.parent_id = w.node_id)
SELECT node_id, level, {', '.join(f'm[{k + 1}] + 0.0 AS c{k}' for k in range(16))} FROM w""")
def node_world(spark, sf_dir):
    """All sixteen elements of every node's world matrix."""
    own = F.array(*[F.expr(e) for e in _OWN])
    w = graph.composed_to_root(derived(spark, sf_dir, "node"), own, matrices.multiply, stored)
    return w.select("node_id", "level", *[(F.col("world")[k] + 0.0).alias(f"c{k}") for k in range(16)])


@query(_WALK + "SELECT mesh FROM w WHERE mesh IS NOT NULL AND level BETWEEN 1 AND 4")
def reachable_meshes(spark, sf_dir):
    near = _world(spark, sf_dir).where("level BETWEEN 1 AND 4").select("node_id")
    return derived(spark, sf_dir, "node").where("mesh IS NOT NULL").join(near, "node_id", "left_semi").select("mesh")


@query("""WITH RECURSIVE up AS (SELECT node_id, parent_id FROM node WHERE mesh IS NOT NULL AND mesh % 3 = 0 UNION SELECT n.node_id, n.parent_id FROM node n JOIN up ON up.parent_id = n.node_id)
SELECT node_id, CAST(row_number() OVER (ORDER BY node_id) - 1 AS BIGINT) AS new_index FROM (SELECT DISTINCT node_id FROM up) u""")
def node_prune(spark, sf_dir):
    nodes = derived(spark, sf_dir, "node")
    kept = graph.node_prune(nodes, nodes.where("mesh IS NOT NULL AND mesh % 3 = 0"), stored=stored)
    return graph.dense_ids(kept, "node_id", stored).select("node_id", F.col("new_index").cast("long").alias("new_index"))


@query("""WITH RECURSIVE r AS (SELECT parent_id AS node_id FROM edge_fault WHERE parent_id NOT IN (SELECT node_id FROM edge_fault) UNION SELECT e.node_id FROM edge_fault e JOIN r ON e.parent_id = r.node_id)
SELECT node_id, 'MULTIPLE_PARENTS' AS fault FROM edge_fault GROUP BY node_id HAVING count(*) > 1 UNION ALL SELECT DISTINCT node_id, 'SELF_PARENT' FROM edge_fault WHERE node_id = parent_id UNION ALL SELECT DISTINCT node_id, 'CYCLE' FROM edge_fault WHERE node_id NOT IN (SELECT node_id FROM r)""")
def node_graph_faults(spark, sf_dir):
    """Second parents, self-parents, and nodes on a cycle of any length or below one."""
    e = derived(spark, sf_dir, "edge_fault")
    named = lambda df, fault: df.select("node_id", F.lit(fault).alias("fault"))
    many = named(e.groupBy("node_id").count().where("count > 1"), "MULTIPLE_PARENTS")
    own = named(e.where("node_id = parent_id").select("node_id").distinct(), "SELF_PARENT")
    return many.unionByName(own).unionByName(named(graph.unreached(e, stored=stored), "CYCLE"))


# --- Matrices -----------------------------------------------------------------------------------------------------


def _slices(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", *[F.slice("e", 16 * k + 1, 16).alias(f"m{k}") for k in range(4)])


_E = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings"


@query(f"SELECT vec_id, {', '.join(f'round({_product('e[1:16]', 'e[17:32]', k)}, 6) AS c{k}' for k in range(16))} FROM ({_E}) t")
def mat4_multiply(spark, sf_dir):
    m = _slices(spark, sf_dir).withColumn("p", matrices.multiply(F.col("m0"), F.col("m1")))
    return m.select("vec_id", *[F.round(F.col("p")[k], 6).alias(f"c{k}") for k in range(16)])


#: Column-major elements of translation * rotation * scale; e[1:3] translates, e[4:7] turns, e[8:10] scales.
_TRS = ("(1 - 2 * (y * y + z * z)) * e[8]", "2 * (x * y + z * w) * e[8]", "2 * (x * z - y * w) * e[8]", "0.0", "2 * (x * y - z * w) * e[9]", "(1 - 2 * (x * x + z * z)) * e[9]", "2 * (y * z + x * w) * e[9]", "0.0",
        "2 * (x * z + y * w) * e[10]", "2 * (y * z - x * w) * e[10]", "(1 - 2 * (x * x + y * y)) * e[10]", "0.0", "e[1]", "e[2]", "e[3]", "1.0")


@query(f"SELECT vec_id, {', '.join(f'round(CAST({t} AS DOUBLE), 6) AS c{k}' for k, t in enumerate(_TRS))} FROM (SELECT *, e[4] / n AS x, e[5] / n AS y, e[6] / n AS z, e[7] / n AS w FROM (SELECT *, sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6] + e[7] * e[7]) AS n FROM ({_E}) a) b) c")
def mat4_from_trs(spark, sf_dir):
    m = _slices(spark, sf_dir).withColumn("m", matrices.from_trs(F.slice("m0", 1, 3), F.slice("m0", 4, 4), F.slice("m0", 8, 3)))
    return m.select("vec_id", *[F.round(F.col("m")[k], 6).alias(f"c{k}") for k in range(16)])


@query(f"SELECT vec_id, round((e[1] * 2 + e[5] * 3 + e[9] * 5 + e[13]) / w, 6) AS x, round((e[2] * 2 + e[6] * 3 + e[10] * 5 + e[14]) / w, 6) AS y, round((e[3] * 2 + e[7] * 3 + e[11] * 5 + e[15]) / w, 6) AS z FROM (SELECT *, e[4] * 2 + e[8] * 3 + e[12] * 5 + e[16] + 8 AS w FROM ({_E}) a) b WHERE abs(w) > 1e-15")
def mat4_apply(spark, sf_dir):
    m = _slices(spark, sf_dir).withColumn("m0", F.transform("m0", lambda x, i: F.when(i == 15, x + 8).otherwise(x)))
    p = matrices.apply(F.col("m0"), F.lit(2.0), F.lit(3.0), F.lit(5.0))
    return m.withColumn("p", p).where("p IS NOT NULL").select("vec_id", *[F.round(f"p.{a}", 6).alias(a) for a in "xyz"])


@query(f"""SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'Y' ELSE 'Z' END AS axis, round(CASE WHEN vec_id % 2 = 0 THEN e[1] * cx + e[5] * -cz + e[9] * cy + e[13] ELSE e[1] * cx + e[5] * cy + e[9] * cz + e[13] END, 6) AS x, round(CASE WHEN vec_id % 2 = 0 THEN e[2] * cx + e[6] * -cz + e[10] * cy + e[14] ELSE e[2] * cx + e[6] * cy + e[10] * cz + e[14] END, 6) AS y, round(CASE WHEN vec_id % 2 = 0 THEN e[3] * cx + e[7] * -cz + e[11] * cy + e[15] ELSE e[3] * cx + e[7] * cy + e[11] * cz + e[15] END, 6) AS z FROM (SELECT *, e[17] AS cx, e[18] AS cy, e[19] AS cz FROM ({_E}) a) b""")
def world_compose(spark, sf_dir):
    """tile * axis * T(centre): the translated origin of each asset."""
    axis = F.when(F.col("vec_id") % 2 == 0, "Y").otherwise("Z")
    m = _slices(spark, sf_dir).withColumn("axis", axis).withColumn("ax", matrices.up_axis(F.col("axis"))).withColumn("c", matrices.translation(*[F.col("m1")[i] for i in range(3)]))
    m = m.withColumn("w", matrices.multiply(F.col("m0"), F.col("ax"))).withColumn("w", matrices.multiply(F.col("w"), F.col("c")))
    return m.select("vec_id", "axis", *[F.round(F.col("w")[12 + k], 6).alias(a) for k, a in enumerate("xyz")])


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS valid FROM embeddings")
def rule_matrix_shape(spark, sf_dir):
    m = _slices(spark, sf_dir)
    ok = matrices.valid(F.col("m0")) & matrices.valid(F.col("m1")) & matrices.valid(F.col("m2")) & matrices.valid(F.col("m3"))
    return m.select("vec_id", ok.alias("valid"))


@query(f"SELECT vec_id, round(e[1] / n, 6) AS x, round(e[2] / n, 6) AS y, round(e[3] / n, 6) AS z FROM (SELECT *, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3]) AS n FROM ({_E}) a) b WHERE n > 1e-15")
def renormalize(spark, sf_dir):
    n = _slices(spark, sf_dir).withColumn("n", matrices.normalised(*[F.col("m0")[i] for i in range(3)])).where("n IS NOT NULL")
    return n.select("vec_id", *[F.round(f"n.{a}", 6).alias(a) for a in "xyz"])


# --- Projection ---------------------------------------------------------------------------------------------------


def _geo(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    return c.select(k, (F.lit(120.0) + (k * 7919 % 2001 - 1000) / 100000).alias("lon"), (F.lit(30.0) + (k * 6007 % 2001 - 1000) / 100000).alias("lat"), (k % 500).cast("double").alias("height"))


@query("SELECT c_custkey, round(120 + CAST(c_custkey * 7919 % 2001 - 1000 AS DOUBLE) / 100000, 8) AS lon, round(30 + CAST(c_custkey * 6007 % 2001 - 1000 AS DOUBLE) / 100000, 8) AS lat, round(CAST(c_custkey % 500 AS DOUBLE), 3) + 0.0 AS height FROM customer")
def ecef_to_geodetic(spark, sf_dir):
    """Geodetic to earth-centred (exact) and back: the oracle is where the points came from."""
    g = _geo(spark, sf_dir)
    lat, lon = F.radians("lat"), F.radians("lon")
    n = projection.A / F.sqrt(1 - projection.E2 * F.sin(lat) * F.sin(lat))
    g = g.select("c_custkey", ((n + F.col("height")) * F.cos(lat) * F.cos(lon)).alias("x"), ((n + F.col("height")) * F.cos(lat) * F.sin(lon)).alias("y"), ((n * (1 - projection.E2) + F.col("height")) * F.sin(lat)).alias("z"))
    out = projection.ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    return g.select("c_custkey", F.round(out["lon"], 8).alias("lon"), F.round(out["lat"], 8).alias("lat"), (F.round(out["height"], 3) + 0.0).alias("height"))


@query(None)
def local_project(spark, sf_dir):
    g = _geo(spark, sf_dir).withColumn("p", projection.local_project("lon", "lat", "120D", "30D"))
    return g.select("c_custkey", (F.round("p.x", 3) + 0.0).alias("x"), (F.round("p.y", 3) + 0.0).alias("y"), "height")


_CENTRE = (120.0, 30.0)
_TILE = meshes.east_north_up(*_CENTRE)


def _projection_sql(source: str, place: str) -> str:
    """CTEs from ``source`` (earth-centred columns ex, ey, ez) to ``place`` with px, py and ph: the inverse geodesic, a step a CTE."""
    f, a, b, e2, ep2 = 1 / projection.INVERSE_F, projection.A, projection.B, projection.E2, projection.EP2
    lon0, lat0 = _CENTRE
    steps = [
        f"g1 AS (SELECT *, sqrt(ex * ex + ey * ey) AS p, atan2(ez * {a!r}, sqrt(ex * ex + ey * ey) * {b!r}) AS u FROM {source})",
        f"g2 AS (SELECT *, degrees(atan2(ey, ex)) AS lon, atan2(ez + {ep2 * b!r} * power(sin(u), 3), p - {e2 * a!r} * power(cos(u), 3)) AS lat FROM g1)",
        f"g3 AS (SELECT *, p * cos(lat) + ez * sin(lat) - {a * a!r} / ({a!r} / sqrt(1 - {e2!r} * sin(lat) * sin(lat))) AS ph FROM g2)",
        f"v0 AS (SELECT *, atan((1 - {f!r}) * tan(radians({lat0!r}))) AS u1, atan((1 - {f!r}) * tan(radians(degrees(lat)))) AS u2, radians(lon - {lon0!r}) AS l, radians(lon - {lon0!r}) AS m FROM g3)",
    ]
    sigma = "sqrt(power(cos(u2) * sin(m), 2) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(m), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(m) AS cs"
    angle = "CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(m) / ss END AS sa, atan2(ss, cs) AS sg"
    middle = "1 - sa * sa AS c2, CASE WHEN 1 - sa * sa = 0 THEN 0.0::double ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS cm"
    for k in range(6):
        steps.append(f"""v{k + 1} AS (SELECT * EXCLUDE (m, ss, cs, sa, sg, c2, cm, c), CASE WHEN ss = 0 THEN m ELSE l + (1 - c) * {f!r} * sa * (sg + c * ss * (cm + c * cs * (-1 + 2 * cm * cm))) END AS m
            FROM (SELECT *, {f / 16!r} * c2 * (4 + {f!r} * (4 - 3 * c2)) AS c FROM (SELECT *, {middle} FROM (SELECT *, {angle} FROM (SELECT *, {sigma} FROM v{k}) s1) s2) s3) s4)""")
    steps.append(f"""w1 AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS ka, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS kb, atan2(cos(u2) * sin(m), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(m)) AS az
        FROM (SELECT *, c2 * {ep2!r} AS q FROM (SELECT *, {middle} FROM (SELECT *, {angle} FROM (SELECT *, {sigma} FROM v6) s1) s2) s3) s4)""")
    steps.append(f"""{place} AS (SELECT *, CASE WHEN ss = 0 THEN 0.0::double ELSE d * sin(az) END AS px, CASE WHEN ss = 0 THEN 0.0::double ELSE d * cos(az) END AS py
        FROM (SELECT *, {b!r} * ka * (sg - kb * ss * (cm + kb / 4 * (cs * (-1 + 2 * cm * cm) - kb / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm)))) AS d FROM w1) s)""")
    # Materialized, or the engine substitutes each step into the next one's every use.
    return ", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)


_EARTH = f"""earth AS (SELECT c_custkey, height, (n + height) * cos(la) * cos(lo) AS ex, (n + height) * cos(la) * sin(lo) AS ey, (n * (1 - {projection.E2!r}) + height) * sin(la) AS ez
    FROM (SELECT *, {projection.A!r} / sqrt(1 - {projection.E2!r} * sin(la) * sin(la)) AS n FROM (SELECT c_custkey, CAST(c_custkey % 500 AS DOUBLE) AS height, radians(120 + CAST(c_custkey * 7919 % 2001 - 1000 AS DOUBLE) / 100000) AS lo, radians(30 + CAST(c_custkey * 6007 % 2001 - 1000 AS DOUBLE) / 100000) AS la FROM customer) a) b)"""
ORACLE_SQL["local_project"] = f"WITH {_EARTH}, {_projection_sql('earth', 'there')} SELECT c_custkey, round(px, 3) + 0.0 AS x, round(py, 3) + 0.0 AS y, height FROM there"

#: What a vertex carries beside its place: texture coordinates, a normal, a colour.
_PAYLOAD = ["CAST(vid % 16 AS DOUBLE) / 16", "CAST(vid % 7 AS DOUBLE) / 8", "CAST(vid % 3 AS DOUBLE) - 1", "CAST(vid % 5 AS DOUBLE) - 2", "3e0", "CAST(vid % 256 AS DOUBLE) / 256", "CAST(vid % 11 AS DOUBLE) / 16", "1e0"]
_NORMAL = 5  # the payload follows the three local coordinates
_CARRIED = [f"p{k}" for k in range(3 + len(_PAYLOAD))]
#: Assets with an even number have content whose up axis is y; their local coordinates are turned so that the place is the same.
_LOCAL = "SELECT asset_id, prim, vid, x - 500 AS lx, CASE WHEN asset_id % 2 = 0 THEN z ELSE y - 500 END AS ly, CASE WHEN asset_id % 2 = 0 THEN 500 - y ELSE z END AS lz, {} FROM vertex"


def _place_sql() -> str:
    m = _TILE
    turned = "SELECT v.*, lx + w.x AS cx, CASE WHEN v.asset_id % 2 = 0 THEN -lz ELSE ly END AS cy, CASE WHEN v.asset_id % 2 = 0 THEN ly ELSE lz END AS cz FROM local_ v JOIN w ON w.mesh = 5 * (v.asset_id + 1)"
    return f"local_ AS ({_LOCAL.format(', '.join(f'{e} AS p{k + 3}' for k, e in enumerate(_PAYLOAD)))}), earth AS (SELECT *, {', '.join(f'{m[r]!r} * cx + {m[4 + r]!r} * cy + {m[8 + r]!r} * cz + {m[12 + r]!r} AS e{a}' for r, a in enumerate('xyz'))} FROM ({turned}) t), " + _projection_sql("earth", "there")


def _tile_clip_sql() -> str:
    corner = "{'x': px, 'y': py, 'z': ph, 'p0': lx, 'p1': ly, 'p2': lz, " + ", ".join(f"'{p}': {p}" for p in _CARRIED[3:]) + "}"
    source = f"""{_place_sql()}, three AS (SELECT asset_id, prim, CAST(floor(vid / 3) AS BIGINT) AS tri_id, list({corner} ORDER BY vid) AS p FROM there GROUP BY asset_id, prim, CAST(floor(vid / 3) AS BIGINT)),
        pairs AS (SELECT t.asset_id, t.tri_id, q.piece_id, q.minx - 500 AS x0, q.miny - 500 AS y0, q.maxx - 500 AS x1, q.maxy - 500 AS y1, t.p FROM three t JOIN piece q ON t.asset_id % 25 = q.scope_id)"""
    steps = _oracle_steps(source, fields=(*"xyz", *_CARRIED))
    recursive = _WALK.replace("WITH RECURSIVE w AS (", "w AS (").rstrip()
    steps = "WITH RECURSIVE " + recursive + ", " + steps[len("WITH ") :]
    length = lambda v: f"sqrt({' + '.join(f'{v}.p{_NORMAL + k} * {v}.p{_NORMAL + k}' for k in range(3))})"
    value = lambda v, k: f"CAST({v}.p{k} / {length(v)} AS FLOAT)" if _NORMAL <= k < _NORMAL + 3 else f"CAST({v}.p{k} AS FLOAT)"
    sums = ", ".join(f"round(CAST({' + '.join(f'CAST({value(v, k)} AS DOUBLE)' for v in 'abc')} AS DOUBLE), 2) + 0.0 AS s{k}" for k in range(len(_CARRIED)))
    return steps + f"SELECT asset_id, tri_id, piece_id, CAST(frag_id AS INTEGER) AS frag_id, round(area, 2) AS area, {sums} FROM frags WHERE area > 1e-8"


def placed_vertices(spark, sf_dir):
    """Vertices with the world matrix of the node that places their mesh: tile, up axis, node; and what they carry."""
    local = run_sql(spark, sf_dir, _LOCAL.format(f"array({', '.join(_PAYLOAD)}) AS payload")).withColumnsRenamed({"lx": "x", "ly": "y", "lz": "z"})
    nodes = derived(spark, sf_dir, "node").where("mesh IS NOT NULL").select("node_id", "mesh")
    world = _world(spark, sf_dir).select("node_id", "world").join(nodes, "node_id").select((F.col("mesh") / 5 - 1).cast("long").alias("asset_id"), "world")
    axis = matrices.up_axis(F.when(F.col("asset_id") % 2 == 0, "Y").otherwise("Z"))
    tile = F.array(*[F.lit(v) for v in _TILE])
    world = stored(world.withColumn("_axis", axis).withColumn("_tile", matrices.multiply(tile, F.col("_axis"))).select("asset_id", matrices.multiply(F.col("_tile"), F.col("world")).alias("world")))
    return local.join(world, "asset_id")


@query(_tile_clip_sql())
def tile_clip(spark, sf_dir):
    """From node tree to fragments: placed, projected once a vertex, clipped in the scope's plane, written in local float32 with all that corners carry."""
    vertices = meshes.projected(placed_vertices(spark, sf_dir), "world", f"{_CENTRE[0]!r}D", f"{_CENTRE[1]!r}D")
    tri = meshes.triangles(vertices, derived(spark, sf_dir, "triangle_index"), ["asset_id", "prim"]).withColumn("scope_id", F.col("asset_id") % 25)
    moved = derived(spark, sf_dir, "piece").withColumns({c: F.col(c) - 500 for c in spatial.BOX})
    # Stored, since the join looks at the boxes twice.
    pairs = spatial.box_overlap_join(stored(tri), spatial.grown(moved.withColumn("corners", geometry.rectangle())), "scope_id")
    out = geometry.fragments(pairs, geometry.CARRYING).withColumn("written", meshes.local_corners(F.col("frag"), _NORMAL))
    total = lambda k: F.round(F.aggregate("written", F.lit(0.0), lambda s, c: s + c[k].cast("double")), 2) + 0.0
    return out.select("asset_id", "tri_id", "piece_id", "frag_id", F.round("area", 2).alias("area"), *[total(k).alias(f"s{k}") for k in range(len(_CARRIED))])


# --- Textures -----------------------------------------------------------------------------------------------------

_UV = """u AS (SELECT use_id, image, wrap_s, wrap_t, {}, {} FROM uv_use),
sh AS (SELECT *, unnest(CASE WHEN wrap_s = 33071 THEN [0] ELSE range(CAST(floor(least(u0, u1, u2)) AS BIGINT) - 1, CAST(ceil(greatest(u0, u1, u2)) AS BIGINT) + 2) END) AS shift_u FROM u),
shifted AS (SELECT *, unnest(CASE WHEN wrap_t = 33071 THEN [0] ELSE range(CAST(floor(least(v0, v1, v2)) AS BIGINT) - 1, CAST(ceil(greatest(v0, v1, v2)) AS BIGINT) + 2) END) AS shift_v FROM sh)""".format(
    *[", ".join(f"CASE WHEN {w} = 33071 THEN least(1.0::double, greatest(0.0::double, {a}{i})) ELSE {a}{i} END AS {a}{i}" for i in range(3)) for a, w in (("u", "wrap_s"), ("v", "wrap_t"))])


def _near_sql() -> str:
    signs, near = [], []
    for i, j in ((0, 1), (1, 2), (2, 0)):
        ax, ay, bx, by = f"x{i}", f"y{i}", f"x{j}", f"y{j}"
        signs.append(f"(({bx} - {ax}) * (py - {ay}) - ({by} - {ay}) * (px - {ax}))")
        dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
        n = f"({dx} * {dx} + {dy} * {dy})"
        t = f"(CASE WHEN {n} > 0 THEN greatest(0.0::double, least(1.0::double, ((px - {ax}) * {dx} + (py - {ay}) * {dy}) / {n})) ELSE 0.0::double END)"
        near.append(f"power(px - ({ax} + {dx} * {t}), 2) + power(py - ({ay} + {dy} * {t}), 2) <= 1")
    return f"(({' AND '.join(f'{s} >= 0' for s in signs)}) OR ({' AND '.join(f'{s} <= 0' for s in signs)}) OR {' OR '.join(near)})"


_COVER = "WITH " + _UV + f""", px AS (SELECT *, x + 0.5::double AS px, y + 0.5::double AS py, {', '.join(f'(u{i} - shift_u) * 16 AS x{i}, (v{i} - shift_v) * 16 AS y{i}' for i in range(3))} FROM shifted CROSS JOIN (SELECT unnest(range(0, 16)) AS x) a CROSS JOIN (SELECT unnest(range(0, 16)) AS y) b),
cover AS (SELECT DISTINCT image, use_id, x, y FROM px WHERE x >= floor(least(x0, x1, x2)) - 1 AND x <= ceil(greatest(x0, x1, x2)) + 1 AND y >= floor(least(y0, y1, y2)) - 1 AND y <= ceil(greatest(y0, y1, y2)) + 1 AND {_near_sql()}) """


def _cover(spark, sf_dir):
    return raster.uv_rasterize(derived(spark, sf_dir, "uv_use"))


def _own_images(spark, sf_dir):
    """Every supplier's use draws on an image of its own; a fourth of the images is used."""
    return derived(spark, sf_dir, "uv_use").withColumn("image", F.col("use_id"))


def _pixels(spark, sf_dir):
    """16 x 16 pixels an image, one image a supplier, none black."""
    n = F.explode(F.sequence(F.lit(0), F.lit(255)))
    p = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("image"), n.alias("n"))
    return p.select("image", (F.col("n") % 16).cast("long").alias("x"), F.floor(F.col("n") / 16).alias("y"), ((F.col("image") * 256 + F.col("n")) % 251 + 1).alias("r"))


_PIXELS = "(SELECT image, x, y, CAST((image * 256 + y * 16 + x) % 251 + 1 AS BIGINT) AS r FROM (SELECT s_suppkey AS image, CAST(unnest(range(256)) % 16 AS BIGINT) AS x, CAST(floor(unnest(range(256)) / 16) AS BIGINT) AS y FROM supplier) i)"


@query("WITH " + _UV + " SELECT use_id, CAST(shift_u AS BIGINT) AS shift_u, CAST(shift_v AS BIGINT) AS shift_v FROM shifted")
def uv_wrap_shifts(spark, sf_dir):
    return raster.uv_wrap_shifts(derived(spark, sf_dir, "uv_use")).select("use_id", "shift_u", "shift_v")


@query(_COVER + "SELECT * FROM cover")
def uv_rasterize(spark, sf_dir):
    return _cover(spark, sf_dir)


@query(_COVER + "SELECT use_id, count(*) AS pixels FROM cover GROUP BY use_id")
def pixel_inside_or_near(spark, sf_dir):
    return _cover(spark, sf_dir).groupBy("use_id").agg(F.count("*").alias("pixels"))


@query(_COVER + "SELECT DISTINCT image, x, y FROM cover")
def mask_union(spark, sf_dir):
    c = _cover(spark, sf_dir)
    return c.where("use_id % 2 = 0").select("image", "x", "y").unionByName(c.where("use_id % 2 = 1").select("image", "x", "y")).distinct()


@query(_COVER + "SELECT image, count(DISTINCT y * 16 + x) AS covered, round(count(DISTINCT y * 16 + x) / 256.0::double, 6) AS ratio FROM cover GROUP BY image")
def mask_coverage(spark, sf_dir):
    """Two masks, of even and of odd uses, become one; bits are counted."""
    uses = derived(spark, sf_dir, "uv_use")
    both = raster.mask_bitmaps(uses.where("use_id % 2 = 0")).unionByName(raster.mask_bitmaps(uses.where("use_id % 2 = 1")))
    return raster.mask_sizes(raster.mask_or(both)).withColumn("ratio", F.round(F.col("covered") / 256, 6))


def _own_mask(spark, sf_dir):
    return raster.mask_bitmaps(_own_images(spark, sf_dir).where("use_id % 4 = 1"))


_OWN_COVER = "(SELECT DISTINCT use_id AS image, x, y FROM cover WHERE use_id % 4 = 1)"


@query(_COVER + f"SELECT p.image, p.x, p.y, CASE WHEN c.image IS NULL THEN 0 ELSE p.r END AS r FROM {_PIXELS} p LEFT JOIN {_OWN_COVER} c ON p.image = c.image AND p.x = c.x AND p.y = c.y")
def mask_apply(spark, sf_dir):
    return raster.apply_mask(_pixels(spark, sf_dir), _own_mask(spark, sf_dir), ["r"])


@query(_COVER + f"SELECT p.image, p.x, p.y FROM {_PIXELS} p LEFT JOIN {_OWN_COVER} c ON p.image = c.image AND p.x = c.x AND p.y = c.y WHERE c.image IS NULL AND p.image % 7 = 3 AND (p.x + p.y) % 5 = 0")
def mask_verify(spark, sf_dir):
    """Pixels that leak: in every seventh image, a fifth of the pixels was left as it came."""
    given, mask = _pixels(spark, sf_dir), _own_mask(spark, sf_dir)
    forgotten = (F.col("image") % 7 == 3) & ((F.col("x") + F.col("y")) % 5 == 0)
    written = raster.apply_mask(given, mask, ["r"]).where(~forgotten).unionByName(given.where(forgotten))
    return raster.mask_leaks(written, mask, ["r"]).select("image", "x", "y")


@query("SELECT count(*) FILTER (WHERE wrap_r IS NOT NULL) AS affected, list_sort(list(DISTINCT wrap_r) FILTER (WHERE wrap_r IS NOT NULL)) AS wrap_values FROM sampler")
def sampler_diagnostics(spark, sf_dir):
    return derived(spark, sf_dir, "sampler").agg(F.count_if(F.col("wrap_r").isNotNull()).alias("affected"), F.sort_array(F.collect_set("wrap_r")).alias("wrap_values"))


# --- Events and JSON ----------------------------------------------------------------------------------------------


_SHARES = {"p95": 0.95, "p99": 0.99}


@query("SELECT event, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99 FROM task_event GROUP BY event")
def stage_latency(spark, sf_dir):
    q = quantiles.exact_quantiles(derived(spark, sf_dir, "task_event"), "event", "duration_ms", _SHARES, stored)
    return q.select("event", *[F.round(n, 6).alias(n) for n in _SHARES])


@query("""SELECT event, count(*) AS events, true AS p95_near, true AS p99_near FROM task_event GROUP BY event""")
def stage_latency_sketch(spark, sf_dir):
    """Whether the ranks of the sketch's quantiles are as near to the true ones as stated: within a thousandth of the events."""
    e = derived(spark, sf_dir, "task_event")
    q = quantiles.sketched_quantiles(e, "event", "duration_ms", _SHARES, 1000)
    # One row a kind of event, counted against every event once.
    d, n = F.col("duration_ms"), F.count("*")
    tests = [((F.count_if(d < F.col(name)) <= (share + 0.001) * n + 1) & (F.count_if(d <= F.col(name)) >= (share - 0.001) * n - 1)).alias(f"{name}_near") for name, share in _SHARES.items()]
    return e.join(q, "event").groupBy("event").agg(n.alias("events"), *tests)


RESERVED = ("timestamp", "level", "event", "message", "workerId", "assetId")


def build_event(fields, base):
    """JSON text of the protected base fields and those open fields that don't claim their names."""
    free = F.map_filter(fields, lambda k, v: ~k.isin(*RESERVED))
    return F.to_json(F.map_concat(base, free))


def _events_json(spark, sf_dir):
    e = derived(spark, sf_dir, "task_event")
    text = lambda c: F.col(c).cast("string")
    base = F.create_map(F.lit("level"), F.col("level"), F.lit("event"), F.col("event"), F.lit("assetId"), text("asset_id"))
    open_ = F.create_map(F.lit("event"), F.lit("forged"), F.lit("durationMs"), text("duration_ms"), F.lit("fault"), text("fault"))
    return e.select("event_id", build_event(open_, base).alias("json"))


@query("""SELECT event_id, '{"level":"' || level || '","event":"' || event || '","assetId":"' || CAST(asset_id AS VARCHAR) || '","durationMs":"' || CAST(duration_ms AS VARCHAR) || '","fault":"' || CAST(fault AS VARCHAR) || '"}' AS json FROM task_event""")
def event_build(spark, sf_dir):
    return _events_json(spark, sf_dir)


@query("SELECT event_id, event, CAST(duration_ms AS BIGINT) AS duration_ms FROM task_event WHERE event_id % 10 <> 3")
def task_event_scan(spark, sf_dir):
    """Event lines, every tenth of them broken, read with a fixed schema; broken lines are set apart."""
    lines = _events_json(spark, sf_dir).withColumn("json", F.when(F.col("event_id") % 10 == 3, F.expr("substring(json, 1, 12)")).otherwise(F.col("json")))
    parsed = lines.withColumn("r", F.from_json("json", "event string, durationMs string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.where("r._corrupt_record IS NULL").select("event_id", "r.event", F.col("r.durationMs").cast("long").alias("duration_ms"))


def _manifest(spark, sf_dir):
    """Task documents as JSON text with missing, null, mistyped and surplus fields."""
    t = derived(spark, sf_dir, "task")
    k = F.col("task_id")
    body = F.to_json(F.struct(F.when(k % 31 != 0, k).alias("taskId"), F.col("asset").alias("assetId"), F.when(k % 37 != 0, F.col("srid")).alias("scopeSrid"), F.col("up_axis").alias("gltfUpAxis"), F.when(k % 41 == 0, "debug").alias("surplus")))
    return t.select("task_id", F.when(k % 43 == 0, F.regexp_replace(body, '"scopeSrid":4490', '"scopeSrid":"4490"')).when(k % 47 == 0, F.lit("{broken")).otherwise(body).alias("json"))


_MANIFEST = """CASE WHEN task_id % 47 = 0 AND task_id % 43 <> 0 THEN 'UNREADABLE' WHEN task_id % 31 = 0 OR asset IS NULL OR task_id % 37 = 0 THEN 'MISSING_FIELD' WHEN task_id % 43 = 0 AND srid = 4490 THEN 'WRONG_TYPE' ELSE 'OK' END"""
_REQUIRED = ("taskId", "assetId", "scopeSrid", "gltfUpAxis")


def manifest_code(json):
    """First fault of a task document: unreadable, a missing or null field, a field of the wrong type."""
    keys = F.json_object_keys(json)
    present = F.array(*[F.get_json_object(json, f"$.{f}").isNotNull() for f in _REQUIRED])
    quoted = json.rlike('"(taskId|scopeSrid)":"')
    return F.when(keys.isNull() | F.from_json(json, "map<string,string>").isNull(), "UNREADABLE").when(F.exists(present, lambda p: ~p), "MISSING_FIELD").when(quoted, "WRONG_TYPE").otherwise("OK")


@query(f"SELECT task_id, {_MANIFEST} AS code FROM task")
def rule_required_fields(spark, sf_dir):
    return _manifest(spark, sf_dir).select("task_id", manifest_code(F.col("json")).alias("code"))


@query(f"SELECT task_id, asset, CAST(srid AS BIGINT) AS srid FROM task WHERE {_MANIFEST} = 'OK'")
def task_manifest_scan(spark, sf_dir):
    m = _manifest(spark, sf_dir).withColumn("code", manifest_code(F.col("json"))).where("code = 'OK'")
    return m.withColumn("r", F.from_json("json", "assetId string, scopeSrid bigint")).select("task_id", F.col("r.assetId").alias("asset"), F.col("r.scopeSrid").alias("srid"))


@query("SELECT task_id, 'surplus' AS key FROM task WHERE task_id % 41 = 0 AND NOT (task_id % 47 = 0 AND task_id % 43 <> 0)")
def rule_json_allowlist(spark, sf_dir):
    allowed = F.array(*[F.lit(f) for f in _REQUIRED])
    return _manifest(spark, sf_dir).select("task_id", F.explode(F.array_except(F.json_object_keys("json"), allowed)).alias("key"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'EXT_unknown' END AS refused, p_partkey % 4 = 0 AS has_webp FROM part")
def rule_extension_allowlist(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    names = F.array_compact(F.array(F.lit("KHR_materials_unlit"), F.when(k % 4 == 0, "EXT_texture_webp"), F.when(k % 6 == 0, "EXT_unknown")))
    p = p.select(k, F.to_json(names).alias("json")).withColumn("used", F.from_json("json", "array<string>"))
    return p.select("p_partkey", F.get(F.array_except("used", F.array(F.lit("KHR_materials_unlit"), F.lit("EXT_texture_webp"))), F.lit(0)).alias("refused"), F.array_contains("used", "EXT_texture_webp").alias("has_webp"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 2 END AS kept FROM part")
def batch_table_sanitize(spark, sf_dir):
    """Keeps properties that are arrays of the batch length (here 1) without object cells."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    cell = F.when(F.col("p_size") % 3 == 0, F.lit('{"deep":1}')).otherwise(F.lit("5"))
    j = F.concat(F.lit('{"name":["a"],"size":['), cell, F.lit('],"long":["a","b"]}'))
    m = F.from_json(j, "map<string,array<string>>")
    good = F.map_filter(m, lambda k, v: (F.size(v) == 1) & F.forall(v, lambda c: ~c.startswith("{")))
    return p.select("p_partkey", F.size(good).alias("kept"))


@query("SELECT wrap_t, count(*) AS seen, count(*) FILTER (WHERE wrap_r = -1) AS rejected FROM sampler GROUP BY wrap_t")
def diagnostics_branch(spark, sf_dir):
    """Diagnostics come from their own branch of the scan, so a later rejection can't hide them."""
    s = derived(spark, sf_dir, "sampler")
    bad = s.where("wrap_r = -1").groupBy(F.col("wrap_t").alias("t")).agg(F.count("*").alias("rejected"))
    return s.groupBy("wrap_t").agg(F.count("*").alias("seen")).join(bad, F.col("wrap_t").eqNullSafe(F.col("t")), "left").select("wrap_t", "seen", F.coalesce("rejected", F.lit(0)).alias("rejected"))


_REACH = "material % 20 <> 13 AND material % 20 % 10 <> 7"


@query(_COVER + f"""SELECT p.asset_id, CAST(coalesce(sum(i.before), 0) AS BIGINT) AS texture_bytes_before, CAST(coalesce(sum(CASE WHEN r.survives = 1 THEN i.after END), 0) AS BIGINT) AS texture_bytes_after FROM (SELECT DISTINCT asset_id FROM material) p
    LEFT JOIN (SELECT asset_id, material % 20 % 10 AS image, max(survives) AS survives FROM material WHERE {_REACH} GROUP BY asset_id, material % 20 % 10) r ON r.asset_id = p.asset_id
    LEFT JOIN (SELECT a.image, a.before, coalesce(4 * c.n, 0) AS after FROM (SELECT image, 1024 + count(*) AS before FROM uv_use GROUP BY image) a LEFT JOIN (SELECT image, count(DISTINCT y * 16 + x) AS n FROM cover GROUP BY image) c ON a.image = c.image) i ON i.image = r.image GROUP BY p.asset_id""")
def texture_statistics(spark, sf_dir):
    """Texture bytes before and after: images reached by any and by surviving primitives, the latter with what their masks leave."""
    uses, m = derived(spark, sf_dir, "uv_use"), derived(spark, sf_dir, "material")
    before = uses.groupBy("image").agg((1024 + F.count("*")).alias("bytes_before"))
    after = raster.mask_sizes(raster.mask_bitmaps(uses)).select("image", (4 * F.col("covered")).alias("bytes_after"))
    images = before.join(after, "image", "left").withColumn("bytes_after", F.coalesce("bytes_after", F.lit(0)))
    chain = m.where(_REACH).select("material", (F.col("material") % 20 % 10).alias("image"))
    return resources.texture_bytes(m.select("asset_id", "material", "survives"), chain, images)


_TILE_OF = "CAST(floor(sampler / 3) AS BIGINT)"
_KEPT = f"kept AS (SELECT s.* FROM (SELECT *, {_TILE_OF} AS tile FROM sampler) s WHERE tile NOT IN (SELECT {_TILE_OF} FROM sampler WHERE coalesce(wrap_r, 10497) NOT IN (33071, 33648, 10497) OR coalesce(wrap_s, 10497) = 33648))"


@query(f"""WITH {_KEPT} SELECT 'scan' AS observer, metric, CAST(value AS BIGINT) AS value FROM (SELECT 'seen' AS metric, count(*) AS value FROM sampler UNION ALL SELECT 'third_axis', count(wrap_r) FROM sampler UNION ALL SELECT 'unknown_mode', count(*) FILTER (WHERE wrap_r NOT IN (33071, 33648, 10497)) FROM sampler) a
    UNION ALL SELECT 'processed', metric, CAST(value AS BIGINT) FROM (SELECT 'samplers' AS metric, count(*) AS value FROM kept UNION ALL SELECT 'repeat_s', count(*) FILTER (WHERE coalesce(wrap_s, 10497) = 10497) FROM kept) b""")
def diagnostics_observed(spark, sf_dir):
    """What observers saw of samplers on the scan, and of those in tiles that no rule rejected, from the job that stores the latter."""
    seen = diagnostics.Diagnostics()
    s = derived(spark, sf_dir, "sampler").withColumn("tile", F.floor(F.col("sampler") / 3))
    s = seen.watch(s, "scan", **diagnostics.sampler_metrics())
    broken = ~F.coalesce("wrap_r", F.lit(10497)).isin(33071, 33648, 10497) | (F.coalesce("wrap_s", F.lit(10497)) == 33648)
    tiles_ = s.groupBy("tile").agg(F.max(broken).alias("broken"), F.collect_list(F.struct("sampler", "wrap_s")).alias("samplers"))  # three a tile
    kept = tiles_.where(~F.col("broken")).select(F.explode("samplers").alias("s")).select("s.*")
    stored(seen.watch(kept, "processed", samplers=F.count(F.lit(1)), repeat_s=F.count_if(F.coalesce("wrap_s", F.lit(10497)) == 10497)))
    return seen.as_rows(spark)
