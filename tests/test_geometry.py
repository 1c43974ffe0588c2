"""Literal cases: clip, transforms, projection."""

import math

import pytest
from pyspark.sql import functions as F

from tilewright.operators import geometry, matrices, projection


def test_clip_of_one_triangle(spark):
    """A triangle against a box of +-4.82 x +-5.54 leaves one six-cornered polygon of 88.2264 square metres."""
    df = spark.createDataFrame([(-10.0, -4.0, 10.0, -4.0, 0.0, 10.0, 0.0, -4.82, -5.54, 4.82, 5.54)], "ax double, ay double, bx double, by_ double, cx double, cy double, h double, x0 double, y0 double, x1 double, y1 double")
    poly = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0.0).alias("z")) for x, y in (("ax", "ay"), ("bx", "by_"), ("cx", "cy"))])
    df = df.withColumn("poly", poly).withColumn("corners", geometry.rectangle("x0", "y0", "x1", "y1"))
    assert df.select(F.size(geometry.clip("poly", "corners"))).first()[0] == 6
    assert geometry.fragments(df).agg(F.sum("area")).first()[0] == pytest.approx(88.2264, abs=1e-3)


def test_wall_survives(spark):
    """A vertical face has area in space though it projects to a line."""
    df = spark.range(1).select(F.expr("array(named_struct('x', 0D, 'y', 0D, 'z', 0D), named_struct('x', 0D, 'y', 0D, 'z', 2D), named_struct('x', 0D, 'y', 1D, 'z', 0D))").alias("t"))
    assert df.select(geometry.area3("t")).first()[0] == pytest.approx(1.0)


def test_transform_order(spark):
    """T(10,20,30) S(2,3,4) takes (1,2,3) to (12,26,42)."""
    d = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    m = matrices.from_trs(d(10, 20, 30), d(0, 0, 0, 1), d(2, 3, 4))
    p = spark.range(1).select(matrices.apply(m, F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("p")).first()["p"]
    assert tuple(p) == (12.0, 26.0, 42.0)
    q = matrices.from_trs(d(0, 0, 0), d(0, 0, math.sqrt(0.5), math.sqrt(0.5)), d(1, 1, 1))
    p = spark.range(1).select(matrices.apply(q, F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("p")).first()["p"]
    assert p["x"] == pytest.approx(0, abs=1e-12) and p["y"] == pytest.approx(1, abs=1e-12)


def test_projection_of_a_square(spark):
    """Half a span of 0.00005 degree at (120, 30) is 4.8243 m east and 5.5426 m north; the centre is 0."""
    row = spark.range(1).select(projection.local_project("120.00005D", "30.00005D", "120D", "30D").alias("p"), projection.local_project("120D", "30D", "120D", "30D").alias("c")).first()
    assert row["p"]["x"] == pytest.approx(4.8243, abs=1e-3) and row["p"]["y"] == pytest.approx(5.5426, abs=1e-3)
    assert tuple(row["c"]) == (0.0, 0.0)


def test_boxes_of_any_size(spark):
    """Pairs equal those of plain comparison; null, infinite and reversed boxes match nothing."""
    import random

    from tilewright.operators import spatial

    rng = random.Random(3)

    def box(i):
        w = rng.choice([0.0, 1.0, 100.0, 1e4, 1e9, 1e17])
        x, y = rng.uniform(-500, 500), rng.uniform(-500, 500)
        return (i, 1, x, y, x + w, y + rng.choice([0.0, 5.0, w]))

    odd = [(90, 1, None, 0.0, 1.0, 1.0), (91, 1, float("-inf"), 0.0, float("inf"), 1.0), (92, 1, 0.0, float("nan"), 1.0, 1.0), (93, 1, 5.0, 0.0, -5.0, 1.0)]
    left, right = [box(i) for i in range(60)], [box(i) for i in range(40)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, k long, minx double, miny double, maxx double, maxy double")
    got = sorted((r.a, r.b) for r in spatial.box_overlap_join(frame(left + odd, "a"), frame(right + odd, "b"), "k").select("a", "b").collect())
    assert got == sorted((p[0], q[0]) for p in left for q in right if p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])
    assert spatial.box_overlap_join(frame([], "a"), frame(right, "b"), "k").count() == 0


def test_graph_levels_and_ids(spark):
    import pytest

    from tilewright.functions.storage import stored
    from tilewright.operators import graph

    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)] + [(50, None)], "node_id long, parent_id long")
    keep = nodes.where("node_id = 8")
    kept = graph.dense_ids(graph.node_prune(nodes, keep, stored=stored), "node_id", stored)
    assert sorted((r.node_id, r.new_index) for r in kept.collect()) == [(i, i) for i in range(9)]
    with pytest.raises(ValueError):
        graph.node_prune(nodes, keep, most_levels=3, stored=stored)
    assert graph.dense_ids(nodes.limit(0), "node_id", stored).count() == 0


def test_no_pair_is_lost_at_a_sharp_corner(spark):
    """A triangle beyond the sharp corner of a piece, within a centimetre of both its edges' lines, is found by the index too."""
    from tilewright.operators import spatial

    pieces = spark.createDataFrame([(1, 1, [(0.0, 0.0), (100.0, 0.0), (100.0, 1.0)]), (1, 2, [(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)])], "k long, piece long, corners array<struct<x:double,y:double>>")
    tri = spark.createDataFrame([(1, 7, -0.5, -0.006, -0.3, -0.006, -0.4, -0.002, 0.0)], "k long, tri long, ax double, ay double, bx double, by_ double, cx double, cy double, h double")
    tri, box = geometry.with_polygon(tri), spatial.grown(pieces)
    assert {r.piece for r in spatial.box_overlap_join(tri, box, "k").collect()} == {1, 2}  # a degenerate piece meets all
    whole = box.where("piece = 1")
    counts = [geometry.fragments(pairs).count() for pairs in (spatial.box_overlap_join(tri, whole, "k"), spatial.exhaustive_pairs(tri, whole, "k"))]
    assert counts[0] == counts[1] > 0
    square = spatial.grown(spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)])], "k long, corners array<struct<x:double,y:double>>")).first()
    assert [square[c] for c in spatial.BOX] == pytest.approx([-0.01, -0.01, 2.01, 1.01], abs=1e-8)


def test_cycles_and_rejects(spark):
    from tilewright.functions.storage import stored
    from tilewright.operators import graph, polygons, raster

    edges = spark.createDataFrame([(2, 1), (3, 2), (3, 3), (4, 5), (5, 6), (6, 4), (7, 6), (8, 8), (9, None)], "node_id long, parent_id long")
    assert sorted(r.node_id for r in graph.unreached(edges, stored=stored).collect()) == [4, 5, 6, 7, 8]
    assert graph.unreached(edges.limit(0), stored=stored).count() == 0
    ring = lambda r, far: [(1, 0, r, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (far, 0.0), (0.0, 0.001), (0.0, 0.0)])]
    points = spark.createDataFrame(ring(0, 0.001) + ring(1, 120.0), "scope_id long, polygon_id int, ring_id int, seq int, lon double, lat double")
    assert {r.ring_id for r in polygons.ring_densify(points).collect()} == {0}
    assert sorted((r.ring_id, r.seq, r.code) for r in polygons.ring_rejects(points).collect()) == [(1, 0, "TOO_MANY_STEPS"), (1, 1, "TOO_MANY_STEPS")]
    uses = spark.createDataFrame([(1, 10497, 200.0), (2, 33071, 200.0), (3, 10497, 2.0)], "use_id long, wrap_s int, u1 double").selectExpr("*", "wrap_s AS wrap_t", "0D AS u0", "0D AS u2", "0D AS v0", "0D AS v1", "1D AS v2")
    assert [r.use_id for r in raster.uv_rejects(uses).collect()] == [1]
    assert {r.use_id for r in raster.uv_wrap_shifts(uses).collect()} == {2, 3}


def test_a_chain_of_any_depth_takes_few_rounds(spark):
    """100,000 nodes in a row, a tree beside them, a cycle with a tail and a parent that isn't there."""
    from tilewright.functions.storage import stored
    from tilewright.operators import graph

    rounds = []

    def counted(df):
        rounds.append(1)
        return stored(df)

    chain = spark.range(100_000).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    odd = spark.createDataFrame([(-1, None), (-2, -1), (-3, -1), (-4, -3), (-10, -11), (-11, -10), (-12, -11), (-20, -21)], "node_id long, parent_id long")
    w = graph.composed_to_root(chain.unionByName(odd), F.lit(1), lambda a, b: a + b, counted)
    assert len(rounds) <= 19
    assert w.where("node_id >= 0").agg(F.count("*"), F.sum(F.abs(F.col("level") - F.col("node_id"))), F.sum(F.abs(F.col("world") - F.col("node_id") - 1))).first()[:] == (100_000, 0, 0)
    assert sorted((r.node_id, r.level) for r in w.where("node_id < 0").collect()) == [(-4, 2), (-3, 1), (-2, 1), (-1, 0)]


def test_payload_is_clipped_along(spark):
    """A corner's payload is interpolated by the same share as its place; content with y up gives the same fragments as with z up."""
    from tilewright.operators import meshes

    tri = "array(named_struct('x', -1D, 'y', 0D, 'z', 0D, 'p', array(0D, -1D)), named_struct('x', 2D, 'y', 0D, 'z', 0D, 'p', array(3D, 2D)), named_struct('x', 0D, 'y', 2D, 'z', 0D, 'p', array(2D, 0D)))"
    piece = "array(named_struct('x', 0D, 'y', -1D), named_struct('x', 1D, 'y', -1D), named_struct('x', 0D, 'y', 2D))"
    df = spark.range(1).select(F.expr(tri).alias("poly"), F.expr(piece).alias("corners"))
    corners = df.select(F.explode(geometry.clip("poly", "corners", geometry.CARRYING)).alias("v")).select("v.*").collect()
    assert len(corners) >= 3 and all(v.p[1] == pytest.approx(v.x) for v in corners)
    assert {(round(v.x, 6), round(v.y, 6)): round(v.p[0], 6) for v in corners}[(0.0, 0.0)] == 1.0

    tile = meshes.east_north_up(120.0, 30.0)
    box = spark.createDataFrame([(-4.82, -5.54, 4.82, 5.54)], "minx double, miny double, maxx double, maxy double").select(geometry.rectangle().alias("corners"))
    out = []
    for axis in "ZY":
        rows = [(k, x, y, z) if axis == "Z" else (k, x, z, -y) for k, (x, y, z) in enumerate(((-10.0, -4.0, 0.0), (10.0, -4.0, 0.0), (0.0, 10.0, 0.0)))]
        v = spark.createDataFrame([(1, *r, [0.5 * r[0], 1.0]) for r in rows], "asset long, vid int, x double, y double, z double, payload array<double>")
        world = matrices.multiply(F.array(*[F.lit(e) for e in tile]), matrices.up_axis(F.lit(axis)))
        v = meshes.projected(v.withColumn("world", world), "world", "120D", "30D")
        t = meshes.triangles(v, spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 0, 1, 9)], "asset long, tri_id int, i0 int, i1 int, i2 int"), ["asset"])
        parts = geometry.fragments(t.crossJoin(box), geometry.CARRYING).withColumn("w", meshes.local_corners(F.col("frag"))).collect()
        turned = [(c[0], c[1], c[2]) if axis == "Z" else (c[0], -c[2], c[1]) for r in parts for c in r.w]
        assert {r.tri_id for r in parts} == {0} and sum(r.area for r in parts) == pytest.approx(88.2264, abs=1e-3)
        assert all(abs(x) <= 5 and abs(y) <= 5.7 and abs(z) < 1e-3 for x, y, z in turned)
        out.append(sorted((round(x, 3), round(y, 3)) for x, y, _ in turned))
    assert out[0] == out[1]


def test_a_normal_without_length_is_named(spark):
    from tilewright.operators import meshes

    corner = lambda n: f"named_struct('x', 0D, 'y', 0D, 'z', 0D, 'p', array(1D, 2D, 3D, {n}))"
    df = spark.range(1).select(F.expr(f"array({corner('0D, 0D, 2D')}, {corner('3D, 0D, 4D')})").alias("good"), F.expr(f"array({corner('0D, 0D, 2D')}, {corner('0D, 0D, 0D')})").alias("bad"))
    row = df.select(meshes.local_corners(F.col("good"), 3).alias("g"), meshes.local_corners(F.col("bad"), 3).alias("b")).first()
    assert row.b is None and row.g[1][3:] == pytest.approx([0.6, 0.0, 0.8]) and row.g[0][:3] == [1, 2, 3]


def ring(spark, n):
    """A closed ring of n points around (0, 0) whose distance from there wavers."""
    a = 2 * F.lit(math.pi) * F.pmod(F.col("id"), F.lit(n)) / n
    r = 1000 + 5 * F.sin(40 * a)
    return spark.range(n + 1).select(F.lit(1).alias("scope_id"), F.lit(0).alias("polygon_id"), F.lit(0).alias("ring_id"), F.col("id").alias("seq"), (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"))


def test_a_large_ring(spark):
    """Trapezoids of a ring of 50,000 points have its area, and no two of its segments cross."""
    import numpy as np

    from tilewright.operators import polygons

    n = 50_000
    cut = polygons.scope_decompose(ring(spark, n))
    rows, area = cut.agg(F.count("*"), F.sum((F.col("right_low") - F.col("left_low") + F.col("right_high") - F.col("left_high")) / 2 * (F.col("y1") - F.col("y0")))).first()
    a = 2 * np.pi * np.arange(n) / n
    x, y = (1000 + 5 * np.sin(40 * a)) * np.cos(a), (1000 + 5 * np.sin(40 * a)) * np.sin(a)
    assert rows < 3 * n and area == pytest.approx(abs(np.sum(x * np.roll(y, -1) - y * np.roll(x, -1))) / 2, rel=1e-9)
    assert polygons.ring_crossings(ring(spark, n)).count() == 0


def test_a_bow_tie_crosses(spark):
    from tilewright.operators import polygons

    tie = [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]
    square, hole = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(0, 0), (3, 1), (1, 3), (0, 0)]  # touches in a corner
    rows = [(s, 0, r, k, float(x), float(y)) for s, r, points in ((1, 0, tie), (2, 0, square), (2, 1, hole), (3, 0, square), (3, 1, [(8, 8), (12, 8), (8, 5), (8, 8)])) for k, (x, y) in enumerate(points)]
    points = spark.createDataFrame(rows, "scope_id int, polygon_id int, ring_id int, seq int, x double, y double")
    assert sorted((r.scope_id, r.ring_id, r.seq, r.ring_id2, r.seq2) for r in polygons.ring_crossings(points).collect()) == [(1, 0, 0, 0, 2), (3, 0, 1, 1, 0), (3, 0, 1, 1, 1)]
