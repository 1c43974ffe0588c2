"""Rings of polygons: segments, densification, decomposition into convex pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial
from .geometry import cross2

RING = ("scope_id", "polygon_id", "ring_id")
METRES_PER_DEGREE = 111319.49079327358
STEP, MOST_STEPS = 10.0, 100_000


def ring_segments(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Each ring point with its successor; the closing point (equal to the first) is left out first."""
    w = Window.partitionBy(*RING).orderBy("seq")
    last = Window.partitionBy(*RING)
    open_ = points.withColumn("_last", F.max("seq").over(last)).where(F.col("seq") < F.col("_last")).drop("_last")
    nxt = {f"next_{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(w)) for c in (x, y)}
    return open_.withColumns(nxt)


def lon_delta(a, b):
    """b - a in degrees, wrapped to [-180, 180]."""
    d = b - a
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def segment_metres(lon1, lat1, lon2, lat2):
    mid = F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(lon_delta(lon1, lon2) * mid * METRES_PER_DEGREE, (lat2 - lat1) * METRES_PER_DEGREE)


def _stepped(points: DataFrame, step: float) -> DataFrame:
    """Segments with their number of steps ``n`` and the most that a segment of their ring has."""
    n = F.greatest(F.lit(1), F.ceil(segment_metres(F.col("lon"), F.col("lat"), F.col("next_lon"), F.col("next_lat")) / step))
    return ring_segments(points, "lon", "lat").withColumn("n", n).withColumn("most", F.max("n").over(Window.partitionBy(*RING)))


def ring_densify(points: DataFrame, step: float = STEP) -> DataFrame:
    """Cuts segments into steps of at most ``step`` metres and keeps each step's start point.

    A ring with a segment of more than 100,000 steps is left out whole; ``ring_rejects`` names it.
    """
    s = _stepped(points, step).where(F.col("most") <= MOST_STEPS).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    t = F.col("i") / F.col("n")
    return s.select(*RING, "seq", "i", (F.col("lon") + lon_delta(F.col("lon"), F.col("next_lon")) * t).alias("lon"), (F.col("lat") + (F.col("next_lat") - F.col("lat")) * t).alias("lat"))


def ring_rejects(points: DataFrame, step: float = STEP) -> DataFrame:
    """A row for each segment that keeps its ring from being densified: the ring, seq, n and a code."""
    return _stepped(points, step).where(F.col("n") > MOST_STEPS).select(*RING, "seq", "n", F.lit("TOO_MANY_STEPS").alias("code"))


def ring_crossings(points: DataFrame, x: str = "x", y: str = "y", cell: float = 64.0) -> DataFrame:
    """A row for each pair of segments of a polygon that cross inside both: its rings with their seq, and a code.

    Segments meet on a grid of ``cell`` wide, wider ones on coarser grids, so segments that are far apart are never
    compared. Rings that touch in a corner or run along each other don't cross.
    """
    key = ["scope_id", "polygon_id"]
    s = ring_segments(points, x, y).where((F.col(x) != F.col(f"next_{x}")) | (F.col(y) != F.col(f"next_{y}")))
    s = s.select(F.struct(*key).alias("of"), F.struct("ring_id", "seq").alias("id"), F.col(x).alias("ax"), F.col(y).alias("ay"), F.col(f"next_{x}").alias("bx"), F.col(f"next_{y}").alias("by"))
    s = s.withColumns({"minx": F.least("ax", "bx"), "miny": F.least("ay", "by"), "maxx": F.greatest("ax", "bx"), "maxy": F.greatest("ay", "by")})
    other = s.withColumnsRenamed({c: f"{c}2" for c in ("id", "ax", "ay", "bx", "by")})
    pairs = spatial.box_overlap_join(s, other, "of", cell).where(F.col("id") < F.col("id2"))
    c = F.col
    side = lambda p, q, r: F.signum(cross2(c(p[0]), c(p[1]), c(q[0]), c(q[1]), c(r[0]), c(r[1])))
    a, b, a2, b2 = ("ax", "ay"), ("bx", "by"), ("ax2", "ay2"), ("bx2", "by2")
    crossing = (side(a, b, a2) * side(a, b, b2) < 0) & (side(a2, b2, a) * side(a2, b2, b) < 0)
    return pairs.where(crossing).select("of.*", "id.ring_id", "id.seq", F.col("id2.ring_id").alias("ring_id2"), F.col("id2.seq").alias("seq2"), F.lit("RINGS_CROSS").alias("code"))


def trapezoid_corners() -> Column:
    """Corners of a row of ``scope_decompose``, counter-clockwise; corners that coincide are one."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array_distinct(F.array(at("left_low", "y0"), at("right_low", "y0"), at("right_high", "y1"), at("left_high", "y1")))


def scope_decompose(points: DataFrame) -> DataFrame:
    """Trapezoids of the even-odd region of each polygon: scope, polygon, slab, pair, y0, y1 and x at all corners.

    Slabs lie between neighbouring vertex heights; within a slab the crossing segments, ordered by their middle,
    are paired. Pieces without height or width are dropped. Heights are numbered, and a segment is dealt to the numbers
    between its ends, so the work is that of the result: a ring of a million points in few directions is no harder a
    point than a square. Rings must not cross (``ring_crossings``).
    """
    key = ["scope_id", "polygon_id"]
    seg = ring_segments(points).where(F.col("y") != F.col("next_y"))
    up = F.col("y") < F.col("next_y")
    seg = seg.select(*key, "ring_id", "seq", F.least("y", "next_y").alias("ya"), F.greatest("y", "next_y").alias("yb"), F.when(up, F.col("x")).otherwise(F.col("next_x")).alias("xa"), F.when(up, F.col("next_x")).otherwise(F.col("x")).alias("xb"))
    w = Window.partitionBy(*key).orderBy("y0")
    heights = points.select(*key, F.col("y").alias("y0")).distinct().withColumn("y1", F.lead("y0").over(w)).withColumn("slab", F.row_number().over(w) - 1)
    slabs = heights.where("y1 is not null")
    seg = seg.join(heights.select(*key, F.col("y0").alias("ya"), F.col("slab").alias("_low")), [*key, "ya"]).join(heights.select(*key, F.col("y0").alias("yb"), F.col("slab").alias("_high")), [*key, "yb"])
    hit = seg.withColumn("slab", F.explode(F.sequence("_low", F.col("_high") - 1))).drop("_low", "_high").join(slabs, [*key, "slab"])
    at = lambda y: F.when(F.col(y) == F.col("ya"), F.col("xa")).when(F.col(y) == F.col("yb"), F.col("xb")).otherwise(F.col("xa") + (F.col("xb") - F.col("xa")) * (F.col(y) - F.col("ya")) / (F.col("yb") - F.col("ya")))
    hit = hit.withColumn("x_low", at("y0")).withColumn("x_high", at("y1"))
    order = Window.partitionBy(*key, "slab").orderBy(F.col("x_low") + F.col("x_high"), "ring_id", "seq")
    hit = hit.withColumn("rn", F.row_number().over(order) - 1)
    pair = hit.withColumn("pair", F.floor(F.col("rn") / 2)).groupBy(*key, "slab", "pair", "y0", "y1").agg(
        *[F.max(F.when(F.col("rn") % 2 == side, F.col(c))).alias(f"{name}_{c[2:]}") for side, name in ((0, "left"), (1, "right")) for c in ("x_low", "x_high")])
    return pair.where("right_low > left_low OR right_high > left_high")
