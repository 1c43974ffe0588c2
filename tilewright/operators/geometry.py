"""Planar clipping as column functions: a polygon is array<struct<x, y, z>>, a piece is convex and counter-clockwise."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A corner counts as inside up to a centimetre outside; smaller fragments (square metres) are dropped.
INSIDE, LEAST_AREA, FLAT = 0.01, 1e-8, 1e-15
POINT = "struct<x:double,y:double,z:double>"
#: A corner that carries more: ``p`` is interpolated along with the place, element by element.
CARRYING = "struct<x:double,y:double,z:double,p:array<double>>"


def cross2(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def ccw(polygon: Column) -> Column:
    """A triangle with its last two corners swapped if it runs clockwise."""
    a, b, c = polygon[0], polygon[1], polygon[2]
    return F.when(cross2(a["x"], a["y"], b["x"], b["y"], c["x"], c["y"]) < 0, F.array(a, c, b)).otherwise(polygon)


def signed_distance(px, py, ax, ay, bx, by) -> Column:
    """Metres from the line a-b, positive on its left."""
    return cross2(ax, ay, bx, by, px, py) / F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def rectangle(minx: str = "minx", miny: str = "miny", maxx: str = "maxx", maxy: str = "maxy") -> Column:
    """Corners of a box, counter-clockwise, as array<struct<x, y>>."""
    c = F.col
    return F.array(*[F.struct(c(x).alias("x"), c(y).alias("y")) for x, y in ((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy))])


def clip_by_lambdas(polygon: str, piece: str, point: str = POINT) -> Column:
    """``clip`` as a Spark expression, whose lambdas are interpreted: dear, but it takes whatever Spark does."""
    size = f"sqrt((e.b.x - e.a.x) * (e.b.x - e.a.x) + (e.b.y - e.a.y) * (e.b.y - e.a.y))"
    far = lambda p: f"(((e.b.x - e.a.x) * ({p}.y - e.a.y) - (e.b.y - e.a.y) * ({p}.x - e.a.x)) / {size})"
    t = "greatest(0D, least(1D, s.dq / (s.dq - s.dc)))"
    carried = f", 'p', zip_with(s.q.p, s.c.p, (a, b) -> a + (b - a) * {t})" if point == CARRYING else ""
    cut = f"array(named_struct('x', s.q.x + (s.c.x - s.q.x) * {t}, 'y', s.q.y + (s.c.y - s.q.y) * {t}, 'z', s.q.z + (s.c.z - s.q.z) * {t}{carried}))"
    none = f"cast(array() AS array<{point}>)"
    kept = f"CASE WHEN s.dc >= -{INSIDE}D THEN array(s.c) ELSE {none} END"
    step = f"""flatten(transform(transform(p, (c, i) -> named_struct('c', c, 'q', element_at(p, CASE WHEN i = 0 THEN size(p) ELSE i END), 'dc', {far('c')}, 'dq', {far('element_at(p, CASE WHEN i = 0 THEN size(p) ELSE i END)')})),
        s -> concat(CASE WHEN (s.dc >= -{INSIDE}D) <> (s.dq >= -{INSIDE}D) AND abs(s.dq - s.dc) > {FLAT}D THEN {cut} ELSE {none} END, {kept})))"""
    edges = f"transform({piece}, (a, i) -> named_struct('a', a, 'b', element_at({piece}, CASE WHEN i = size({piece}) - 1 THEN 1 ELSE i + 2 END)))"
    return F.expr(f"""aggregate({edges}, cast({polygon} AS array<{point}>), (p, e) -> cast(CASE WHEN size(p) < 3 THEN {none} ELSE {step} END AS array<{point}>), p -> CASE WHEN size(p) < 3 THEN {none} ELSE p END)""")


def _places(points: pa.Array, fields: tuple[str, ...]) -> np.ndarray:
    """Numbers of structs, a column a field; NaN for nulls."""
    columns = dict(zip([f.name for f in points.type], points.flatten(), strict=True))
    return np.stack([columns[f].to_numpy(zero_copy_only=False).astype("float64", copy=False) for f in fields], axis=1)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64")


def _padded(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Values of lists laid end to end as rows of equal width, zeros after each list's end."""
    out = np.zeros((len(sizes), int(sizes.max(initial=0)), *values.shape[1:]))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _clipped(polygons: pa.Array, pieces: pa.Array) -> pa.Array:
    """``clip`` of a batch of rows in NumPy; null for rows with nulls, numbers that are not finite or edges without length."""
    size, edges, corners, outline = _sizes(polygons), _sizes(pieces), polygons.flatten(), pieces.flatten()
    kind = polygons.type.value_type
    values, width = _places(corners, ("x", "y", "z")), 0
    if kind.num_fields > 3:
        lists = corners.flatten()[3]
        lengths = _sizes(lists)
        width = int(lengths.max(initial=0))
        carried = _padded(lists.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False), lengths)
        carried[lengths < width] = np.nan  # not as long as the others: not for this path
        values[lists.is_null().to_numpy(zero_copy_only=False)] = np.nan
        values = np.concatenate([values, carried], axis=1)
    v, piece = _padded(values, size), _padded(_places(outline, ("x", "y")), edges)
    plain = (size >= 3) & (edges >= 1) & np.isfinite(v).all(axis=(1, 2)) & np.isfinite(piece).all(axis=(1, 2))
    v, piece, count, edges = v[plain], piece[plain], size[plain], edges[plain]
    rows, well = np.arange(len(v)), np.ones(len(v), bool)
    for k in range(piece.shape[1] if len(v) else 0):
        on = k < edges
        a, b = piece[:, k], piece[rows, np.where(k + 1 < edges, k + 1, 0)]
        u = b - a
        length = np.sqrt(u[:, 0] * u[:, 0] + u[:, 1] * u[:, 1])
        there = np.arange(v.shape[1]) < count[:, None]
        far = (u[:, :1] * (v[:, :, 1] - a[:, 1:]) - u[:, 1:] * (v[:, :, 0] - a[:, :1])) / length[:, None]
        well &= ~on | np.isfinite(np.where(there, far, 0.0)).all(axis=1)
        before = np.where(np.arange(v.shape[1]) == 0, count[:, None] - 1, np.arange(v.shape[1]) - 1)
        far_before = far[rows[:, None], before]
        there &= ~on[:, None] | (count >= 3)[:, None]
        inside = far >= -INSIDE
        cut = there & on[:, None] & (inside != (far_before >= -INSIDE)) & (np.abs(far_before - far) > FLAT)
        kept = there & (inside | ~on[:, None])
        emitted = cut.astype("int64") + kept
        place, count = emitted.cumsum(axis=1) - emitted, emitted.sum(axis=1)
        out = np.zeros((len(v), int(count.max()), v.shape[2]))
        r, c = np.nonzero(cut)
        q, t = v[r, before[r, c]], far_before[r, c] / (far_before[r, c] - far[r, c])
        out[r, place[r, c]] = q + (v[r, c] - q) * np.clip(t, 0.0, 1.0)[:, None]
        r, c = np.nonzero(kept)
        out[r, place[r, c] + cut[r, c]] = v[r, c]
        v = out
    count = np.where(count >= 3, count, 0)
    flat = v[np.arange(v.shape[1]) < count[:, None]]
    columns = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)]
    if kind.num_fields > 3:
        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * width, pa.int32()), pa.array(flat[:, 3:].ravel())))
    sizes, known = np.zeros(len(size), "int64"), np.zeros(len(size), bool)
    sizes[plain], known[plain] = count, well
    starts = pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32())
    return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays(columns, ["x", "y", "z", "p"][: len(columns)]), mask=pa.array(~known))


def clip(polygon: str, piece: str, point: str = POINT) -> Column:
    """The part of ``polygon`` within ``piece``, edge by edge.

    A corner is inside at -1 cm or more, but cut points lie on the line itself; no cut where both corners are
    equally far. Under three corners end as an empty array. Heights are interpolated along, and so is ``p`` where
    corners are of type ``CARRYING``: the plane of the clip is x, y, whatever else a corner holds.

    Batches of rows are clipped in NumPy; what is not plain numbers is left to ``clip_by_lambdas``, which gives the same.
    """

    def clipped(polygons: pa.Array, pieces: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            return _clipped(polygons, pieces)

    outline = F.transform(F.expr(piece), lambda c: F.struct(c["x"].cast("double").alias("x"), c["y"].cast("double").alias("y")))
    fast = F.arrow_udf(clipped, f"array<{point}>")(F.expr(polygon).cast(f"array<{point}>"), outline)
    return F.coalesce(fast, clip_by_lambdas(polygon, piece, point))


def within(pairs: DataFrame, point: str = POINT) -> DataFrame:
    """Rows with ``poly`` and ``corners`` whose clip (``cut``) has an area left."""
    # A generated column is computed once; a plain one would be clipped in the condition on its size and once more after it.
    return pairs.withColumn("cut", F.explode(F.array(clip("poly", "corners", point)))).where(F.size("cut") >= 3)


def fan(polygon: str, point: str = POINT) -> Column:
    """Triangles (first, i, i + 1) of a convex polygon as array<array<point>>."""
    return F.expr(f"CASE WHEN size({polygon}) < 3 THEN cast(array() AS array<array<{point}>>) ELSE transform(sequence(2, size({polygon}) - 1), i -> array({polygon}[0], {polygon}[i - 1], {polygon}[i])) END")


def area3(triangle: str) -> Column:
    """Area in space, so that walls count."""
    u = [f"({triangle}[1].{a} - {triangle}[0].{a})" for a in "xyz"]
    v = [f"({triangle}[2].{a} - {triangle}[0].{a})" for a in "xyz"]
    parts = [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]
    return F.expr("0.5D * sqrt(" + " + ".join(f"{p} * {p}" for p in parts) + ")")


def with_polygon(tri: DataFrame) -> DataFrame:
    """Adds ``poly`` and the box of a triangle row with corners a, b, c and height h."""
    c = F.col
    poly = F.array(*[F.struct(c(x).alias("x"), c(y).alias("y"), z.alias("z")) for x, y, z in (("ax", "ay", c("h")), ("bx", "by_", c("h") + 1), ("cx", "cy", c("h") + 2))])
    box = {f: g(*p) for f, g, p in (("minx", F.least, ("ax", "bx", "cx")), ("miny", F.least, ("ay", "by_", "cy")), ("maxx", F.greatest, ("ax", "bx", "cx")), ("maxy", F.greatest, ("ay", "by_", "cy")))}
    return tri.withColumn("poly", ccw(poly)).withColumns(box)


def fragments(pairs: DataFrame, point: str = POINT) -> DataFrame:
    """Clips rows with ``poly`` and ``corners`` and fans the rest into fragments of more than the least area."""
    out = within(pairs, point).select("*", F.posexplode(fan("cut", point)).alias("frag_id", "frag")).withColumn("area", area3("frag"))
    return out.where(F.col("area") > LEAST_AREA)
