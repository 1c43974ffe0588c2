"""Meshes in their tiles: vertices to the plane of the scope, triangles with payload, fragments back in local coordinates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import geometry, matrices, projection


def east_north_up(lon: float, lat: float, height: float = 0.0) -> list[float]:
    """Matrix (column-major) from metres east, north and up of a place to earth-centred coordinates."""
    a, b = math.radians(lon), math.radians(lat)
    n = projection.A / math.sqrt(1 - projection.E2 * math.sin(b) ** 2)
    east = (-math.sin(a), math.cos(a), 0.0, 0.0)
    north = (-math.sin(b) * math.cos(a), -math.sin(b) * math.sin(a), math.cos(b), 0.0)
    up = (math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b), 0.0)
    origin = ((n + height) * up[0], (n + height) * up[1], (n * (1 - projection.E2) + height) * up[2], 1.0)
    return [*east, *north, *up, *origin]


def projected(vertices: DataFrame, world: str, lon0: str, lat0: str, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Adds ``px``, ``py`` (metres east and north of the centre) and ``ph`` (ellipsoidal height) to vertices with a matrix ``world``.

    ``lon0`` and ``lat0`` are SQL expressions in degrees. Vertices whose w vanishes have nulls. Do this once a vertex,
    before triangles gather their corners.
    """
    out = vertices.withColumn("_e", matrices.apply(F.col(world), F.col(x), F.col(y), F.col(z)))
    geo = projection.ecef_to_geodetic(F.col("_e.x"), F.col("_e.y"), F.col("_e.z"))
    out = out.withColumns({"_lon": geo["lon"], "_lat": geo["lat"], "ph": geo["height"]})
    out = out.withColumn("_p", projection.local_project("_lon", "_lat", lon0, lat0))
    return out.withColumns({"px": F.col("_p.x"), "py": F.col("_p.y")}).drop("_e", "_lon", "_lat", "_p")


def triangles(vertices: DataFrame, index: DataFrame, key: list[str], tri: str = "tri_id", vid: str = "vid", payload: str = "payload") -> DataFrame:
    """key, tri, ``poly`` (three corners of type ``geometry.CARRYING``) and its box, from projected vertices.

    ``index`` has columns i0, i1, i2 of vertex numbers; a corner carries the local x, y, z and then the payload. A
    triangle with a vertex that isn't there, or that could not be projected, is left out.
    """
    corners = index.select(*key, tri, F.posexplode(F.array("i0", "i1", "i2")).alias("corner", vid))
    point = F.struct(F.col("px").alias("x"), F.col("py").alias("y"), F.col("ph").alias("z"), F.concat(F.array("x", "y", "z"), F.col(payload)).alias("p"))
    joined = corners.join(vertices.select(*key, vid, point.alias("point")), [*key, vid])
    # Three rows a triangle, side by side: lists gathered by an aggregate are sorted on both sides of the shuffle.
    w = Window.partitionBy(*key, tri).orderBy("corner")
    c = F.struct("corner", "point")
    beside = joined.select(*key, tri, "corner", "point", F.lag("corner").over(w).alias("_before"), F.lead(c).over(w).alias("_b"), F.lead(c, 2).over(w).alias("_c"), F.lead("corner", 3).over(w).alias("_after"))
    whole = beside.where("_before IS NULL AND _after IS NULL AND corner = 0 AND _b.corner = 1 AND _c.corner = 2")
    # Looked at only here: a filter on vertices would be pushed below their projection, which would then run twice.
    whole = whole.where(" AND ".join(f"{v}.{axis} IS NOT NULL" for v in ("point", "_b.point", "_c.point") for axis in "xyz"))
    box = {f"{name}{axis}": pick(*[f"{v}.{axis}" for v in ("point", "_b.point", "_c.point")]) for axis in "xy" for name, pick in (("min", F.least), ("max", F.greatest))}
    return whole.select(*key, tri, F.array("point", "_b.point", "_c.point").alias("poly"), *[box[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")])


def _written(fragments: pa.Array, normal: int | None) -> pa.Array:
    """``local_corners`` of a batch of rows, in NumPy."""
    per_row = pc.fill_null(pc.list_value_length(fragments), 0).to_numpy(zero_copy_only=False).astype("int64")
    carried = fragments.flatten().flatten()[3]
    lengths, numbers = pc.list_value_length(carried), carried.flatten()
    lost, lengths = carried.is_null().to_numpy(zero_copy_only=False), pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype("int64")
    ends = lengths.cumsum()
    values, missing = numbers.to_numpy(zero_copy_only=False).astype("float64"), numbers.is_null().to_numpy(zero_copy_only=False)
    if normal is not None:
        lost = lost | (lengths < normal + 3)
        at = (ends - lengths)[~lost, None] + np.arange(normal, normal + 3)
        n = values[at]
        length = np.sqrt(n[:, 0] * n[:, 0] + n[:, 1] * n[:, 1] + n[:, 2] * n[:, 2])
        lost[~lost] = missing[at].any(axis=1) | (length <= matrices.LEAST)
        values[at] = n / length[:, None]
    rows = np.repeat(np.arange(len(per_row)), per_row)
    unknown = fragments.is_null().to_numpy(zero_copy_only=False) | (np.bincount(rows[lost], minlength=len(per_row)) > 0)
    flat = pa.array(values.astype("float32"), pa.float32(), mask=missing)
    corners = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], per_row.cumsum()]), pa.int32()), corners, mask=pa.array(unknown))


def local_corners(fragment: Column, normal: int | None = None) -> Column:
    """A fragment's corners as they are written: array of arrays of float32, local x, y, z and then the payload.

    ``normal`` is where in ``p`` a normal stands; it gets length 1 again. Null where it has none left.
    """

    def written(fragments: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            return _written(fragments, normal)

    return F.arrow_udf(written, "array<array<float>>")(fragment.cast(f"array<{geometry.CARRYING}>"))
