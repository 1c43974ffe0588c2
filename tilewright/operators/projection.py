"""Earth-centred to geodetic coordinates and to local metres on the GRS80 ellipsoid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

A, INVERSE_F = 6378137.0, 298.257222101
_F = 1 / INVERSE_F
B = A * (1 - _F)
E2 = _F * (2 - _F)
EP2 = E2 / (1 - E2)


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """lon and lat in degrees and height in metres, by Bowring's closed form."""
    p = F.sqrt(x * x + y * y)
    u = F.atan2(z * A, p * B)
    lat = F.atan2(z + EP2 * B * F.pow(F.sin(u), F.lit(3)), p - E2 * A * F.pow(F.cos(u), F.lit(3)))
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    height = p * F.cos(lat) + z * F.sin(lat) - A * A / n
    return {"lon": F.degrees(F.atan2(y, x)), "lat": F.degrees(lat), "height": height}


def _geodesic(lon: np.ndarray, lat: np.ndarray, lon0: np.ndarray, lat0: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverse geodesic with a fixed number of steps, and azimuthal-equidistant metres east and north of the centre."""
    u1, u2 = np.arctan((1 - _F) * np.tan(np.radians(lat0))), np.arctan((1 - _F) * np.tan(np.radians(lat)))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    difference = np.radians(lon - lon0)

    def at(m):
        sm, cm = np.sin(m), np.cos(m)
        east, north = c2 * sm, c1 * s2 - s1 * c2 * cm
        ss, cs = np.sqrt(east * east + north * north), s1 * s2 + c1 * c2 * cm
        same = ss == 0
        sa = c1 * c2 * sm / np.where(same, 1.0, ss)
        w = 1 - sa * sa
        middle = np.where(w == 0, 0.0, cs - 2 * s1 * s2 / np.where(w == 0, 1.0, w))
        return east, north, ss, cs, same, sa, np.arctan2(ss, cs), w, middle

    m = difference
    for _ in range(steps):
        _east, _north, ss, cs, same, sa, sg, w, middle = at(m)
        c = _F / 16 * w * (4 + _F * (4 - 3 * w))
        m = np.where(same, m, difference + (1 - c) * _F * sa * (sg + c * ss * (middle + c * cs * (-1 + 2 * middle * middle))))
    east, north, ss, cs, same, sa, sg, w, middle = at(m)
    q = w * EP2
    a, b = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))), q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
    d = B * a * (sg - b * ss * (middle + b / 4 * (cs * (-1 + 2 * middle * middle) - b / 6 * middle * (-3 + 4 * ss * ss) * (-3 + 4 * middle * middle))))
    azimuth = np.arctan2(east, north)
    return np.where(same, 0.0, d * np.sin(azimuth)), np.where(same, 0.0, d * np.cos(azimuth))


def local_project(lon: str, lat: str, lon0: str, lat0: str, steps: int = 6) -> Column:
    """struct<x, y>: metres east and north of (lon0, lat0); all arguments are SQL expressions in degrees.

    In NumPy, a batch of rows at a time: as a Spark expression it takes nested lambdas, which are interpreted. Both are
    null where an argument is.
    """

    def project(lon: pa.Array, lat: pa.Array, lon0: pa.Array, lat0: pa.Array) -> pa.Array:
        given = (lon, lat, lon0, lat0)
        missing = np.logical_or.reduce([a.is_null().to_numpy(zero_copy_only=False) for a in given])
        with np.errstate(all="ignore"):
            found = _geodesic(*[a.to_numpy(zero_copy_only=False).astype("float64", copy=False) for a in given], steps)
        return pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=missing) for v in found], ["x", "y"])

    return F.arrow_udf(project, "struct<x: double, y: double>")(*[F.expr(e).cast("double") for e in (lon, lat, lon0, lat0)])
