"""4x4 matrices as array<double>, column-major: element (row r, column c) at 4 * c + r."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
#: Smallest w that a point may be divided by, and shortest normal.
LEAST = 1e-15


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def valid(m: Column) -> Column:
    """16 finite elements; false for null."""
    return F.coalesce((F.size(m) == 16) & F.forall(m, finite), F.lit(False))


def multiply(a: Column, b: Column) -> Column:
    def element(k: int) -> Column:
        c, r = divmod(k, 4)
        return a[r] * b[4 * c] + a[4 + r] * b[4 * c + 1] + a[8 + r] * b[4 * c + 2] + a[12 + r] * b[4 * c + 3]

    return F.array(*[element(k) for k in range(16)])


def from_trs(t: Column, q: Column, s: Column) -> Column:
    """Translation, quaternion (x, y, z, w), scale to a matrix; null for a quaternion without length."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    x, y, z, w = (q[i] / n for i in range(4))
    rows = [
        (1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w)),
        (2 * (x * y - z * w), 1 - 2 * (x * x + z * z), 2 * (y * z + x * w)),
        (2 * (x * z + y * w), 2 * (y * z - x * w), 1 - 2 * (x * x + y * y)),
    ]
    zero = F.lit(0.0)
    elements = [e for k, row in enumerate(rows) for e in (*(v * s[k] for v in row), zero)]
    return F.when(n > LEAST, F.array(*elements, t[0], t[1], t[2], F.lit(1.0)))


def apply(m: Column, x: Column, y: Column, z: Column) -> Column:
    """The point as struct<x, y, z>; null where w is too small."""
    def row(r: int) -> Column:
        return m[r] * x + m[4 + r] * y + m[8 + r] * z + m[12 + r]

    w = row(3)
    return F.when(F.abs(w) > LEAST, F.struct((row(0) / w).alias("x"), (row(1) / w).alias("y"), (row(2) / w).alias("z")))


def up_axis(axis: Column) -> Column:
    """Matrix that turns the content's up axis to Z; null for an axis that isn't supported."""
    y_up = [1.0, 0, 0, 0, 0, 0, 1.0, 0, 0, -1.0, 0, 0, 0, 0, 0, 1.0]
    lit = lambda m: F.array(*[F.lit(float(v)) for v in m])
    return F.when(axis == "Y", lit(y_up)).when(axis == "Z", lit(IDENTITY))


def translation(x: Column, y: Column, z: Column) -> Column:
    one = [F.lit(float(v)) for v in IDENTITY[:12]]
    return F.array(*one, x, y, z, F.lit(1.0))


def normalised(x: Column, y: Column, z: Column) -> Column:
    n = F.sqrt(x * x + y * y + z * z)
    return F.when(n > LEAST, F.struct((x / n).alias("x"), (y / n).alias("y"), (z / n).alias("z")))
