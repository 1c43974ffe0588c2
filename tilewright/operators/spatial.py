"""Box-overlap join on a grid, and its exhaustive counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROW = 0.01
BOX = ("minx", "miny", "maxx", "maxy")


#: Stands for an unbounded box: wide enough for any place, still finite for the grid.
UNBOUNDED = 1e17


def grown(pieces: DataFrame, by: float = GROW) -> DataFrame:
    """The box of each convex counter-clockwise piece (``corners``) whose edges moved outward by a centimetre.

    Where two moved edges meet is further out the sharper the corner, so the box is taken from these meeting points,
    nudged outward so that rounding never loses a pair. Pieces with an edge without length or a corner without
    angle get an unbounded box: they meet everything of their key.
    """
    edge = "transform(corners, (a, i) -> named_struct('a', a, 'b', element_at(corners, CASE WHEN i = size(corners) - 1 THEN 1 ELSE i + 2 END)))"
    length = "sqrt((e.b.x - e.a.x) * (e.b.x - e.a.x) + (e.b.y - e.a.y) * (e.b.y - e.a.y))"
    outward = f"transform({edge}, e -> named_struct('x', try_divide(e.b.y - e.a.y, {length}), 'y', try_divide(e.a.x - e.b.x, {length})))"
    # A generated column is computed once; the optimizer would copy a plain one into every later use of the box.
    pieces = pieces.withColumn("_n", F.explode(F.array(F.expr(outward))))
    last = "element_at(_n, CASE WHEN i = 0 THEN size(_n) ELSE i END)"
    bend = f"(1 + {last}.x * _n[i].x + {last}.y * _n[i].y)"
    moved = f"transform(corners, (c, i) -> CASE WHEN {bend} > 1e-9 THEN named_struct('x', c.x + {by}D * ({last}.x + _n[i].x) / {bend}, 'y', c.y + {by}D * ({last}.y + _n[i].y) / {bend}) END)"
    pieces = pieces.withColumn("_m", F.explode(F.array(F.expr(moved))))
    whole = F.expr("size(_m) >= 3 AND NOT exists(_m, m -> m IS NULL)")
    out = []
    for axis in "xy":
        for name, pick, sign in ((f"min{axis}", F.array_min, -1), (f"max{axis}", F.array_max, 1)):
            v = pick(F.transform("_m", lambda m: m[axis]))  # noqa: B023
            out.append(F.when(whole, v + sign * (1e-9 + F.abs(v) * 1e-12)).otherwise(F.lit(sign * UNBOUNDED)).alias(name))
    pieces = pieces.withColumn("_b", F.explode(F.array(F.struct(*out))))
    return pieces.withColumns({c: F.col("_b")[c] for c in BOX}).drop("_n", "_m", "_b")


#: A box covers at most so many cells a side and one more; wider ones go to a coarser grid, each four times as wide as the one before.
SIDE, STEP = 4, 4
#: Coordinates beyond this are no places, and their cells no longer fit 64 bits.
FARTHEST = 1e18


def _levelled(df: DataFrame, cell: float) -> DataFrame:
    """Finite boxes with the level of the finest grid on which they cover few cells.

    The box is generated, so that what computes it is not copied into every condition on it, which made methods that
    are too long for the JVM's compiler.
    """
    df = df.withColumn("_box", F.explode(F.array(F.struct(*[F.col(c).cast("double").alias(c) for c in BOX])))).withColumns({c: F.col(f"_box.{c}") for c in BOX}).drop("_box")
    fine = F.lit(True)
    for c in BOX:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) <= FARTHEST)
    span = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(cell))
    return df.where(fine & (F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy"))).withColumn("level", F.greatest(F.lit(0), F.ceil(F.log(span / (SIDE * cell)) / F.log(F.lit(float(STEP))))).cast("int"))


def _cells(df: DataFrame, cell: float, levels: Column) -> DataFrame:
    """A row a cell on the box's own grid and on each coarser one whose bit is set in ``levels``."""
    df = df.withColumn("_levels", levels).withColumn("grid", F.explode(F.sequence("level", F.floor(F.log2("_levels")).cast("int"))))
    df = df.where(F.call_function("shiftright", F.col("_levels"), F.col("grid")) % 2 == 1).drop("_levels")
    size = F.lit(cell) * F.pow(F.lit(float(STEP)), F.col("grid"))
    df = df.withColumn("gx", F.explode(F.sequence(F.floor(F.col("minx") / size), F.floor(F.col("maxx") / size))))
    return df.withColumn("gy", F.explode(F.sequence(F.floor(F.col("miny") / size), F.floor(F.col("maxy") / size))))


def box_overlap_join(left: DataFrame, right: DataFrame, key: str, cell: float = 128.0) -> DataFrame:
    """Pairs of the same key whose boxes touch; box columns of the right side get the prefix p_.

    Both sides are dealt to grid cells and joined by (key, grid, cell): an equi join that shuffles and splits skew.
    Wide boxes live on coarser grids, so none covers many cells; a pair meets on the coarser one of its two grids,
    and there it is kept only in the cell of its overlap's lower corner, so no distinct is needed. Null, non-finite
    and empty boxes and those beyond ``FARTHEST`` never match.
    """
    l, r = _levelled(left, cell), _levelled(right, cell)
    # Which of the few dozen levels occur: one number, found within the query itself by a look at the boxes alone.
    both = l.select("level").unionByName(r.select("level"))
    levels = F.coalesce(both.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")))).scalar(), F.lit(1).cast("long"))
    r = _cells(r, cell, levels).withColumnsRenamed({**{c: f"p_{c}" for c in BOX}, "level": "p_level"})
    joined = _cells(l, cell, levels).join(r, [key, "grid", "gx", "gy"])
    touch = (F.col("minx") <= F.col("p_maxx")) & (F.col("p_minx") <= F.col("maxx")) & (F.col("miny") <= F.col("p_maxy")) & (F.col("p_miny") <= F.col("maxy"))
    size = F.lit(cell) * F.pow(F.lit(float(STEP)), F.col("grid"))
    home = (F.col("grid") == F.greatest("level", "p_level")) & (F.col("gx") == F.floor(F.greatest("minx", "p_minx") / size)) & (F.col("gy") == F.floor(F.greatest("miny", "p_miny") / size))
    return joined.where(touch & home).drop("grid", "gx", "gy", "level", "p_level")


def exhaustive_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every pair of the same key, whatever the boxes: the baseline of correctness."""
    return left.join(right.withColumnsRenamed({c: f"p_{c}" for c in BOX}), key)
