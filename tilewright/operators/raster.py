"""Texture coverage: UV triangles to pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

CLAMP, REPEAT, MIRROR = 33071, 10497, 33648
MOST_SPAN = 128
#: Pixels that a task looks at at once.
AT_ONCE = 262144


def uv_wrap_shifts(uses: DataFrame) -> DataFrame:
    """A row for each whole-number shift under which a repeated UV triangle can touch the image.

    Clamped axes are clamped to [0, 1] and not shifted. Uses with a span above 128 are left out; ``uv_rejects``
    names them.
    """
    for axis, wrap in (("u", "wrap_s"), ("v", "wrap_t")):
        cols = [f"{axis}{i}" for i in range(3)]
        for c in cols:
            uses = uses.withColumn(c, F.when(F.col(wrap) == CLAMP, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))).otherwise(F.col(c)))
        lo, hi = F.floor(F.least(*cols)), F.ceil(F.greatest(*cols))
        uses = uses.where((F.col(wrap) == CLAMP) | (hi - lo <= MOST_SPAN))
        uses = uses.withColumn(f"shift_{axis}", F.explode(F.when(F.col(wrap) == CLAMP, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(lo - 1, hi + 1))))
    return uses


def uv_rejects(uses: DataFrame) -> DataFrame:
    """The uses that repeat over too wide a span on an axis, with a code."""
    wide = F.lit(False)
    for axis, wrap in (("u", "wrap_s"), ("v", "wrap_t")):
        cols = [f"{axis}{i}" for i in range(3)]
        wide = wide | ((F.col(wrap) != CLAMP) & (F.ceil(F.greatest(*cols)) - F.floor(F.least(*cols)) > MOST_SPAN))
    return uses.where(wide).withColumn("code", F.lit("UV_SPAN_TOO_WIDE"))


def pixel_inside_or_near(px, py, tri):
    """Centre inside the triangle (zero signs count as inside) or within one pixel of an edge; NumPy arrays of one length.

    A corner that isn't a number (null) takes its two edges out.
    """
    pos, neg, near = True, True, False
    for (ax, ay), (bx, by) in zip(tri, (*tri[1:], tri[0])):
        dx, dy = bx - ax, by - ay
        side = dx * (py - ay) - dy * (px - ax)
        pos, neg = pos & (side >= 0), neg & (side <= 0)
        n = dx * dx + dy * dy
        t = np.where(n > 0, np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(n > 0, n, 1.0), 0.0, 1.0), 0.0)
        ex, ey = px - (ax + dx * t), py - (ay + dy * t)
        near = near | (ex * ex + ey * ey <= 1)
    return pos | neg | near


def uv_rasterize(uses: DataFrame, width: int = 16, height: int = 16) -> DataFrame:
    """(image, use_id, x, y) of every pixel that a use can touch; pixels stay in the task of their use."""
    return touched(uses, width, height).distinct()


def touched(uses: DataFrame, width: int, height: int) -> DataFrame:
    """Like ``uv_rasterize``, a pixel once for every shift under which a use touches it.

    The uses are dealt to tasks by their id, since thousands of them fit one file that a single task would read. Their
    number is given, or adaptive execution would join them again. Pixels are not shuffled here.
    """
    s = uv_wrap_shifts(uses.repartition(int(uses.sparkSession.conf.get("spark.sql.shuffle.partitions")), "use_id"))
    # The corners are generated, so that what computes them is not copied into every condition on a pixel.
    corners = [((F.col(f"u{i}") - F.col("shift_u")) * width, (F.col(f"v{i}") - F.col("shift_v")) * height) for i in range(3)]
    s = s.withColumn("_t", F.explode(F.array(F.struct(*[c.alias(f"{axis}{i}") for i, pair in enumerate(corners) for axis, c in zip("xy", pair)]))))
    tri = [(F.col(f"_t.x{i}"), F.col(f"_t.y{i}")) for i in range(3)]
    for k, (name, size) in enumerate((("x", width), ("y", height))):
        lo = F.greatest(F.lit(0).cast("long"), F.floor(F.least(*[t[k] for t in tri])) - 1)
        hi = F.least(F.lit(size - 1).cast("long"), F.ceil(F.greatest(*[t[k] for t in tri])) + 1)
        s = s.withColumn(f"_{name}0", lo).withColumn(f"_{name}1", hi)
    s = s.where("_x0 <= _x1 AND _y0 <= _y1").select("image", "use_id", "_x0", "_x1", "_y0", "_y1", "_t.*")
    schema = StructType([s.schema["image"], s.schema["use_id"]]).add("x", LongType()).add("y", LongType())
    return s.mapInArrow(_pixels, schema)


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pixels in the boxes of shifted uses that these touch, ``AT_ONCE`` of all boxes together at a time."""
    for b in batches:
        x0, x1, y0, y1 = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
        corners = [b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(6, 12)]
        wide = x1 - x0 + 1
        ends = np.cumsum(wide * (y1 - y0 + 1))
        starts = np.concatenate(([0], ends[:-1]))
        for start in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
            n = np.arange(start, min(start + AT_ONCE, int(ends[-1])))
            row = np.searchsorted(ends, n, side="right")
            dy, dx = np.divmod(n - starts[row], wide[row])
            x, y = x0[row] + dx, y0[row] + dy
            c = [v[row] for v in corners]
            hit = pixel_inside_or_near(x + 0.5, y + 0.5, list(zip(c[::2], c[1::2])))
            ids = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([b.column(0).take(ids), b.column(1).take(ids), pa.array(x[hit]), pa.array(y[hit])], names=["image", "use_id", "x", "y"])


# --- Masks as bitmaps ---------------------------------------------------------------------------------------------

#: Pixels that one row of a mask holds.
BUCKET = 32768


def mask_bitmaps(uses: DataFrame, width: int = 16, height: int = 16) -> DataFrame:
    """(image, bucket, bits): the pixels that any use of an image touches, numbered y * width + x, ``BUCKET`` a row.

    Tasks set bits as they find pixels, so what is shuffled is a bitmap an image, bucket and task, whatever the number
    of uses and of pixels. An image that no use touches has no row.
    """
    at = F.col("y") * width + F.col("x") + 1  # Spark's buckets start at 1
    bits = touched(uses, width, height).groupBy("image", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    return bits.withColumn("bucket", F.col("bucket") - 1)


def mask_or(masks: DataFrame) -> DataFrame:
    """One mask of several with the same images: their union."""
    return masks.groupBy("image", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def mask_sizes(masks: DataFrame) -> DataFrame:
    """(image, covered): the pixels of each mask."""
    return masks.groupBy("image").agg(F.sum(F.bitmap_count("bits")).alias("covered"))


def bit(bits, place):
    """Whether a bit of a mask's row is set; false for null."""
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")) % 2 == 1, F.lit(False))


def under_mask(pixels: DataFrame, masks: DataFrame, width: int = 16, name: str = "keep") -> DataFrame:
    """Adds to pixels (image, x, y, ...) whether the mask of their image covers them; an equi join by image and bucket."""
    n = F.col("y") * width + F.col("x")
    dealt = pixels.withColumns({"_n": n, "bucket": F.floor(n / BUCKET)})
    out = dealt.join(masks, ["image", "bucket"], "left")
    return out.withColumn(name, bit(F.col("bits"), F.col("_n") % BUCKET)).drop("_n", "bucket", "bits")


def apply_mask(pixels: DataFrame, masks: DataFrame, channels: list[str], width: int = 16) -> DataFrame:
    """The pixels with 0 in all channels where no use touches them."""
    out = under_mask(pixels, masks, width)
    return out.withColumns({c: F.when(F.col("keep"), F.col(c)).otherwise(0) for c in channels}).drop("keep")


def mask_leaks(pixels: DataFrame, masks: DataFrame, channels: list[str], width: int = 16) -> DataFrame:
    """Pixels that show something though the mask doesn't cover them: an output with any must not be written."""
    shown = F.lit(False)
    for c in channels:
        shown = shown | (F.col(c) != 0)
    return under_mask(pixels.where(shown), masks, width).where(~F.col("keep")).drop("keep")
