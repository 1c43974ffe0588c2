"""Quantiles of skewed groups, observers before and behind rules, bytes of shared images, masks of large images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions.storage import stored
from tilewright.operators import diagnostics, quantiles, raster, resources


def test_quantiles_of_a_skewed_group(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in np.where(rng.random(20_000) < 0.6, 7.0, rng.lognormal(3, 2, 20_000))] + [("few", v) for v in (1.0, 2.0, 4.0)] + [("one", 5.0), ("none", None), (None, 3.0), ("hot", None)]
    df = spark.createDataFrame(rows, "stage string, ms double").repartition(7)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.stage: [r[n] for n in shares] for r in quantiles.exact_quantiles(df, "stage", "ms", shares, stored).collect()}
    hot = np.array([v for s, v in rows if s == "hot" and v is not None])
    assert got["hot"] == pytest.approx([float(np.quantile(hot, q)) for q in shares.values()])
    assert got["few"] == pytest.approx([1, 2, 3.8, 4]) and got["one"] == [5] * 4 and got[None] == [3] * 4 and "none" not in got
    near = {r.stage: r for r in quantiles.sketched_quantiles(df, "stage", "ms", shares, 200).collect()}["hot"]
    for name, q in shares.items():
        assert (hot < near[name]).sum() <= (q + 1 / 200) * len(hot) + 1 and (hot <= near[name]).sum() >= (q - 1 / 200) * len(hot) - 1


def test_observers_see_what_a_later_rule_rejects(spark):
    rows = spark.createDataFrame([(1, 33071), (2, None), (3, -1), (4, 10497)], "tile long, wrap_r long")
    seen = diagnostics.Diagnostics()
    scan = seen.watch(rows, "scan", **diagnostics.sampler_metrics())
    nothing = seen.watch(scan.where("tile > 100"), "processed", tiles=F.count(F.lit(1)))
    assert nothing.collect() == []
    assert seen.values() == {"scan": {"seen": 4, "third_axis": 3, "unknown_mode": 1}, "processed": {"tiles": 0}}
    with pytest.raises(ValueError):
        seen.watch(rows, "scan", n=F.count(F.lit(1)))


def test_images_weigh_once_an_asset(spark):
    primitives = spark.createDataFrame([(1, 10, 0), (1, 10, 1), (1, 11, 0), (1, 12, 1), (2, 11, 0), (3, 99, 1)], "asset_id long, material long, survives int")
    textures = spark.createDataFrame([(10, 5), (12, 5), (11, 6), (10, 5), (12, 7)], "material long, image long")
    images = spark.createDataFrame([(5, 100, 40), (6, 1000, 400)], "image long, bytes_before long, bytes_after long")
    assert sorted(tuple(r) for r in resources.texture_bytes(primitives, textures, images).collect()) == [(1, 1100, 40), (2, 1000, 0), (3, 0, 0)]


def test_masks_of_an_image_of_many_buckets(spark):
    """A 300 x 300 image takes three rows; bits, union, application and leaks agree with its pixels."""
    use = "image long, use_id long, wrap_s int, wrap_t int, u0 double, v0 double, u1 double, v1 double, u2 double, v2 double"
    uses = spark.createDataFrame([(1, 1, 33071, 33071, 0.1, 0.1, 0.9, 0.2, 0.5, 0.95), (1, 2, 10497, 10497, 1.7, 0.5, 2.1, 0.6, 1.9, 0.9), (2, 3, 33071, 33071, 0.0, 0.0, 0.01, 0.0, 0.0, 0.01)], use)
    want = {(r.image, r.x, r.y) for r in raster.uv_rasterize(uses, 300, 300).select("image", "x", "y").distinct().collect()}
    masks = raster.mask_or(raster.mask_bitmaps(uses.where("use_id = 1"), 300, 300).unionByName(raster.mask_bitmaps(uses.where("use_id > 1"), 300, 300)))
    assert masks.where("image = 1").count() == 3
    assert {r.image: r.covered for r in raster.mask_sizes(masks).collect()} == {i: sum(k[0] == i for k in want) for i in (1, 2)}
    pixels = spark.range(3 * 90_000).select((F.floor(F.col("id") / 90_000) + 1).alias("image"), (F.col("id") % 300).alias("x"), F.floor(F.col("id") % 90_000 / 300).alias("y"), F.lit(9).alias("r"), F.lit(0).alias("g"))
    out = raster.apply_mask(pixels, masks, ["r", "g"], 300)
    assert {(r.image, r.x, r.y) for r in out.where("r = 9").collect()} == want and out.count() == 270_000
    assert raster.mask_leaks(out, masks, ["r", "g"], 300).count() == 0
    leaky = out.withColumn("g", F.when((F.col("x") == 299) & (F.col("y") == 299), 1).otherwise(F.col("g")))
    assert sorted(r.image for r in raster.mask_leaks(leaky, masks, ["r", "g"], 300).collect()) == [1, 2, 3]
