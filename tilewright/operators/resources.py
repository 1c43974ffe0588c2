"""Resources that surviving primitives still reach, and what they weigh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def texture_bytes(primitives: DataFrame, textures: DataFrame, images: DataFrame) -> DataFrame:
    """asset_id, texture_bytes_before, texture_bytes_after: every image once an asset, however many primitives reach it.

    ``primitives`` (asset_id, material, survives) reach images through ``textures`` (material, image), whose ``images``
    (image, bytes_before, bytes_after) weigh differently in the input and, masked, in the output. Before counts what any
    primitive reaches, after what a surviving one does. Assets without textured primitives have 0. Reached pairs of
    asset and image are made distinct before the sizes join, so hot materials shrink to a row an asset first.
    """
    used = primitives.groupBy("asset_id", "material").agg(F.max(F.col("survives").cast("int")).alias("survives"))
    reached = used.join(textures.select("material", "image").distinct(), "material").groupBy("asset_id", "image").agg(F.max("survives").alias("survives"))
    sums = reached.join(images, "image").groupBy("asset_id").agg(F.sum("bytes_before").alias("_b"), F.sum(F.when(F.col("survives") > 0, F.col("bytes_after"))).alias("_a"))
    out = primitives.select("asset_id").distinct().join(sums, "asset_id", "left")
    return out.select("asset_id", F.coalesce("_b", F.lit(0)).cast("long").alias("texture_bytes_before"), F.coalesce("_a", F.lit(0)).cast("long").alias("texture_bytes_after"))
