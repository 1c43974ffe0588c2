"""Quantiles of large groups: exact by distributed ranks, and by sketches of a stated error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float], stored) -> DataFrame:
    """group and a column for each share (name -> 0 to 1), interpolated between neighbours; null values don't count.

    Equal values are counted first, so a hot value is one row. The distinct ones are dealt to ranges, each range is
    ranked by itself and starts where those before it end: no group meets in one task, and neither do its values.
    ``stored`` (writes and reads a DataFrame) fixes the ranges.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = stored(counts.repartitionByRange("_v").withColumn("_range", F.spark_partition_id()))
    # A row a group and range.
    sizes = dealt.groupBy(group, "_range").agg(F.sum("_n").alias("_size"))
    by = Window.partitionBy(group).orderBy("_range")
    starts = sizes.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), (F.sum("_size").over(by) - F.col("_size")).alias("_start"), F.sum("_size").over(Window.partitionBy(group)).alias("_total"))
    within = Window.partitionBy(group, "_range").orderBy("_v")
    ranked = dealt.withColumn("_upto", F.sum("_n").over(within)).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    last = F.col("_start") + F.col("_upto") - 1  # ranks from 0
    first = last - F.col("_n") + 1
    picked = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_total") - 1)
        for side, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            picked.append(F.max(F.when((first <= rank) & (rank <= last), F.col("_v"))).alias(f"_{name}_{side}"))
        picked.append(F.max(at - F.floor(at)).alias(f"_{name}_t"))
    out = ranked.groupBy(group).agg(*picked)
    return out.select(group, *[(F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_t")).alias(n) for n in shares])


def sketched_quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float], accuracy: int = 1000) -> DataFrame:
    """The same from a mergeable sketch a group and task: one shuffle of sketches, ranks off by at most n / ``accuracy``."""
    found = df.groupBy(group).agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(s) for s in shares.values()]), F.lit(accuracy)).alias("_q"))
    return found.select(group, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(shares)])
