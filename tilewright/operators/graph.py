"""Trees of scene nodes: reachability with transforms, faults, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def node_world(nodes: DataFrame, combine, root, most_levels: int = 200, stored=None) -> DataFrame:
    """Walks from the roots (null parent) level by level: node_id, level and ``world``.

    ``root`` is the world value of a root, ``combine(parent world)`` that of a child; both are column expressions over
    the node's columns. One equi join a level, so a level of any width is distributed. ``stored`` cuts
    lineage (a function that writes and reads a DataFrame); levels beyond ``most_levels`` are an error.
    """
    level = nodes.where("parent_id IS NULL").withColumn("world", root).withColumn("level", F.lit(0))
    found = level
    for k in range(1, most_levels + 1):
        up = level.select(F.col("node_id").alias("parent_id"), F.col("world").alias("_up"))
        level = nodes.join(up, "parent_id").withColumn("world", combine(F.col("_up"))).withColumn("level", F.lit(k)).select(*found.columns)
        if stored:
            level = stored(level)
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise ValueError(f"more than {most_levels} levels")


def composed_to_root(nodes: DataFrame, value, combine, stored) -> DataFrame:
    """node_id, level and ``world``: the values from the root down to each node combined, in log2 of the depth rounds.

    ``value`` is each node's own (a column expression), ``combine(upper, lower)`` must be associative. A node starts with
    its parent as goal; every round it takes on what its goal has gathered and that one's goal, so paths double. Nodes
    that no root leads to (cycles, parents that aren't there) are left out; depth is not limited. ``stored`` (writes and
    reads a DataFrame) keeps each round.
    """
    state = stored(nodes.select("node_id", F.col("parent_id").alias("goal"), value.alias("world"), F.lit(0).alias("level")))
    left = None
    while True:
        open_, done = state.where("goal IS NOT NULL"), state.where("goal IS NULL")
        before, left = left, open_.count()
        # Every depth up to the greatest occurs, so a round that reaches no root leaves only what none leads to.
        if not left or left == before:
            return done.select("node_id", "level", "world")
        up = state.select(F.col("node_id").alias("goal"), F.col("goal").alias("_goal"), F.col("world").alias("_world"), F.col("level").alias("_level"))
        further = open_.join(up, "goal").select("node_id", F.col("_goal").alias("goal"), combine(F.col("_world"), F.col("world")).alias("world"), (F.col("level") + F.col("_level") + 1).alias("level"))
        state = stored(done.unionByName(further))


def node_prune(nodes: DataFrame, keep: DataFrame, most_levels: int = 200, stored=None) -> DataFrame:
    """Nodes with a kept descendant or kept themselves (``keep``: node_id). Levels beyond ``most_levels`` are an error."""
    level = keep.select("node_id").distinct()
    kept = level
    for _ in range(most_levels):
        up = nodes.join(level, "node_id", "left_semi").where("parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id")).distinct()
        level = up.join(kept, "node_id", "left_anti")
        if stored:
            level = stored(level)
        if level.isEmpty():
            return nodes.join(kept, "node_id", "left_semi")
        kept = kept.unionByName(level)
    raise ValueError(f"more than {most_levels} levels")


def unreached(edges: DataFrame, most_levels: int = 200, stored=None) -> DataFrame:
    """Nodes (node_id) that no root leads to: those on a cycle of any length and what hangs on one.

    Roots are the parents that are nobody's child. One equi join a level; levels beyond ``most_levels`` are an error.
    """
    edges = edges.where("node_id IS NOT NULL AND parent_id IS NOT NULL").select("node_id", "parent_id").distinct()
    if stored:
        edges = stored(edges)
    nodes = edges.select("node_id").distinct()
    level = edges.select(F.col("parent_id").alias("node_id")).distinct().join(nodes, "node_id", "left_anti")
    if stored:
        level = stored(level)
    found = level
    for _ in range(most_levels):
        down = edges.join(level.withColumnRenamed("node_id", "parent_id"), "parent_id", "left_semi").select("node_id").distinct()
        level = down.join(found, "node_id", "left_anti")
        if stored:
            level = stored(level)
        if level.isEmpty():
            return nodes.join(found, "node_id", "left_anti")
        found = found.unionByName(level)
    raise ValueError(f"more than {most_levels} levels")


def dense_ids(df: DataFrame, order: str, stored, name: str = "new_index") -> DataFrame:
    """All rows numbered from 0 by a column, without gathering them: ranges are numbered apart and start where those before end.

    ``stored`` fixes the ranges (a function that writes and reads a DataFrame). One row a range meets in one task.
    """
    dealt = stored(df.repartitionByRange(F.col(order)).withColumn("range", F.spark_partition_id()))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    starts = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))
    ranked = dealt.withColumn(name, F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1)
    return ranked.join(F.broadcast(starts), "range").withColumn(name, F.col(name) + F.col("start")).drop("range", "start")


def dense_reindex(df: DataFrame, group: list[str], order: str, name: str = "new_index") -> DataFrame:
    """Survivors of each group numbered from 0 in source order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1)
