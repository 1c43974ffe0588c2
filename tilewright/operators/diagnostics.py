"""Diagnostics that a scan gives on the way, whatever later rules do with its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Diagnostics:
    """Named observations of one job. ``watch`` puts one where it stands in the plan; values are there once the job has run.

    An observer sits on the rows that pass it: one on the scan also counts what a rule behind it rejects, one behind
    the last rule counts only what was processed to the end. It takes no pass of its own.
    """

    def __init__(self) -> None:
        self._observed: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, **metrics: Column) -> DataFrame:
        if name in self._observed:
            raise ValueError(f"{name} is watched already")
        self._observed[name] = Observation(name)
        return df.observe(self._observed[name], *[m.alias(k) for k, m in metrics.items()])

    def values(self) -> dict[str, dict]:
        """All metrics by observer; waits for the job that evaluates them."""
        return {name: o.get for name, o in self._observed.items()}

    def as_rows(self, spark) -> DataFrame:
        """observer, metric, value: one row a metric."""
        rows = [(name, metric, int(value or 0)) for name, found in self.values().items() for metric, value in found.items()]
        return spark.createDataFrame(rows, "observer string, metric string, value long")


def sampler_metrics() -> dict[str, Column]:
    """How many samplers name the unused third axis, and how many of them wrap there by an unknown mode."""
    named = F.col("wrap_r").isNotNull()
    return {"seen": F.count(F.lit(1)), "third_axis": F.count_if(named), "unknown_mode": F.count_if(named & ~F.col("wrap_r").isin(33071, 33648, 10497))}
