"""Leases over event streams: timers that expire them, and results that only count while their lease holds."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

DELAY = "10 minutes"
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "started long, last long, beats long"
LOST = "asset_id long, started timestamp, expired timestamp, heartbeats long"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that timers need; the one before is set again afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class LeaseTimer(StatefulProcessor):
    """One asset's open leases, disjoint spans of heartbeats less than ``gap_us`` apart, with one timer at the first end.

    Heartbeats may come in any order within the watermark's delay: one that reaches a span extends it, one that
    reaches two joins them, and one that reaches none opens another. A timer ends all spans that the watermark has
    passed, however many, and is set anew for the first that is left: each call to the state costs a round trip, so
    their number is that of an asset's batches, not of its spans.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def _timer(self, last: int) -> int:
        """Timers are in milliseconds, event time in microseconds."""
        return -(-(last + self.gap) // 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", STATE)

    def _open(self) -> list[tuple[int, int, int]]:
        return [tuple(int(x) for x in r) for r in self.spans.get()]

    def _keep(self, spans: list[tuple[int, int, int]]) -> None:
        self.spans.put(spans) if spans else self.spans.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        spans = self._open()
        old = min((self._timer(last) for _, last, _ in spans), default=None)
        for pdf in rows:
            times = pd.to_datetime(pdf["ts"]).astype("datetime64[us]").astype("int64")
            spans += [(t, t, 1) for t in times.tolist()]
        merged: list[tuple[int, int, int]] = []
        for start, last, n in sorted(spans):
            if merged and start - merged[-1][1] < self.gap:
                first, before, m = merged[-1]
                merged[-1] = (first, max(before, last), m + n)
            else:
                merged.append((start, last, n))
        self._keep(merged)
        new = min((self._timer(last) for _, last, _ in merged), default=None)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        yield from ()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        spans = self._open()
        over = [s for s in spans if self._timer(s[1]) <= now]
        left = [s for s in spans if self._timer(s[1]) > now]
        if over:
            self._keep(left)
        if left:
            self.handle.registerTimer(min(self._timer(last) for _, last, _ in left))
        if over:
            at = lambda us: np.array(us, "datetime64[us]")
            yield pd.DataFrame({"asset_id": [key[0]] * len(over), "started": at([s for s, _, _ in over]), "expired": at([e + self.gap for _, e, _ in over]), "heartbeats": [n for _, _, n in over]})

    def close(self) -> None:
        pass


def expired_leases(events: DataFrame, gap: str = "1 day", delay: str = DELAY) -> DataFrame:
    """asset_id, started, expired, heartbeats of leases for which no heartbeat came within ``gap``.

    A row appears once the watermark passes the end of its lease. Heartbeats later than ``delay`` are left out, those
    without asset or time never count. Needs ``timers`` and a session in UTC, since state holds microseconds of event time.
    """
    us = pd.Timedelta(gap) // pd.Timedelta(1, unit="us")
    beats = events.where("event = 'heartbeat' AND asset_id IS NOT NULL AND ts IS NOT NULL").select("asset_id", "ts").withWatermark("ts", delay)
    return beats.groupBy("asset_id").transformWithStateInPandas(LeaseTimer(us), StructType.fromDDL(LOST), outputMode="Append", timeMode="EventTime")


def guarded_results(events: DataFrame, gap: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Terminal events with what their lease makes of them: asset_id, event_id, finished, outcome.

    A success counts as READY only if a heartbeat of its asset stands at most ``gap`` before it; else the lease had
    failed and the outcome is LEASE_LOST, however well the clip went. Failures stay FAILED. The stream-stream outer
    join gives a lost one once the watermark has passed every heartbeat that could have saved it.
    """
    done = events.where("event IN ('succeeded', 'failed') AND asset_id IS NOT NULL").select("asset_id", "event_id", "event", F.col("ts").alias("finished")).withWatermark("finished", delay)
    beats = events.where("event IN ('heartbeat', 'claimed')").select(F.col("asset_id").alias("asset"), F.col("ts").alias("beat")).withWatermark("beat", delay)
    near = (F.col("asset_id") == F.col("asset")) & (F.col("beat") <= F.col("finished")) & (F.col("beat") >= F.col("finished") - F.expr(f"INTERVAL {gap}"))
    both = done.join(beats, near, "left_outer")
    outcome = F.when(F.col("event") == "failed", "FAILED").when(F.col("beat").isNull(), "LEASE_LOST").otherwise("READY")
    return both.select("asset_id", "event_id", "finished", outcome.alias("outcome"))
