"""The streaming jobs over the supplied tables, run to the end of the source, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import geometry, spatial
from tilewright.sources.derived import DERIVED, derived
from tilewright.streaming import jobs, leases

from . import composed


def _stream(spark: SparkSession, sf_dir: str, base: str, name: str) -> DataFrame:
    """Derived table ``name`` over the stream of its base table."""
    jobs.table_stream(spark, sf_dir, base).createOrReplaceTempView(f"{base}_stream")
    return spark.sql(DERIVED[name].replace(f"FROM {base}", f"FROM {base}_stream"))


def _events(spark, sf_dir):
    """Event time is a timestamp in the session's time zone; results give the tables' own zone-less times again."""
    return _stream(spark, sf_dir, "events", "task_event").withColumn("ts", F.col("ts").cast("timestamp"))


def _zoneless(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def stream_version_gate(spark, sf_dir):
    return jobs.run_available(jobs.version_gate(_stream(spark, sf_dir, "orders", "task")).select("task_id")).select("task_id")


def stream_throughput(spark, sf_dir):
    return _zoneless(jobs.latest(jobs.run_available(jobs.throughput(_events(spark, sf_dir)), "update"), "minute"), "minute")


def stream_terminal_dedup(spark, sf_dir):
    """Every event is delivered twice; the sink keeps an asset's last terminal event."""
    e = _events(spark, sf_dir).select("event_id", "asset_id", "event", "ts")
    once = jobs.run_available(jobs.terminal_once(e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")))
    last = F.max_by(F.struct("event_id", "event"), F.struct("ts", "event_id")).alias("v")
    return once.groupBy("asset_id").agg(F.count("*").alias("outcomes"), last).select("asset_id", "outcomes", "v.event_id", "v.event")


def stream_lease_timeout(spark, sf_dir):
    """Leases ended by event-time timers over state."""
    with leases.timers(spark):
        lost = jobs.run_available(leases.expired_leases(_events(spark, sf_dir), jobs.LEASE_GAP))
    return _zoneless(lost.drop("batch"), "started", "expired")


def stream_lease_sessions(spark, sf_dir):
    """The same leases by session windows, without Python state."""
    return _zoneless(jobs.run_available(jobs.lost_leases(_events(spark, sf_dir))).drop("batch"), "started", "expired")


def stream_lease_guard(spark, sf_dir):
    """Successes whose lease had failed don't count; a pair a heartbeat is joined, a result is kept once."""
    rows = jobs.run_available(leases.guarded_results(_events(spark, sf_dir), jobs.LEASE_GAP))
    return _zoneless(rows.drop("batch").dropDuplicates(["event_id"]), "finished").select("asset_id", "event_id", "finished", "outcome")


def stream_worker_sessions(spark, sf_dir):
    return _zoneless(jobs.run_available(jobs.sessions(_events(spark, sf_dir), "worker_id", jobs.IDLE_GAP)).drop("batch"), "started", "ended")


def stream_stage_pairs(spark, sf_dir):
    return jobs.run_available(jobs.stage_pairs(_events(spark, sf_dir))).drop("batch")


def stream_clip_intake(spark, sf_dir):
    """Triangles arrive as a stream; each micro-batch is clipped, and an asset is READY once any batch left something."""
    pieces = spatial.grown(derived(spark, sf_dir, "piece").withColumn("corners", geometry.rectangle()))

    def clip(rows: DataFrame) -> DataFrame:
        kept = geometry.fragments(spatial.box_overlap_join(geometry.with_polygon(rows), pieces, "scope_id")).groupBy("asset_id").agg(F.count("*").alias("n"))
        return rows.groupBy("asset_id").agg(F.count("*").alias("arrived")).join(kept, "asset_id", "left").select("asset_id", "arrived", F.coalesce("n", F.lit(0)).alias("n"))

    done = jobs.run_available(_stream(spark, sf_dir, "orders", "tri"), each=clip)
    out = done.groupBy("asset_id").agg(F.sum("arrived").alias("arrived"), F.sum("n").alias("fragments"))
    return out.select("asset_id", F.when(F.col("fragments") > 0, "READY").otherwise("EMPTY").alias("result"), "arrived", "fragments")


QUERIES = {f.__name__: f for f in (stream_clip_intake, stream_terminal_dedup, stream_lease_timeout, stream_lease_sessions, stream_lease_guard, stream_throughput, stream_worker_sessions, stream_stage_pairs, stream_version_gate)}


def _sessions_sql(key: str, keep: str, days: str, ended: str, counted: str) -> str:
    """Runs of neighbours closer than the gap, among those that the watermark has passed."""
    return f"""SELECT {key}, started, {ended}, {counted} FROM (SELECT {key}, min(ts) AS started, max(ts) + INTERVAL {days} AS {ended}, count(*) AS {counted} FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) + INTERVAL {days} THEN 0 ELSE 1 END AS fresh FROM task_event WHERE {keep}) a) b
        GROUP BY {key}, run) c WHERE {ended} <= (SELECT max(ts) - INTERVAL {jobs.DELAY} FROM task_event WHERE {keep})"""


ORACLE_SQL = {
    "stream_version_gate": "SELECT task_id FROM task WHERE algorithm_version = 'v8'",
    "stream_throughput": "SELECT date_trunc('minute', ts) AS minute, count(*) FILTER (WHERE event = 'succeeded') AS succeeded, count(*) FILTER (WHERE event = 'failed') AS failed FROM task_event WHERE event IN ('succeeded', 'failed') GROUP BY date_trunc('minute', ts)",
    "stream_terminal_dedup": "SELECT asset_id, outcomes, event_id, event FROM (SELECT *, count(*) OVER (PARTITION BY asset_id) AS outcomes, row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, event_id DESC) AS rn FROM task_event WHERE event IN ('succeeded', 'failed')) x WHERE rn = 1",
    "stream_lease_timeout": _sessions_sql("asset_id", "event = 'heartbeat'", jobs.LEASE_GAP, "expired", "heartbeats"),
    "stream_lease_sessions": _sessions_sql("asset_id", "event = 'heartbeat'", jobs.LEASE_GAP, "expired", "heartbeats"),
    "stream_lease_guard": f"""SELECT asset_id, event_id, finished, outcome FROM (SELECT d.asset_id, d.event_id, d.ts AS finished, CASE WHEN d.event = 'failed' THEN 'FAILED' WHEN EXISTS (SELECT 1 FROM task_event b WHERE b.asset_id = d.asset_id AND b.event IN ('heartbeat', 'claimed') AND b.ts <= d.ts AND b.ts >= d.ts - INTERVAL {jobs.LEASE_GAP}) THEN 'READY' ELSE 'LEASE_LOST' END AS outcome,
        EXISTS (SELECT 1 FROM task_event b WHERE b.asset_id = d.asset_id AND b.event IN ('heartbeat', 'claimed') AND b.ts <= d.ts AND b.ts >= d.ts - INTERVAL {jobs.LEASE_GAP}) AS met FROM task_event d WHERE d.event IN ('succeeded', 'failed')) x
        WHERE met OR finished < least((SELECT max(ts) FROM task_event WHERE event IN ('succeeded', 'failed')), (SELECT max(ts) FROM task_event WHERE event IN ('heartbeat', 'claimed'))) - INTERVAL {jobs.DELAY}""",
    "stream_worker_sessions": _sessions_sql("worker_id", "1 = 1", jobs.IDLE_GAP, "ended", "events"),
    "stream_stage_pairs": f"SELECT a.asset_id, a.event_id AS claim_id, b.event_id AS end_id FROM task_event a JOIN task_event b ON a.asset_id = b.asset_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {jobs.PAIR_WITHIN} WHERE a.event = 'claimed' AND b.event IN ('succeeded', 'failed')",
    "stream_clip_intake": composed._CLIP + "SELECT t.asset_id, CASE WHEN coalesce(n, 0) > 0 THEN 'READY' ELSE 'EMPTY' END AS result, t.arrived, coalesce(n, 0) AS fragments FROM (SELECT asset_id, count(*) AS arrived FROM tri GROUP BY asset_id) t LEFT JOIN (SELECT asset_id, count(*) AS n FROM frags WHERE area > 1e-8 GROUP BY asset_id) f ON t.asset_id = f.asset_id",
}
