"""Lease timers over several micro-batches: late, unordered and restarted input, and results whose lease had failed."""

import datetime

import pytest

from tilewright.streaming import jobs, leases

SCHEMA = "event_id long, asset_id long, ts timestamp, event string"
ZERO = datetime.datetime(2026, 1, 1)


def at(minutes):
    return ZERO + datetime.timedelta(minutes=minutes)


def add(spark, src, rows):
    spark.createDataFrame([(i, a, at(m), e) for i, a, m, e in rows], SCHEMA).coalesce(1).write.mode("append").parquet(src)


def run(spark, src, out, job, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    with leases.timers(spark):
        return jobs.run_available(job(stream, **more), where=f"file://{out}", name="job")


def spans(rows):
    minutes = lambda t: round((t - ZERO).total_seconds() / 60)
    return sorted((r.asset_id, minutes(r.started), minutes(r.expired), r.heartbeats) for r in rows.collect())


def test_timers_fire_once_and_wait_for_late_beats(spark, tmp_path):
    src, beat = f"{tmp_path}/e", "heartbeat"
    add(spark, src, [(1, 1, 0, beat), (2, 2, 1, beat), (3, None, 1, beat), (4, 1, 2, "succeeded")])
    add(spark, src, [(5, 1, 55, beat), (6, 1, 50, beat)])  # out of order; 30 to 55 is a gap of asset 1
    add(spark, src, [(7, 1, 48, beat)])  # late within the delay: joins the span from the front
    add(spark, src, [(8, 1, 2, beat)])  # later than the delay: left out
    add(spark, src, [(9, 3, 200, beat)])  # moves the watermark past all of them
    add(spark, src, [(10, 3, 201, beat)])
    out = run(spark, src, tmp_path, leases.expired_leases, gap="20 minutes")
    assert spans(out) == [(1, 0, 20, 1), (1, 48, 75, 3), (2, 1, 21, 1)]


def test_state_outlives_a_restart(spark, tmp_path):
    src, beat = f"{tmp_path}/e", "heartbeat"
    add(spark, src, [(1, 1, 0, beat), (2, 2, 0, beat)])
    assert spans(run(spark, src, tmp_path, leases.expired_leases, gap="20 minutes")) == []
    add(spark, src, [(3, 1, 15, beat), (4, 3, 24, beat)])
    run(spark, src, tmp_path, leases.expired_leases, gap="20 minutes")
    add(spark, src, [(5, 1, 30, beat), (6, 3, 100, beat)])
    add(spark, src, [(7, 3, 101, beat)])
    out = run(spark, src, tmp_path, leases.expired_leases, gap="20 minutes")
    assert spans(out) == [(1, 0, 50, 3), (2, 0, 20, 1), (3, 24, 44, 1)]
    # Nothing new: nothing more, and no lease twice.
    assert spans(run(spark, src, tmp_path, leases.expired_leases, gap="20 minutes")) == spans(out)


def test_a_failed_lease_blocks_ready(spark, tmp_path):
    src = f"{tmp_path}/e"
    add(spark, src, [(1, 1, 0, "claimed"), (2, 1, 5, "succeeded"), (3, 2, 0, "heartbeat"), (4, 3, 9, "failed")])
    add(spark, src, [(5, 2, 40, "succeeded"), (6, 4, 41, "succeeded")])  # the lease of 2 ran out at 20, 4 never had one
    add(spark, src, [(7, 4, 35, "heartbeat")])  # the beat that saves 4 comes after its result
    for k, m in enumerate((200, 300, 301)):
        add(spark, src, [(10 + 2 * k, 9, m, "heartbeat"), (11 + 2 * k, 9, m, "succeeded")])
    rows = run(spark, src, tmp_path, leases.guarded_results, gap="20 minutes").where("asset_id < 9").select("event_id", "outcome").distinct()
    assert {r.event_id: r.outcome for r in rows.collect()} == {2: "READY", 4: "FAILED", 5: "LEASE_LOST", 6: "READY"}


def test_the_store_is_set_back(spark):
    before = spark.conf.get(leases.PROVIDER)
    with pytest.raises(ZeroDivisionError), leases.timers(spark):
        1 / 0
    assert spark.conf.get(leases.PROVIDER) == before
