"""Structured Streaming jobs over task and event streams.

Every job is a function of streaming DataFrames; `run_available` runs one to the end of what its source holds.
Sinks write one folder a micro-batch and overwrite it on a retry, so a lost executor or a restart from the
checkpoint leaves each batch's rows exactly once. State is bounded by watermarks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.storage import shared_folder

TERMINAL = ("succeeded", "failed")
DELAY, LEASE_GAP, IDLE_GAP, PAIR_WITHIN = "10 minutes", "1 day", "30 minutes", "1 day"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream; new files are picked up, at most 64 a micro-batch.

    The path is a pattern, because a plain path has to be a folder and the table may be a single file.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{name}.parque[t]")


def run_available(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None, where: str | None = None, name: str | None = None) -> DataFrame:
    """Runs the query on all that is there and gives the written rows with their ``batch``.

    A ``name`` makes it go on from where the run of that name under ``where`` ended: state and rows are those of both.

    ``each`` turns a micro-batch into the rows to store, as a batch job. Files go to ``where``, else to a new folder
    under ``spark.checkpoint.dir``.
    """
    spark = stream.sparkSession
    home = f"{where or shared_folder(spark)}/stream-{name or uuid.uuid4().hex}"
    schemas: list = []

    def store(rows: DataFrame, batch: int) -> None:
        out = each(rows) if each else rows
        schemas.append(out.schema)
        out.write.mode("overwrite").parquet(f"{home}/rows/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    if not schemas:
        store(spark.createDataFrame([], stream.schema), -1)  # nothing arrived: a batch without rows gives the schema
    return spark.read.schema(schemas[-1].add("batch", "long")).parquet(f"{home}/rows")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """For update-mode output: each key's row of its last batch."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def version_gate(tasks: DataFrame, version: str = "v8") -> DataFrame:
    """Stateless: only tasks of the given algorithm version; a null version doesn't pass."""
    return tasks.where(F.col("algorithm_version") == version)


def throughput(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Succeeded and failed events a minute; run in update mode. Events later than ``delay`` are left out."""
    done = events.where(F.col("event").isin(*TERMINAL)).withWatermark("ts", delay)
    counted = done.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count_if(F.col("event") == "succeeded").alias("succeeded"), F.count_if(F.col("event") == "failed").alias("failed"))
    return counted.select(F.col("w.start").alias("minute"), "succeeded", "failed")


def terminal_once(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Terminal events without repeated deliveries of the same event within ``delay``."""
    return events.where(F.col("event").isin(*TERMINAL)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, key: str, gap: str, delay: str = DELAY) -> DataFrame:
    """Closed runs of a key's events with less than ``gap`` between neighbours."""
    found = events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return found.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def lost_leases(events: DataFrame, gap: str = LEASE_GAP, delay: str = DELAY) -> DataFrame:
    """Leases that ended because no heartbeat came within ``gap``: ``expired`` is when."""
    beats = sessions(events.where("event = 'heartbeat'"), "asset_id", gap, delay)
    return beats.select("asset_id", "started", F.col("ended").alias("expired"), F.col("events").alias("heartbeats"))


def stage_pairs(events: DataFrame, within: str = PAIR_WITHIN, delay: str = DELAY) -> DataFrame:
    """Claims with each terminal event of the same asset that follows within the given time."""
    a = events.where("event = 'claimed'").select(F.col("asset_id"), F.col("event_id").alias("claim_id"), F.col("ts").alias("claimed")).withWatermark("claimed", delay)
    b = events.where(F.col("event").isin(*TERMINAL)).select(F.col("asset_id").alias("asset"), F.col("event_id").alias("end_id"), F.col("ts").alias("finished")).withWatermark("finished", delay)
    near = (F.col("asset_id") == F.col("asset")) & (F.col("finished") >= F.col("claimed")) & (F.col("finished") <= F.col("claimed") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select("asset_id", "claim_id", "end_id")
