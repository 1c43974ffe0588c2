"""All queries of the library, each over whole tables, and SQL for another engine where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.sources.derived import run_sql, with_tables

from . import composed, intake, scans, shared, streams

Query = Callable[[SparkSession, str], DataFrame]


def _shared(name: str, sql: str) -> Query:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, shared.spark_text(sql), shared.DEALT.get(name))


QUERIES: dict[str, Query] = {**{k: _shared(k, sql) for k, sql in shared.SHARED.items()}, **composed.QUERIES, **scans.QUERIES, **streams.QUERIES, **intake.QUERIES}
ORACLE_SQL: dict[str, str] = {**{k: with_tables(shared.duckdb_text(sql)) for k, sql in shared.SHARED.items()}, **{k: with_tables(sql) for k, sql in {**composed.ORACLE_SQL, **scans.ORACLE_SQL, **streams.ORACLE_SQL, **intake.ORACLE_SQL}.items()}}
