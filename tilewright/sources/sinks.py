"""Tables of results and of refused rows, written a batch at a time.

A batch that is written again replaces itself and nothing else, so a job that is repeated after a failure leaves the
same rows. Results keep the rule of completions: READY has an object, EMPTY has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import REJECT, rejects

# The error code reported for each stage that refuses rows.
STAGE_CODES = {"task": "TASK_INVALID", "event": "EVENT_INVALID", "tile": "SOURCE_FORMAT_INVALID", "chunk": "SOURCE_FORMAT_INVALID", "mesh": "SOURCE_FORMAT_INVALID", "uv": "SOURCE_FORMAT_INVALID", "scope": "SCOPE_INVALID", "ring": "SCOPE_INVALID", "report": "PROCESSING_FAILED", "transfer": "TRANSFER_FAILED", "control": "CONTROL_PLANE_FAILED"}
RETRYABLE = ("transfer", "control")
OBJECT = ("output_etag", "output_sha256", "output_size")


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def checked(reports: DataFrame, key: str = "asset_id") -> tuple[DataFrame, DataFrame]:
    """Reports that keep the rule, and rejects for the others: READY needs etag, SHA-256 and a size above 0, EMPTY has none.

    A result that is neither is refused too, also null.
    """
    size = F.coalesce(F.col("output_size"), F.lit(0))
    ready, empty = F.col("result") == "READY", F.col("result") == "EMPTY"
    code = F.when(ready & (_blank("output_etag") | _blank("output_sha256") | (size <= 0)), "READY_WITHOUT_OBJECT")
    code = code.when(empty & ~(_blank("output_etag") & _blank("output_sha256") & (size == 0)), "EMPTY_WITH_OBJECT")
    code = code.when(~F.coalesce(ready | empty, F.lit(False)), "UNKNOWN_RESULT")
    judged = reports.withColumn("_code", code)
    return judged.where("_code IS NULL").drop("_code"), rejects(judged.where("_code IS NOT NULL"), "report", F.col(key), F.col("_code"), F.col("result"))


def report_json(statistics: tuple[str, ...] = ()) -> Column:
    """The completion as JSON text; EMPTY carries no object fields, since nulls are left out."""
    return F.to_json(F.struct("result", F.col("output_etag").alias("outputEtag"), F.col("output_sha256").alias("outputSha256"), F.col("output_size").alias("outputSize"), F.struct(*statistics).alias("statistics") if statistics else F.lit(None).alias("statistics")))


def quarantine(*branches: DataFrame) -> DataFrame:
    """All refused rows with the error code of their stage and whether another try may help."""
    rows = reduce(DataFrame.unionByName, [b.select(*REJECT) for b in branches])
    codes = F.create_map(*[F.lit(x) for pair in STAGE_CODES.items() for x in pair])
    message = F.concat_ws(" ", F.col("code"), F.col("detail"))
    return rows.withColumns({"error_code": F.coalesce(codes[F.col("stage")], F.lit("PROCESSING_FAILED")), "retryable": F.col("stage").isin(*RETRYABLE), "message": F.when(F.trim(message) == "", "processing failed").otherwise(message)})


def write_batch(rows: DataFrame, folder: str, batch: str) -> None:
    """Replaces one batch of a table: the partition ``batch`` and no other, also where the batch has become empty.

    The partition is overwritten dynamically: readers see the old rows until the new ones are committed.
    """
    spark = rows.sparkSession
    named = rows.withColumn("batch", F.lit(batch))
    if rows.isEmpty():
        # A dynamic overwrite without rows would leave the old ones.
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    else:
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)


def read_batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All batches of a table, with their name; ``schema`` is that of the rows."""
    return spark.read.schema(schema.add("batch", "string") if "batch" not in schema.names else schema).parquet(folder)


def accounted(inputs: DataFrame, accepted: DataFrame, refused: DataFrame) -> DataFrame:
    """Items (column item) that are not in exactly one of accepted and refused as often as in the inputs: item, given, taken, left_out.

    An empty result means that the books are closed. Null items are counted together.
    """
    count = lambda df, name: df.select(F.col("item").cast("string").alias("item"), F.lit(name).alias("side"))
    sides = count(inputs, "given").unionByName(count(accepted, "taken")).unionByName(count(refused, "left_out"))
    totals = sides.groupBy("item").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("given", "taken", "left_out")])
    return totals.where(F.col("given") != F.col("taken") + F.col("left_out"))
