"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of texts that a Python worker turns into Python values at a time, where they are cut.
SLICE_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (``local``) gets a temporary folder; on a cluster that is an error,
    since executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/tilewright-checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tilewright-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*stored: DataFrame) -> None:
    """Removes tables that ``materialize`` wrote, once everything that was made from them has been written itself."""
    for df in stored:
        if files := df.inputFiles():
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def sliced(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes, one row at least: a batch may hold a whole task's texts, and as Python or pandas values they take several times their bytes."""
    for b in batches:
        rows = max(1, len(b) * most // max(1, b.nbytes))
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def map_exact(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, most: int | None = None) -> DataFrame:
    """``mapInPandas`` whose 64-bit columns are ``Int64``: beside a null they would become doubles, which round ids above 2^53.

    With ``most``, ``run`` gets its rows in slices of about so many bytes.
    """
    wanted = to_arrow_schema(StructType.fromDDL(schema))
    kinds = {pa.int64(): pd.Int64Dtype()}

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.to_pandas(types_mapper=kinds.get) for b in (sliced(batches, most) if most else batches)):
            yield from pa.Table.from_pandas(out, schema=wanted, preserve_index=False).to_batches()

    return df.mapInArrow(arrow, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col):
    """True where crc32 of the id as text leaves remainder 2 modulo 4; false for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))
