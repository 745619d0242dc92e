"""Helpers shared by the training-data operators: scratch tables, shared files, stable splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import row_hash
from ..scratch import scratch_path, shared_dir, stored

__all__ = ["file_system", "free_name", "id_remainder", "row_hash", "scratch_path", "shared_dir", "stored", "table", "text_batches"]


_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch: they hold whole texts, so Spark's 10,000 would be tens of megabytes in each worker.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold ``BATCH_ROWS`` rows, unless the session has its own number."""
    if spark.conf.get(_ROWS_KEY) == "10000":
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def file_system(uri: str):
    """(pyarrow file system, path) of a shared folder, on the driver or in a task."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column of ``taken`` has it."""
    used = {column.lower() for column in taken}
    while name.lower() in used:
        name += "_"
    return name
