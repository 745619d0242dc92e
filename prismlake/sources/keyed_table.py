"""Keyed Parquet tables in hash buckets: a batch rewrites only the buckets that its keys fall in."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import _over, assert_unique_key, last_rows, validate_identifier

#: Directory column of the buckets, and names of the files beside them, which Spark's readers skip.
BUCKET = "key_bucket"
LAYOUT, WRITER, STAGED, READY = "_layout.json", "_writer", "_staged", "_READY"
#: Buckets of a new table; a bucket should hold some 100 MB, so a table of 10 TB wants 100,000.
BUCKETS = 64


class _Files:
    """The few calls on the store of a path that a table needs."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self._path("/".join([self.root, *parts]))

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self.at(*parts))

    def names(self, *parts: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self.at(*parts))] if self.exists(*parts) else []

    def delete(self, *parts: str) -> None:
        self._fs.delete(self.at(*parts), True)

    def move(self, source: tuple[str, ...], target: tuple[str, ...]) -> None:
        if not self._fs.rename(self.at(*source), self.at(*target)):
            raise OSError(f"could not move {self.at(*source)} to {self.at(*target)}")

    def create(self, *parts: str) -> bool:
        return self._fs.createNewFile(self.at(*parts))

    def write(self, text: str, *parts: str) -> None:
        out = self._fs.create(self.at(*parts), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, *parts: str) -> str:
        source = self._fs.open(self.at(*parts))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(buckets)).cast("int")


def layout_of(spark: SparkSession, path: str) -> dict | None:
    """Key and number of buckets of the table at ``path``; None where there is no such table."""
    files = _Files(spark, path)
    return json.loads(files.read(LAYOUT)) if files.exists(LAYOUT) else None


def read_keyed(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The table's rows, of all buckets or of some; columns that a bucket was written without are null in it."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    if BUCKET not in rows.columns:
        return rows
    return (rows if buckets is None else rows.filter(F.col(BUCKET).isin(buckets))).drop(BUCKET)


@contextmanager
def _only_writer(files: _Files) -> Iterator[None]:
    if not files.create(WRITER):
        raise RuntimeError(f"{files.root} has a writer; delete {WRITER} there if it is dead")
    try:
        yield
    finally:
        files.delete(WRITER)


def _apply(files: _Files) -> None:
    """Move the staged buckets in; each step may be repeated, so what a failure has left is finished by the next call."""
    for name in files.names(STAGED):
        if name.startswith(f"{BUCKET}="):
            files.delete(name)
            files.move((STAGED, name), (name,))
    if files.exists(STAGED, LAYOUT):
        if files.exists(LAYOUT):
            files.delete(STAGED, LAYOUT)
        else:
            files.move((STAGED, LAYOUT), (LAYOUT,))
    for name in files.names():  # a table without buckets, which these replace
        if not name.startswith(("_", ".", f"{BUCKET}=")):
            files.delete(name)
    files.delete(STAGED)


def recover(spark: SparkSession, path: str) -> None:
    """Finish a write that failed after all its buckets were staged, or drop what it had staged."""
    files = _Files(spark, path)
    if files.exists(STAGED, READY):
        _apply(files)
    elif files.exists(STAGED):
        files.delete(STAGED)


def upsert(df: DataFrame, path: str, key: str, order: str | None = None, mode: str = "replace", buckets: int | None = None) -> int:
    """Merge ``df`` into the table at ``path`` by key; made if absent. Returns how many buckets were written.

    The table lies in directories by a hash of the key. Only the buckets that the batch's keys fall in
    are read, merged and written again, so the cost follows the batch, not the table. New columns
    are added: buckets that lack them read as null. Old columns keep their types, and a value that
    does not fit is an error. A null key is a key. A plain Parquet table at ``path`` is laid out in
    buckets once; repeated keys in it are an error that leaves it as it was.

    Merged buckets are staged beside the table and marked ready when all are whole; then they are moved
    in one by one. A failure before the mark changes nothing; after it the next writer, or ``recover``,
    finishes the moves. A marker file keeps a second writer out.
    """
    spark = df.sparkSession
    if not df.columns:
        raise ValueError("the incoming frame has no columns")
    for c in df.columns:
        validate_identifier(c)
    if mode not in ("replace", "patch"):
        raise ValueError(mode)
    files = _Files(spark, path)
    with _only_writer(files):
        recover(spark, path)
        layout = layout_of(spark, path)
        if layout and layout["key"] != key:
            raise ValueError(f"the table's key is {layout['key']}, not {key}")
        there = [n for n in files.names() if not n.startswith(("_", "."))]
        kinds = {f.name: f.dataType for f in read_keyed(spark, path).schema} if there else {}
        fitted = df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])
        new = last_rows(fitted, key, order)
        if layout:
            buckets = layout["buckets"]
            # at most as many numbers as the table has buckets
            touched = [r[0] for r in new.select(bucket_of(key, buckets).alias("b")).distinct().collect()]
            old = read_keyed(spark, path, touched) if there and touched else None
        else:
            buckets = buckets or BUCKETS
            touched, old = None, assert_unique_key(read_keyed(spark, path), key) if there else None
        if touched == []:
            return 0
        rows = new if old is None else _over(old, new, key, mode)
        placed = rows.withColumn(BUCKET, bucket_of(key, buckets))
        placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{files.root}/{STAGED}")
        assert_unique_key(spark.read.option("mergeSchema", "true").parquet(f"{files.root}/{STAGED}"), key)
        written = sum(n.startswith(f"{BUCKET}=") for n in files.names(STAGED))
        if not layout:
            files.write(json.dumps({"key": key, "buckets": buckets}), STAGED, LAYOUT)
        files.write(uuid.uuid4().hex, STAGED, READY)
        _apply(files)
        return written
