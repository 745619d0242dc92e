"""Streaming ingest: files as they arrive, normalised, bucketed, freed of repeats, merged and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.scalars import row_hash
from ..operators.bucketing import UNKNOWN, add_bucketed_columns
from ..operators.schema import bucket_column_name, normalize
from ..sources.keyed_table import upsert


def _rows(spark: SparkSession, source: str, schema: StructType) -> DataFrame:
    return add_bucketed_columns(normalize(spark.readStream.schema(schema).json(source)))


def stream_ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str = "UUID_STRING") -> StreamingQuery:
    """Merge each batch of new JSON-lines files into the keyed table ``target`` until none is left.

    Of rows of one batch that share a key the one with the greatest hash of its content is kept, so a
    replayed batch changes nothing. A batch rewrites only the buckets of the table that it falls in.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            drawn = batch.withColumn("_draw", row_hash(batch))
            top = drawn.groupBy(F.col(key).alias("_key")).agg(F.max("_draw").alias("_top"))
            same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_draw") == F.col("_top"))
            upsert(drawn.join(top, same, "left_semi").drop("_draw").dropDuplicates([key]), target, key)

    return _rows(spark, source, schema).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_bucket_counts(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, level: str = "HOUR", group: str = "DATA_TYPE", late_by: str = "1 day", key: str = "UUID_STRING", files_per_batch: int | None = None) -> StreamingQuery:
    """Keep COUNT of each time bucket and group of the arriving files in the keyed table ``target`` until none is left.

    Two state stores carry over from batch to batch and from run to run: the keys seen, so that a row
    that comes again with its key and time, in whatever file or batch, counts once, and the counts.
    Both are freed of what lies ``late_by`` behind the newest time; a row that comes later than that is
    left out. Each batch writes only the counts that it changed, whole, so a replayed batch changes
    nothing. Columns of the table: ``bucket_key``, the level's column, the group (null as "Unknown"),
    COUNT. Rows without a time or a key are left out.
    """
    column = bucket_column_name("time", level)
    files = spark.readStream.schema(schema)
    files = files.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else files
    rows = normalize(files.json(source)).select(key, "TIMESTAMP_UTC", F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN)).alias(group))
    fresh = rows.filter(F.col("TIMESTAMP_UTC").isNotNull() & F.col(key).isNotNull()).withWatermark("TIMESTAMP_UTC", late_by).dropDuplicates([key, "TIMESTAMP_UTC"])
    span = {"MONTH": None, "YEAR": None}.get(level, f"1 {level.lower()}")
    if span is None:
        raise ValueError("state is freed by buckets of a fixed length: a day or shorter")
    counts = fresh.groupBy(F.window("TIMESTAMP_UTC", span).alias("w"), group).agg(F.count("*").alias("COUNT"))

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            named = batch.select(F.concat_ws("|", F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss"), group).alias("bucket_key"), F.col("w.start").alias(column), group, "COUNT")
            upsert(named, target, "bucket_key")

    return counts.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
