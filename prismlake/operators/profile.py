"""Table profiles: column sizes, missing values, repeated keys, time offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import utc_offset

# Bytes of a value of a numeric kind.
WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def column_sizes(df: DataFrame, fraction: float | None = None) -> DataFrame:
    """(column, rows, bytes): numbers by width, all else by UTF-8 length; ``fraction`` samples the lengths."""
    base = df if fraction is None else df.sample(fraction, seed=1)
    aggs = [F.count("*").alias("_n")]
    for f in df.schema.fields:
        width = WIDTHS.get(f.dataType.simpleString())
        text = F.col(f"`{f.name}`") if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.col(f"`{f.name}`").cast("string")
        aggs.append((F.count(f"`{f.name}`") * width if width else F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).cast("double").alias(f"_b_{f.name}"))
    seen = base.agg(*aggs)
    total = df.agg(F.count("*").alias("rows"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`_b_{c}`").alias("_bytes")) for c in df.columns])
    listed = seen.select("_n", F.inline(pairs)).join(F.broadcast(total), F.lit(True))
    return listed.select("column", "rows", F.round(F.col("_bytes") * F.col("rows") / F.greatest(F.lit(1), F.col("_n"))).cast("long").alias("bytes"))


def count_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def duplicate_report(df: DataFrame, key: str, source: str) -> DataFrame:
    """(source, rows): rows per source among those whose key is repeated."""
    twice = df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    return df.join(twice, key, "left_semi").groupBy(source).agg(F.count("*").alias("rows"))


def utc_offset_counts(df: DataFrame, column: str = "TIMESTAMP_MAYBE_TIMEZONE_AWARE") -> DataFrame:
    return df.groupBy(utc_offset(F.col(column)).alias("offset")).agg(F.count("*").alias("rows"))
