"""The common schema: normalising, validating and numbering rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_utc
from ..functions.spatial import LEVELS, clip
from ..scratch import stored

# The kinds of record, the core columns and the time levels, finest first.
DATA_TYPES = ["PHOTO", "VIDEO", "GPX_TRACKPOINT", "GPX_WAYPOINT", "GOOGLE_TAKEOUT_LOCATION"]
CORE = T.StructType([
    T.StructField("UUID_STRING", T.StringType()),
    T.StructField("DATA_TYPE", T.StringType()),
    T.StructField("NAME", T.StringType()),
    T.StructField("CAPTION", T.StringType()),
    T.StructField("SOURCE_FILE", T.StringType()),
    T.StructField("TIMESTAMP_MAYBE_TIMEZONE_AWARE", T.StringType()),
    T.StructField("TIMESTAMP_UTC", T.TimestampType()),
    T.StructField("GPS_LATITUDE", T.DoubleType()),
    T.StructField("GPS_LONGITUDE", T.DoubleType()),
    T.StructField("RATING_0_TO_5", T.IntegerType()),
    T.StructField("SIZE_IN_BYTES", T.LongType()),
])
TIME_LEVELS = ["SECOND", "MINUTE", "HOUR", "DAY", "MONTH", "YEAR"]
SEMANTIC_LAT, SEMANTIC_LON = "SEMANTIC_EMBEDDING_UMAP_LATITUDE", "SEMANTIC_EMBEDDING_UMAP_LONGITUDE"


def bucket_column_name(family: str, level: int | str) -> str:
    """Column of a level: families ``time`` (SECOND..YEAR), ``geo`` and ``semantic`` (0..15)."""
    if family == "time":
        if level not in TIME_LEVELS:
            raise ValueError(f"no time level {level}")
        return f"BUCKETED_TIMESTAMP_{level}"
    if not isinstance(level, int) or not 0 <= level < LEVELS:
        raise ValueError(f"level {level} is not in 0..{LEVELS - 1}")
    return f"BUCKETED_CELL_L{level}" if family == "geo" else f"BUCKETED_SEMANTIC_CELL_L{level}"


def normalize(df: DataFrame) -> DataFrame:
    """Core columns first, cast where they can be, null where absent; other columns follow as they are."""
    have = set(df.columns)
    core = []
    for field in CORE:
        if field.name not in have:
            value = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, T.TimestampType) and isinstance(df.schema[field.name].dataType, T.StringType):
            value = parse_utc(F.col(field.name))
        else:
            value = F.col(field.name).try_cast(field.dataType)
        core.append(value.alias(field.name))
    names = {f.name for f in CORE}
    return df.select(*core, *[F.col(f"`{c}`") for c in df.columns if c not in names])


def rules() -> dict:
    """Rule name to the condition that breaks it."""
    c = F.col
    return {
        "data_type_missing": c("DATA_TYPE").isNull(),
        "data_type_unknown": ~c("DATA_TYPE").isin(DATA_TYPES),
        "latitude_range": ~c("GPS_LATITUDE").between(-90, 90),
        "longitude_range": ~c("GPS_LONGITUDE").between(-180, 180),
        "rating_range": ~c("RATING_0_TO_5").between(0, 5),
        "size_negative": c("SIZE_IN_BYTES") < 0,
    }


def validation_report(df: DataFrame) -> DataFrame:
    """(rule, violations): every rule, counted in one pass."""
    counted = df.agg(*[F.count_if(bad).alias(name) for name, bad in rules().items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules()])
    return counted.select(F.inline(pairs))


def validate(df: DataFrame) -> DataFrame:
    """``df``, or an error that names every broken rule."""
    broken = [(r["rule"], r["violations"]) for r in validation_report(df).filter("violations > 0").collect()]
    if broken:
        raise ValueError("broken rules: " + ", ".join(f"{n} ({k})" for n, k in broken))
    return df


def assign_df_id(df: DataFrame, name: str = "df_id") -> DataFrame:
    """Add a contiguous number 0..n-1 in the order of the rows.

    Rows are numbered within their partition, written with these numbers, which then stay, and
    moved by the rows of the partitions before; only one row a partition is ordered and broadcast.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    marked = stored(df.select(*rest, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "numbered")
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = sizes.select("_part", (before - F.col("_first")).alias("_move"))
    return marked.join(F.broadcast(moved), "_part").select((F.col("_at") + F.col("_move")).alias(name), *rest)


def clip_coordinates(df: DataFrame) -> DataFrame:
    """Clamp whichever latitude and longitude columns there are; nulls stay."""
    bounds = {"GPS_LATITUDE": 90, "GPS_LONGITUDE": 180, SEMANTIC_LAT: 90, SEMANTIC_LON: 180}
    return df.withColumns({c: clip(F.col(c), b) for c, b in bounds.items() if c in df.columns})


def validate_identifier(name: str) -> str:
    if not re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_-]*", name):
        raise ValueError(f"not a table or column name: {name!r}")
    return f"`{name}`"
