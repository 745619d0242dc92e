"""Readers: JSON lines, tables, GPS tracks, location exports, embeddings and images."""

from __future__ import annotations

import logging
import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import e7_to_degrees, iso_utc, parse_utc, plain_double, point_uuid, uuid_text
from ..operators.schema import CORE, assign_df_id, clip_coordinates, normalize, rules
from ..scratch import stored
from .gpx_points import gpx_points
from .json_array import json_array_entries


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; a bad line is an error that shows it and its place. Missing core columns are null, times parsed, rows checked and numbered.

    The files are read once: lines are parsed and stored, and all that follows reads the stored rows.
    Rules are counted as the rows are numbered, without a pass of their own.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # numbers of lines within their file follow from the stored lines, empty ones included
    held = stored(lines.withColumn("parsed", F.try_parse_json("value")), "json-lines")
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    full = held.filter(F.trim("value") != "")
    found = full.agg(F.count_if(~is_object).alias("bad"), F.expr("schema_of_variant_agg(parsed)").alias("kinds")).first()
    if found["bad"]:
        raise ValueError("; ".join(_bad_lines(held, full.filter(~is_object))))
    inferred = _struct_of(spark, found["kinds"] or "OBJECT<>")
    core = {f.name: f for f in CORE}
    # core columns are read in their own types, times as text; other columns as they are found
    fields = [T.StructField(f.name, T.StringType() if isinstance(core[f.name].dataType, T.TimestampType) else core[f.name].dataType) if f.name in core else f for f in inferred.fields]
    rows = full.select(F.from_json("value", T.StructType(fields), {"mode": "FAILFAST"}).alias("row")).select("row.*") if fields else full.select()
    return _checked(normalize(rows))


def _struct_of(spark: SparkSession, kinds: str) -> T.StructType:
    """The columns of lines whose variants have this schema: decimals are doubles, and mixed or unknown values text."""
    text = re.sub(r"\bDECIMAL\(\d+,\s*\d+\)", "DOUBLE", kinds)
    text = re.sub(r"\bOBJECT\b(?=<)", "STRUCT", re.sub(r"\b(VOID|VARIANT)\b", "STRING", text))
    return T.StructType() if text in ("STRUCT<>", "STRING") else spark.range(0).select(F.from_json(F.lit(None).cast("string"), text).alias("s")).schema["s"].dataType


def _checked(df: DataFrame) -> DataFrame:
    """``df`` numbered, or an error that names every broken rule; rules are observed as the numbered rows are written."""
    seen = Observation()
    numbered = assign_df_id(df.observe(seen, *[F.count_if(bad).alias(name) for name, bad in rules().items()]))
    broken = [(name, n) for name, n in seen.get.items() if n]
    if broken:
        raise ValueError("broken rules: " + ", ".join(f"{name} ({n})" for name, n in broken))
    return numbered


def _bad_lines(held: DataFrame, bad: DataFrame, most: int = 5) -> list[str]:
    """The first bad lines: file, line number in the whole file, and their beginning."""
    found = bad.orderBy("file", "block", "at").limit(most).collect()
    splits = held.filter(F.col("file").isin([r["file"] for r in found])).groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = reduce(or_, [(F.col("file") == r["file"]) & (F.col("block") == r["block"]) for r in found])
    of = {(r["file"], r["block"]): r["before"] - r["first"] + 1 for r in splits.withColumn("before", before).filter(here).collect()}
    return [f"line {r['at'] + of[r['file'], r['block']]} of {r['file']}: {r['value'][:80]}" for r in found]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A whole Parquet table with the core columns, coordinates clamped; not checked."""
    return clip_coordinates(normalize(spark.read.parquet(path)))


def query_source(spark: SparkSession, text: str, args: dict | None = None, time_column: str | None = None) -> DataFrame:
    """A query with named parameters; the time column, if text, is parsed as UTC."""
    df = spark.sql(text, args=args or {})
    return df.withColumn(time_column, parse_utc(F.col(time_column).cast("string"))) if time_column else df


def discover_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, name, size) of the files below ``folder`` that match."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def _with_ids(points: DataFrame) -> DataFrame:
    """UUIDs from the first point, by time, of each file and the point itself; order of the file's points decides nothing."""
    parts = [iso_utc(F.col("TIMESTAMP_UTC")), F.col("DATA_TYPE"), plain_double(F.col("GPS_LATITUDE")), plain_double(F.col("GPS_LONGITUDE"))]
    # one row a file; stored, so that Spark knows how few they are and does not deal all points by file
    firsts = stored(points.groupBy("SOURCE_FILE").agg(F.min(F.struct("TIMESTAMP_UTC", "DATA_TYPE", "GPS_LATITUDE", "GPS_LONGITUDE")).alias("_f")).select(F.col("SOURCE_FILE").alias("_file"), "_f"), "first-points")
    joined = points.join(firsts, F.col("SOURCE_FILE") == F.col("_file"))
    first = [iso_utc(F.col("_f.TIMESTAMP_UTC")), plain_double(F.col("_f.GPS_LATITUDE")), plain_double(F.col("_f.GPS_LONGITUDE"))]
    marked = joined.withColumn("UUID", point_uuid(first, [parts[0], parts[2], parts[3], parts[1]]))
    return marked.withColumn("UUID_STRING", uuid_text(F.col("UUID"))).drop("_file", "_f")


def read_gpx(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(points, quarantine): track points and waypoints with a time and coordinates; files that are not GPX.

    The quarantine names every file without a ``gpx`` element around well-formed XML, empty files
    aside; none is lost between the two. A file of any size is read by many tasks, each of which takes
    the points out of its share.
    """
    found, bad = gpx_points(spark, folder)
    is_mark = F.col("kind") == "wpt"
    texts = [F.when(is_mark, value).alias(name) for name, value in (("NAME", F.col("point.name")), ("CAPTION", F.coalesce("point.cmt", "point.desc")))]
    points = found.select(F.col("file").alias("SOURCE_FILE"), F.when(is_mark, "GPX_WAYPOINT").otherwise("GPX_TRACKPOINT").alias("DATA_TYPE"), *texts, F.col("point.time").alias("TIMESTAMP_MAYBE_TIMEZONE_AWARE"), parse_utc(F.col("point.time")).alias("TIMESTAMP_UTC"), F.col("point._lat").alias("GPS_LATITUDE"), F.col("point._lon").alias("GPS_LONGITUDE"))
    usable = points.dropna(subset=["TIMESTAMP_UTC", "GPS_LATITUDE", "GPS_LONGITUDE"])
    return _with_ids(usable), bad.select(F.col("file").alias("SOURCE_FILE"))


def read_takeout(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(points, quarantine) of ``Records.json`` files: one row a valid location; files that are not valid JSON or hold no ``locations`` array.

    A file of any size is read by many tasks, each of which cuts its share of the array at the entries'
    own braces; one bad file does not keep the others from being read.
    """
    found, bad = json_array_entries(spark, folder, "Records.json", "locations")
    entries = found.select(F.col("file").alias("SOURCE_FILE"), F.try_parse_json("entry").alias("e"))

    def field(name: str, kind: str):
        return F.expr(f"try_variant_get(e, '$.{name}', '{kind}')")

    points = entries.select("SOURCE_FILE", F.lit("GOOGLE_TAKEOUT_LOCATION").alias("DATA_TYPE"), field("timestamp", "string").alias("TIMESTAMP_MAYBE_TIMEZONE_AWARE"), parse_utc(field("timestamp", "string")).alias("TIMESTAMP_UTC"), e7_to_degrees(field("latitudeE7", "bigint")).alias("GPS_LATITUDE"), e7_to_degrees(field("longitudeE7", "bigint")).alias("GPS_LONGITUDE"))
    usable = points.filter(F.col("TIMESTAMP_UTC").isNotNull() & F.col("GPS_LATITUDE").between(-90, 90) & F.col("GPS_LONGITUDE").between(-180, 180))
    return _with_ids(usable), bad.select(F.col("file").alias("SOURCE_FILE"))


def read_embeddings(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(UUID_STRING, SEMANTIC_EMBEDDING) of one kind."""
    return spark.read.parquet(path).filter(F.col("EMBEDDING_TYPE") == kind).select("UUID_STRING", F.col("EMBEDDING").cast("array<float>").alias("SEMANTIC_EMBEDDING"))


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """(UUID_STRING, path): ``<uuid>.jpg`` anywhere below; of equal names the first path. Repeated names are logged, with how many there are."""
    found = discover_files(spark, folder, "*.jpg").withColumn("UUID_STRING", F.regexp_extract("name", r"^(.*)\.jpg$", 1))
    once = stored(found.groupBy("UUID_STRING").agg(F.min("path").alias("path"), F.count("*").alias("files")), "images")
    repeated = once.filter("files > 1")
    if n := repeated.count():
        some = ", ".join(r["UUID_STRING"] for r in repeated.orderBy("UUID_STRING").limit(5).collect())
        logging.getLogger(__name__).warning("%d image names occur more than once below %s: %s%s", n, folder, some, " ..." if n > 5 else "")
    return once.drop("files")


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows by column name, numbered anew."""
    total = frames[0].drop("df_id")
    for df in frames[1:]:
        total = total.unionByName(df.drop("df_id"), allowMissingColumns=True)
    return assign_df_id(total)


def ingest_tracks(points: DataFrame, path: str | None = None) -> DataFrame:
    """Distinct rows in order of (time, UUID), with buckets; a UUID that stays repeated is an error that names the files.

    The distinct rows are written once, for the check and the result. With ``path`` the result is
    written there as Parquet and read back.
    """
    from ..operators.bucketing import add_bucketed_columns
    from ..operators.profile import duplicate_report
    from ..operators.selection import dedup_rows
    from .sinks import write_parquet

    rows = stored(dedup_rows(points), "distinct-points")
    files = [f"{r[0]} ({r[1]})" for r in duplicate_report(rows, "UUID_STRING", "SOURCE_FILE").orderBy(F.desc("rows")).limit(20).collect()]
    if files:
        raise ValueError("repeated UUIDs in: " + ", ".join(files))
    bucketed = add_bucketed_columns(rows.repartitionByRange("TIMESTAMP_UTC", "UUID_STRING").sortWithinPartitions("TIMESTAMP_UTC", "UUID_STRING"))
    if path is None:
        return bucketed
    write_parquet(bucketed, path)
    return points.sparkSession.read.parquet(path)


def first_point_per_file(points: DataFrame) -> DataFrame:
    return points.groupBy("SOURCE_FILE").agg(F.min(F.struct("TIMESTAMP_UTC", "DATA_TYPE", "GPS_LATITUDE", "GPS_LONGITUDE")).alias("f")).select("SOURCE_FILE", "f.*")

