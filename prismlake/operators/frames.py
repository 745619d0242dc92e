"""Plot-ready frames: totals, cumulative shares, map centre, radius, zoom and marker sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spatial import haversine, zoom_of
from .prefix import running_sum

MARKER_SIZE, MARKER_LEAST = 20, 3


def counted(df: DataFrame) -> Column:
    return F.coalesce(F.col("COUNT"), F.lit(1)) if "COUNT" in df.columns else F.lit(1)


def group_totals(df: DataFrame, group: str) -> DataFrame:
    """Adds ``total`` rows of the group and ``label``, "name (total)"; totals are joined, not windowed."""
    totals = df.groupBy(F.col(group).alias("_group")).agg(F.sum(counted(df)).alias("total"))
    joined = df.join(totals, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    return joined.withColumn("label", F.concat(F.coalesce(F.col(group).cast("string"), F.lit("Unknown")), F.lit(" ("), F.col("total"), F.lit(")")))


def temporal_cdf(df: DataFrame, ts: str, group: str, id_col: str = "df_id") -> DataFrame:
    """Per group in order of time: cumulative COUNT over the total; a group may be of any size."""
    totals = df.groupBy(F.col(group).alias("_group")).agg(F.greatest(F.lit(1), F.sum(counted(df))).alias("_total"))
    summed = running_sum(df.withColumn("_n", counted(df).cast("long")), "_n", [ts, id_col], group, "_run")
    joined = summed.join(totals, F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_run") / F.col("_total")).alias("cdf"))


def cdf_frame(df: DataFrame, ts: str, group: str) -> DataFrame:
    return temporal_cdf(group_totals(df, group), ts, group)


def map_view(df: DataFrame, lat: str = "GPS_LATITUDE", lon: str = "GPS_LONGITUDE") -> DataFrame:
    """One row: points, center_lat, center_lon, radius_m, zoom; safe across the date line."""
    p, q = F.radians(lat), F.radians(lon)
    points = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    mean = points.agg(F.count("*").alias("points"), F.avg(F.cos(p) * F.cos(q)).alias("x"), F.avg(F.cos(p) * F.sin(q)).alias("y"), F.avg(F.sin(p)).alias("z"))
    center = mean.select("points", F.degrees(F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))).alias("center_lat"), F.degrees(F.atan2("y", "x")).alias("center_lon"))
    # the centre is one row
    far = points.select(lat, lon).join(F.broadcast(center), F.lit(True)).agg(F.max(haversine(F.col("center_lat"), F.col("center_lon"), F.col(lat), F.col(lon))).alias("radius_m"))
    both = center.join(F.broadcast(far), F.lit(True))
    return both.select("points", F.coalesce("center_lat", F.lit(0.0)).alias("center_lat"), F.coalesce("center_lon", F.lit(0.0)).alias("center_lon"), F.coalesce("radius_m", F.lit(0.0)).alias("radius_m")).withColumn("zoom", zoom_of(F.col("radius_m"), F.col("center_lat"), F.col("points")))


def with_marker_size(df: DataFrame) -> DataFrame:
    """Adds ``marker_size``: the area follows COUNT, against the largest COUNT."""
    most = df.agg(F.max(counted(df)).alias("_most"))
    return df.join(F.broadcast(most), F.lit(True)).withColumn("marker_size", F.greatest(F.lit(float(MARKER_LEAST)), F.sqrt(counted(df) * MARKER_SIZE * MARKER_SIZE / F.col("_most")))).drop("_most")


def geo_frame(df: DataFrame, group: str) -> DataFrame:
    return with_marker_size(group_totals(df, group))


def semantic_frame(df: DataFrame, group: str, lat: str, lon: str) -> DataFrame:
    return geo_frame(df.withColumn("GPS_LATITUDE", F.col(lat)).withColumn("GPS_LONGITUDE", F.col(lon)), group)


def plot_totals(df: DataFrame, level: str | None) -> DataFrame:
    return df.agg(F.sum(counted(df)).alias("rows"), F.count("*").alias("points")).withColumn("bucketed", F.lit(level is not None)).withColumn("level", F.lit(level))


def selection_stats(picked: DataFrame) -> DataFrame:
    return picked.agg(F.count("*").alias("points"), F.coalesce(F.sum(counted(picked)), F.lit(0)).alias("rows"))
