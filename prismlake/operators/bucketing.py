"""Hierarchical buckets: columns, level choice by row budget, and collapsing rows to buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spatial import DEPTH, LEVELS, cell_key, cell_paths, level_depth
from ..scratch import stored
from .schema import SEMANTIC_LAT, SEMANTIC_LON, TIME_LEVELS, assign_df_id, bucket_column_name

UNKNOWN, MARK = "Unknown", "?"
#: How far the sketch of a distinct count may be off before a level is counted exactly.
SKETCH_SLACK = 0.15


def fill_group_unknown(group: str) -> Column:
    return F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN))


def group_name(groups: list[str]) -> Column:
    return F.concat_ws(", ", *[F.coalesce(F.col(g).cast("string"), F.lit(MARK)) for g in groups])


def add_geo_cells(df: DataFrame, lat: str = "GPS_LATITUDE", lon: str = "GPS_LONGITUDE", family: str = "geo") -> DataFrame:
    return df.withColumns({bucket_column_name(family, k): cell_key(F.col(lat), F.col(lon), k) for k in range(LEVELS)})


def add_semantic_cells(df: DataFrame) -> DataFrame:
    return add_geo_cells(df, SEMANTIC_LAT, SEMANTIC_LON, "semantic")


def add_temporal_buckets(df: DataFrame, ts: str = "TIMESTAMP_UTC") -> DataFrame:
    """The start of the second, minute, hour, day, month and year of each time; null stays null."""
    return df.withColumns({bucket_column_name("time", u): F.date_trunc(u, F.col(ts)) for u in TIME_LEVELS})


def add_bucketed_columns(df: DataFrame) -> DataFrame:
    """Add the families whose inputs are there."""
    have = set(df.columns)
    if {"GPS_LATITUDE", "GPS_LONGITUDE"} <= have:
        df = add_geo_cells(df)
    if {SEMANTIC_LAT, SEMANTIC_LON} <= have:
        df = add_semantic_cells(df)
    return add_temporal_buckets(df) if "TIMESTAMP_UTC" in have else df


def drop_missing(df: DataFrame, family: str) -> DataFrame:
    """Drop rows without the inputs of a family: ``geo``, ``time`` or ``semantic``."""
    return df.dropna(subset={"geo": ["GPS_LATITUDE", "GPS_LONGITUDE"], "time": ["TIMESTAMP_UTC"], "semantic": [SEMANTIC_LAT, SEMANTIC_LON]}[family])


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(level, column, n): exact distinct counts, levels numbered as listed.

    Levels nest, so rows are first folded to the distinct values of all levels together, of which there
    are as many as of the finest; only these are spread over the levels.
    """
    counted = df.select(*[F.col(f"`{c}`") for c in columns]).distinct().agg(*[F.count_distinct(F.col(c)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(c).alias("column"), F.col(f"`{c}`").alias("n")) for k, c in enumerate(columns)])
    return counted.select(F.inline(rows))


def _path_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's sorted paths: the first, the last, and how many cells of each level they lie in."""
    shifts = [2 * (DEPTH - level_depth(k)) for k in range(LEVELS)]
    first, last, cells = None, None, np.ones(LEVELS, np.int64)
    for batch in batches:
        paths = batch.column(0).to_numpy()
        if not len(paths):
            continue
        if first is None:
            first = last = int(paths[0])
        paths, last = np.r_[last, paths], int(paths[-1])
        paths = paths[np.r_[True, paths[1:] != paths[:-1]]]
        cells += [np.count_nonzero(np.diff(paths >> s)) for s in shifts]
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([last]), pa.array([cells.tolist()], pa.list_(pa.int64()))], names=["first", "last", "cells"])


def geo_level_counts(df: DataFrame, lat: str = "GPS_LATITUDE", lon: str = "GPS_LONGITUDE", family: str = "geo") -> DataFrame:
    """``level_counts`` of the cells of all levels, without a table of cells in memory.

    Points are sorted by one number whose leading bits name their cells, so that each cell is one run
    of rows: a task counts where runs begin, and only the ends of tasks, one row each, are compared.
    """
    ordered = cell_paths(df, lat, lon).repartitionByRange("path").sortWithinPartitions("path")
    ends = stored(ordered.mapInArrow(_path_changes, "first long, last long, cells array<long>"), "cell-runs")
    placed = ends.withColumn("before", F.lag("last").over(Window.orderBy("first")))

    def n(k: int) -> Column:
        shift = 2 * (DEPTH - level_depth(k))
        shared = F.coalesce(F.shiftright("before", shift) == F.shiftright("first", shift), F.lit(False))
        return F.coalesce(F.sum(F.col("cells")[k] - shared.cast("long")), F.lit(0))

    counted = placed.agg(*[n(k).alias(f"n{k}") for k in range(LEVELS)])
    rows = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(bucket_column_name(family, k)).alias("column"), F.col(f"n{k}").alias("n")) for k in range(LEVELS)])
    return counted.select(F.inline(rows))


def finest_fitting(df: DataFrame, finest_first: list[str], max_rows: int) -> str | None:
    """None if the rows fit as they are; else the finest column with at most ``max_rows`` values, or the coarsest.

    One pass sketches all levels; columns whose sketch is far from the budget are settled by it, and
    only those near it are counted exactly, finest first.
    """
    have = [c for c in finest_first if c in df.columns]
    if not have:
        return None
    seen = df.agg(F.count("*").alias("_rows"), *[F.approx_count_distinct(c, 0.02).alias(c) for c in have]).first()
    if seen["_rows"] <= max_rows:
        return None
    for column in have:
        if seen[column] > max_rows * (1 + SKETCH_SLACK):
            continue
        if seen[column] < max_rows * (1 - SKETCH_SLACK) or df.agg(F.count_distinct(column)).first()[0] <= max_rows:
            return column
    return have[-1]


def optimal_geo_level(df: DataFrame, max_rows: int) -> str | None:
    return finest_fitting(df, [bucket_column_name("geo", k) for k in reversed(range(LEVELS))], max_rows)


def optimal_semantic_level(df: DataFrame, max_rows: int) -> str | None:
    return finest_fitting(df, [bucket_column_name("semantic", k) for k in reversed(range(LEVELS))], max_rows)


def optimal_temporal_level(df: DataFrame, max_rows: int) -> str | None:
    return finest_fitting(df, [bucket_column_name("time", u) for u in TIME_LEVELS], max_rows)


def bucket_by_column(df: DataFrame, target: str, group: str | None = None, id_col: str = "df_id") -> DataFrame:
    """One row per value of ``target`` (and group, null as "Unknown"): its first row by id, and COUNT.

    Rows without a target are left out. Counting and finding the first id is one hash aggregate of
    narrow rows; whole rows are then fetched by id. ``df_id`` of the result is that of the row.
    """
    for c in filter(None, [target, group]):
        if c not in df.columns:
            raise KeyError(f"no column {c}")
    keys = [F.col(target).alias("_target")] + ([fill_group_unknown(group).alias("_group")] if group else [])
    firsts = df.filter(F.col(target).isNotNull()).groupBy(*keys).agg(F.count("*").alias("COUNT"), F.min(id_col).alias("_first"))
    rows = df.drop("COUNT").join(firsts, F.col(id_col) == F.col("_first"))
    if group:
        rows = rows.withColumn(group, F.col("_group"))
    return rows.drop("_target", "_group", "_first")


def grouped_bucketed_projection(df: DataFrame, groups: list[str], candidates: list[str], max_entries: int, id_col: str = "df_id") -> DataFrame:
    """Each group by itself: raw rows if they fit, else buckets of the first candidate that fits, else of the last.

    Adds ``group_name``, ``bucket_column`` (null for raw groups) and COUNT (null for raw groups).
    A null in a candidate column is an error. Levels are chosen in one aggregate over all groups, of
    rows that are first folded by all candidates together.
    """
    named = df.withColumn("group_name", group_name(groups))
    missing = F.lit(0)
    for c in candidates:
        missing = missing + F.count_if(F.col(c).isNull())
    folded = named.groupBy("group_name", *candidates).agg(F.count("*").alias("_same"))
    sizes = folded.groupBy("group_name").agg(F.sum("_same").alias("_rows"), missing.alias("_missing"), *[F.count_distinct(c).alias(f"_n_{c}") for c in candidates])
    level = F.when(F.col("_rows") <= max_entries, F.lit(None).cast("string"))
    for c in candidates:
        level = level.when(F.col(f"_n_{c}") <= max_entries, F.lit(c))
    checked = F.when(F.col("_missing") > 0, F.raise_error(F.lit("a candidate column holds nulls")).cast("string")).otherwise(level.otherwise(F.lit(candidates[-1])))
    chosen = sizes.select(F.col("group_name").alias("_name"), checked.alias("bucket_column"))
    placed = named.join(chosen, F.col("group_name") == F.col("_name")).drop("_name")
    key = F.lit(None).cast("string")
    for c in candidates:
        key = F.when(F.col("bucket_column") == c, F.col(c).cast("string")).otherwise(key)
    keyed = placed.withColumn("_key", F.when(F.col("bucket_column").isNull(), F.col(id_col).cast("string")).otherwise(key))
    firsts = keyed.groupBy("group_name", "bucket_column", "_key").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n"))
    rows = firsts.select(F.col("_first"), "bucket_column", F.when(F.col("bucket_column").isNotNull(), F.col("_n")).alias("COUNT"))
    return named.drop("COUNT").join(rows, F.col(id_col) == F.col("_first")).drop("_first")


def renumbered(df: DataFrame, id_col: str = "df_id", kept_as: str = "row_id") -> DataFrame:
    """``df`` in the order of its ids, numbered anew from 0; the old id stays as ``kept_as``."""
    return assign_df_id(df.withColumnRenamed(id_col, kept_as).orderBy(kept_as), id_col)


def in_group_order(projection: DataFrame, by_size: bool = True, id_col: str = "df_id") -> DataFrame:
    """A grouped projection numbered anew: groups by descending rows, then name (or by name alone), rows by id within."""
    sizes = projection.groupBy("group_name").agg(F.sum(F.coalesce("COUNT", F.lit(1))).alias("_rows"))
    placed = projection.withColumnRenamed(id_col, "row_id").join(sizes, "group_name")
    order = ([F.desc("_rows")] if by_size else []) + [F.col("group_name"), F.col("row_id")]
    return assign_df_id(placed.orderBy(*order), id_col).drop("_rows")


def order_groups(df: DataFrame) -> DataFrame:
    """(group_name, rows) by descending rows, then name."""
    return df.groupBy("group_name").agg(F.sum(F.coalesce("COUNT", F.lit(1))).alias("rows")).orderBy(F.desc("rows"), "group_name")
