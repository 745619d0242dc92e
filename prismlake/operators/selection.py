"""From picked buckets or ids back to base rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions.scalars import row_hash
from .bucketing import fill_group_unknown


def _keys(picked: DataFrame, base: DataFrame, target: str, group: str | None) -> tuple[DataFrame, Column]:
    for c in filter(None, [target, group]):
        for df in (picked, base):
            if c not in df.columns:
                raise KeyError(f"no column {c}")
    cols = [F.col(target).alias("_target")] + ([fill_group_unknown(group).alias("_group")] if group else [])
    keys = picked.select(*cols).distinct()
    on = base[target] == F.col("_target")
    if group:
        on = on & (F.coalesce(base[group].cast("string"), F.lit("Unknown")) == F.col("_group"))
    return keys, on


def pick(buckets: DataFrame, ids: list[int], id_col: str = "df_id") -> DataFrame:
    """The bucket rows with these ids; an unknown or repeated id is an error."""
    if len(set(ids)) != len(ids):
        raise ValueError("an id is picked twice")
    # the ids are points that a user has picked of one projection, bounded by its row budget
    chosen = buckets.sparkSession.createDataFrame([(i,) for i in ids], f"{id_col} long")
    picked = buckets.join(F.broadcast(chosen), id_col, "left_semi")
    found = picked.count()
    if found != len(ids):
        raise KeyError(f"{len(ids) - found} of {len(ids)} ids are not in the projection")
    return picked


def filter_to_buckets(base: DataFrame, picked: DataFrame, target: str, group: str | None = None, checked: bool = False) -> DataFrame:
    """All base rows in the picked buckets; no buckets, no rows.

    With ``checked`` it is an error if a bucket is picked twice, or if the rows are not as many as the
    picked buckets count, as when they come from another subset; this runs two counting jobs.
    """
    keys, on = _keys(picked, base, target, group)
    kept = base.join(keys, on, "left_semi")
    if checked:
        buckets, rows = picked.agg(F.count("*"), F.coalesce(F.sum("COUNT"), F.lit(0))).first()
        if buckets != keys.count():
            raise ValueError("a bucket is picked twice")
        if rows != (n := kept.count()):
            raise ValueError(f"the picked buckets count {rows} rows, the base has {n}")
    return kept


def subtract_buckets(base: DataFrame, picked: DataFrame, target: str, group: str | None = None) -> DataFrame:
    """All base rows outside the picked buckets; rows without a bucket stay."""
    keys, on = _keys(picked, base, target, group)
    return base.join(keys, on, "left_anti")


def filter_to_ids(base: DataFrame, ids: DataFrame, id_col: str = "df_id") -> DataFrame:
    """Base rows whose id is in ``ids``; unknown ids are ignored."""
    return base.join(ids.select(id_col).distinct(), id_col, "left_semi")


def subtract_ids(base: DataFrame, ids: DataFrame, id_col: str = "df_id") -> DataFrame:
    return base.join(ids.select(id_col).distinct(), id_col, "left_anti")


def keep_first(df: DataFrame, key: str, order: str = "df_id") -> DataFrame:
    """The first row of each key by ``order``; of rows that tie, the one with the least hash. Null is a key too.

    The least (order, hash) of each key comes from a hash aggregate, whole rows by join on all three.
    """
    drawn = df.withColumn("_draw", row_hash(df))
    firsts = drawn.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(F.col(order).alias("o"), "_draw")).alias("_first"))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(order).eqNullSafe(F.col("_first.o")) & (F.col("_draw") == F.col("_first._draw"))
    return drawn.join(firsts, same, "left_semi").dropDuplicates([key]).drop("_draw")


def dedup_rows(df: DataFrame) -> DataFrame:
    """Each row once; maps, which Spark does not compare, are alike if their entries are, in any order."""
    maps = {f"_entries_{f.name}": F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) for f in df.schema.fields if isinstance(f.dataType, MapType)}
    keys = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)] + list(maps)
    return df.withColumns(maps).dropDuplicates(keys).drop(*maps) if maps else df.distinct()


def filter_media(df: DataFrame) -> DataFrame:
    return df.filter(F.col("DATA_TYPE").isin("PHOTO", "VIDEO"))


def active_uuids(df: DataFrame, limit: int = 1000) -> DataFrame:
    """One row: the first ``limit`` distinct UUIDs of photos and videos, comma-joined, and their number."""
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be 1..10000")
    firsts = filter_media(df).filter("UUID_STRING is not null").groupBy("UUID_STRING").agg(F.min("df_id").alias("df_id"))
    top = firsts.orderBy("df_id").limit(limit)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("df_id", "UUID_STRING"))), lambda s: s["UUID_STRING"]), ",")
    return top.agg(joined.alias("uuids"), F.count("*").alias("n"))


def row_metadata(df: DataFrame, uuid: str) -> str:
    """JSON of the first row with this UUID; none is an error."""
    found = df.filter(F.col("UUID_STRING") == uuid).orderBy("df_id").limit(1).select(F.to_json(F.struct("*")).alias("row")).collect()
    if not found:
        raise KeyError(uuid)
    return found[0]["row"]
