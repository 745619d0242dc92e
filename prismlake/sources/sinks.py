"""Sinks: Parquet, keyed merge with schema evolution, unique keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import validate_identifier
from ..scratch import stored


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def assert_unique_key(df: DataFrame, key: str) -> DataFrame:
    """``df``, or an error with some of the repeated keys."""
    twice = df.groupBy(key).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError("repeated keys: " + ", ".join(f"{r[0]} ({r[1]})" for r in twice))
    return df


def last_rows(new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Of the rows of each key the last by ``order``; null is a key too.

    Without ``order``, and where it ties, a later row of the frame wins, as its partitions are
    numbered. Keys are aggregated and joined by hash; no window holds a key's rows together.
    """
    # written, so that places are the same where they are aggregated and where they are joined
    placed = stored(new.withColumn("_place", F.struct(*([F.col(f"`{order}`")] if order else []), F.monotonically_increasing_id())), "merge-new")
    last = placed.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max("_place").alias("_last"))
    return placed.join(last, F.col(f"`{key}`").eqNullSafe(F.col("_key")) & (F.col("_place") == F.col("_last"))).select(*[F.col(f"`{c}`") for c in new.columns])


def merged(old: DataFrame | None, new: DataFrame, key: str, order: str | None = None, mode: str = "replace") -> DataFrame:
    """Rows of both by key: the new row wins whole; of several new rows the last (see ``last_rows``).

    Columns of either side are kept; those a new row lacks become null, or with ``mode="patch"`` keep
    the old value. A null key is a key like any other: a new row without a key replaces the old one
    without a key.
    """
    if not new.columns:
        raise ValueError("the incoming frame has no columns")
    for c in new.columns:
        validate_identifier(c)
    new = last_rows(new, key, order)
    return new if old is None else _over(old, new, key, mode)


def _over(old: DataFrame, new: DataFrame, key: str, mode: str) -> DataFrame:
    """``old`` with the rows of ``new``, whose keys are unique."""
    if mode == "patch":
        o = old.select(*[F.col(f"`{c}`").alias(f"_old_{c}") for c in old.columns], F.lit(True).alias("_was"))
        n = new.withColumn("_is", F.lit(True))
        both = n.join(o, F.col(key).eqNullSafe(F.col(f"_old_{key}")), "full")
        names = [*old.columns, *[c for c in new.columns if c not in old.columns]]
        pick = [F.coalesce(*([F.col(f"`{c}`")] if c in new.columns else []), *([F.col(f"`_old_{c}`")] if c in old.columns else [])).alias(c) for c in names]
        return both.select(*pick)
    replaced = new.select(F.col(f"`{key}`").alias("_key"))
    rest = old.join(replaced, F.col(f"`{key}`").eqNullSafe(F.col("_key")), "left_anti")
    return rest.unionByName(new, allowMissingColumns=True)
