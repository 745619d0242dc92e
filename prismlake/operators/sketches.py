"""Level choice for a subset from stored sketches, without reading its rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spatial import LEVELS
from ..scratch import stored
from .bucketing import drop_missing
from .schema import TIME_LEVELS, bucket_column_name
from .selection import filter_to_buckets, subtract_buckets

#: Registers of a sketch are 2**LG_K; its standard error is 1.04 / sqrt(2**LG_K), and SLACK is beyond four of these.
LG_K, SLACK = 12, 0.07
#: The time level that sketches are kept by; selections by it or a coarser one can be followed.
KEPT_BY = "HOUR"


def family_columns(family: str) -> list[str]:
    """The bucket columns of a family, finest first."""
    return [bucket_column_name("time", u) for u in TIME_LEVELS] if family == "time" else [bucket_column_name(family, k) for k in reversed(range(LEVELS))]


def _inputs(family: str) -> Column:
    found = F.lit(True)
    for c in {"geo": ["GPS_LATITUDE", "GPS_LONGITUDE"], "time": ["TIMESTAMP_UTC"], "semantic": ["SEMANTIC_EMBEDDING_UMAP_LATITUDE", "SEMANTIC_EMBEDDING_UMAP_LONGITUDE"]}[family]:
        found = found & F.col(c).isNotNull()
    return found


@dataclass(frozen=True)
class LevelSketches:
    """Sketches of the distinct buckets of each level, by hour and group, of a base table or a subset of it.

    ``rows`` has one row an hour and group: the time buckets from the hour up, the group, and of each family the
    number of rows with its inputs and one sketch a level.
    """

    rows: DataFrame
    families: tuple[str, ...]
    group: str | None

    @classmethod
    def of(cls, base: DataFrame, families: tuple[str, ...], group: str | None = None) -> LevelSketches:
        """Sketch ``base``, which has its bucket columns, in one pass, and store the sketches."""
        by = [bucket_column_name("time", u) for u in TIME_LEVELS[TIME_LEVELS.index(KEPT_BY) :]]
        aggs = []
        for family in families:
            there = _inputs(family)
            aggs.append(F.count_if(there).alias(f"_rows_{family}"))
            aggs += [F.hll_sketch_agg(F.when(there, F.xxhash64(c)), LG_K).alias(f"_sketch_{c}") for c in family_columns(family)]
        return cls(stored(base.groupBy(*by, *([group] if group else [])).agg(*aggs), "level-sketches"), families, group)

    def can_follow(self, level: str, group: str | None) -> bool:
        return level in self.rows.columns and group in (None, self.group)

    def kept(self, picked: DataFrame, level: str, group: str | None) -> LevelSketches:
        """The sketches of the rows in the picked time buckets."""
        return LevelSketches(filter_to_buckets(self.rows, picked, level, group), self.families, self.group)

    def without(self, picked: DataFrame, level: str, group: str | None) -> LevelSketches:
        """The sketches of the rows outside the picked time buckets."""
        return LevelSketches(subtract_buckets(self.rows, picked, level, group), self.families, self.group)

    def level(self, family: str, max_rows: int, subset: DataFrame) -> str | None:
        """What ``finest_fitting`` chooses for ``subset``, whose sketches these are.

        Estimates settle all levels but those within ``SLACK`` of the budget; only for such a level
        ``subset`` is read, and one column of it counted.
        """
        columns = family_columns(family)
        seen = self.rows.agg(F.coalesce(F.sum(f"_rows_{family}"), F.lit(0)).alias("_rows"), *[F.hll_sketch_estimate(F.hll_union_agg(f"_sketch_{c}")).alias(c) for c in columns]).first()
        if seen["_rows"] <= max_rows:
            return None
        for column in columns:
            found = seen[column] or 0
            if found > max_rows * (1 + SLACK):
                continue
            if found < max_rows * (1 - SLACK) or drop_missing(subset, family).agg(F.count_distinct(column)).first()[0] <= max_rows:
                return column
        return columns[-1]
