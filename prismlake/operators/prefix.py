"""Running sums over groups of any size: sums within range partitions, moved by what lies before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def running_sum(df: DataFrame, value: str, order: list[str], group: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same ``group`` up to this one, in ``order``.

    Rows are range-partitioned by group and order and numbered as they lie. A window sees only the
    rows of one group in one such part; the parts' totals, one short row for each part and group, are summed
    up in turn and joined. So one group may fill any number of tasks. ``order`` should tell rows
    apart; rows alike in it follow each other in no stated order. Null is a group too.
    """
    keys = [F.col(f"`{c}`") for c in [group, *order]]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = stored(laid.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "running-sum")
    totals = marked.groupBy(F.col("_part").alias("_in"), F.col(f"`{group}`").alias("_of")).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy("_of").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_in", "_of", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = marked.withColumn("_run", F.sum(value).over(within))
    joined = summed.join(before, (F.col("_part") == F.col("_in")) & F.col(f"`{group}`").eqNullSafe(F.col("_of")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_run") + F.col("_before")).alias(name))
