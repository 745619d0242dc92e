"""Usable vectors, and pairs of blocks of vectors dealt to tasks by an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The list of pairs of numbers is worked out in so many parts.
PAIR_PARTS = 64


def is_usable(vector_col: str) -> Column:
    """Neither null nor empty, and no component null or not finite."""
    v = F.col(vector_col)
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def tile_pairs(left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
    """Each block of ``left`` beside each block of ``right`` with as many dimensions, one pair a row.

    Blocks are rows (tile, dims, ids, data). The pairs of tile numbers come from a join on ``dims`` and
    a share of the right numbers, so no task lists them all; contents are joined to them by number.
    With ``ordered`` a pair of one table comes once, either way round by a hash, so that each tile is
    on either side about as often.
    """
    a = left.select("dims", F.col("tile").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(PAIR_PARTS - 1))).alias("part"))
    b = right.select(F.col("dims").alias("dims_b"), F.col("tile").alias("b"), F.pmod(F.xxhash64("tile"), F.lit(PAIR_PARTS)).cast("int").alias("part_b"))
    on = (F.col("dims") == F.col("dims_b")) & (F.col("part") == F.col("part_b"))
    if ordered:
        turned = F.pmod(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), F.lit(2)) == 0
        on = on & ((F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) == turned))
    return with_contents(a.join(b, on).select("dims", "a", "b"), left, right)


def with_contents(numbers: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of numbers (dims, a, b) with the ids and data of both blocks."""
    with_a = numbers.join(left.select(F.col("tile").alias("a"), F.col("ids").alias("ids_a"), F.col("data").alias("data_a")), "a")
    both = with_a.join(right.select(F.col("tile").alias("b"), F.col("ids").alias("ids_b"), F.col("data").alias("data_b")), "b")
    return both.select("dims", "a", "b", "ids_a", "data_a", "ids_b", "data_b")
