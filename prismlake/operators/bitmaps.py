"""Selections as bitmaps of row numbers: chains of selections and bucket counts without reading the base again."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .bucketing import fill_group_unknown

#: Rows of a block, whose numbers are the bits of one bitmap; fixed by Spark's bitmap functions.
BLOCK_ROWS = 32_768


def _combined(pairs: DataFrame, keep: list[str], negate: bool) -> DataFrame:
    """``keep`` and ``bitmap`` of rows (keep.., bitmap, other): AND, or AND NOT where ``negate``; empty results go."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("bitmap"), batch.column("other")
            out = []
            for mine, other in zip(a, b):
                bits = np.frombuffer(mine.as_buffer(), np.uint8)
                if other.is_valid:
                    theirs = np.frombuffer(other.as_buffer(), np.uint8)
                    bits = bits & (~theirs if negate else theirs)
                elif not negate:
                    bits = bits[:0]
                out.append(bits.tobytes() if bits.any() else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "bitmap"])

    fields = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep)
    return pairs.select(*keep, "bitmap", "other").mapInArrow(combine, f"{fields}, bitmap binary").filter("bitmap is not null")


@dataclass(frozen=True)
class BitmapIndex:
    """For each bucket of a level (and group, null as "Unknown") and each block of row numbers, the bitmap of its rows.

    ``rows`` has ``target``, ``_group``, ``block``, ``bitmap``. Bitmaps of buckets with few rows in a block are
    nearly all zeros, which the stored table holds compressed.
    """

    rows: DataFrame
    everything: DataFrame
    target: str
    group: str | None
    id_col: str

    @classmethod
    def of(cls, base: DataFrame, target: str, group: str | None = None, id_col: str = "df_id") -> BitmapIndex:
        """Index ``base``, whose ``id_col`` are numbers from 0 on, in one pass. Rows without a bucket are in no bitmap but that of everything."""
        for c in filter(None, [target, group]):
            if c not in base.columns:
                raise KeyError(f"no column {c}")
        block, bit = F.floor(F.col(id_col) / BLOCK_ROWS).cast("long"), F.pmod(F.col(id_col), F.lit(BLOCK_ROWS)).cast("long")
        named = base.select(F.col(f"`{target}`").alias("target"), (fill_group_unknown(group) if group else F.lit("")).alias("_group"), block.alias("block"), bit.alias("bit"))
        rows = stored(named.groupBy("target", "_group", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap")), "bitmap-index", compression="zstd")
        everything = stored(rows.groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("bitmap")), "bitmap-all")
        return cls(rows.filter("target is not null"), everything, target, group, id_col)

    def picked(self, picked: DataFrame) -> DataFrame:
        """(block, bitmap) of the rows in the picked buckets, which hold ``target`` and ``group`` columns."""
        keys = picked.select(F.col(f"`{self.target}`").alias("target"), (fill_group_unknown(self.group) if self.group else F.lit("")).alias("_group")).distinct()
        return self.rows.join(keys, ["target", "_group"], "left_semi").groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))

    def kept(self, selection: DataFrame, picked: DataFrame) -> DataFrame:
        """``selection`` AND the picked buckets."""
        return narrowed(selection, self.picked(picked), keep=True)

    def without(self, selection: DataFrame, picked: DataFrame) -> DataFrame:
        """``selection`` AND NOT the picked buckets."""
        return narrowed(selection, self.picked(picked), keep=False)

    def buckets(self, selection: DataFrame) -> DataFrame:
        """(target, group if any, COUNT, first id) of each bucket of the selected rows, from bitmaps alone.

        The same buckets, counts and ids as ``bucket_by_column`` gives for the rows themselves.
        """
        within = _combined(self.rows.join(selection.withColumnRenamed("bitmap", "other"), "block"), ["target", "_group", "block"], negate=False)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                firsts = [int(np.unpackbits(np.frombuffer(b.as_buffer(), np.uint8), bitorder="little").argmax()) for b in batch.column(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(firsts, pa.int64()), batch.column(3)], names=["target", "_group", "block", "bit", "bitmap"])

        kind = within.schema["target"].dataType.simpleString()
        measured = within.mapInArrow(measure, f"target {kind}, _group string, block long, bit long, bitmap binary")
        summed = measured.groupBy("target", "_group").agg(F.sum(F.bitmap_count("bitmap")).alias("COUNT"), F.min(F.col("block") * BLOCK_ROWS + F.col("bit")).alias(self.id_col))
        group = [F.col("_group").alias(self.group)] if self.group else []
        return summed.select(F.col("target").alias(self.target), *group, "COUNT", self.id_col)


def bitmaps_of(ids: DataFrame, id_col: str = "df_id") -> DataFrame:
    """(block, bitmap) of these row numbers."""
    block, bit = F.floor(F.col(id_col) / BLOCK_ROWS).cast("long"), F.pmod(F.col(id_col), F.lit(BLOCK_ROWS)).cast("long")
    return ids.select(block.alias("block"), bit.alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def narrowed(selection: DataFrame, other: DataFrame, keep: bool) -> DataFrame:
    """``selection`` AND ``other``, or AND NOT; both are (block, bitmap)."""
    pairs = selection.join(other.withColumnRenamed("bitmap", "other"), "block", "inner" if keep else "left")
    return stored(_combined(pairs, ["block"], negate=not keep), "bitmap-selection")


def selected_rows(base: DataFrame, selection: DataFrame, id_col: str = "df_id") -> DataFrame:
    """The base rows whose bits are set."""
    of = selection.select(F.col("block").alias("_block"), F.col("bitmap").alias("_bitmap"))
    joined = base.join(of, F.floor(F.col(id_col) / BLOCK_ROWS) == F.col("_block"))
    bit = F.pmod(F.col(id_col), F.lit(BLOCK_ROWS))
    byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.filter(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1).drop("_block", "_bitmap")


def count_selected(selection: DataFrame) -> int:
    return selection.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0))).first()[0]
