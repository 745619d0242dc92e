"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken at most so many times, a source to at most so many times its size.
MOST_COPIES = 3
#: A document of more than this share of its source's target is taken a settled number of times.
LARGE_SHARE = 0.001


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source of ``sized`` (source, size): source_size and target.

    The total size is shared by weight; a target stops at ``most`` times its source's size and what
    is over is shared again among the rest. The fixed point is ``least(most * size, level * weight)``
    for one water level, found by ordering the sources by the level at which each is full. The
    table has one row a source, so its windows are small whatever the corpus.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    capped = weighed.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    leveled = (
        capped.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        .withColumn("level", (F.col("total") - F.col("spent")) / F.col("open_weight"))
    )
    # the level is that of the first source, in this order, that it does not fill
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    return leveled.withColumn("water", level).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight")).alias("target"))


def _places(rows: DataFrame) -> DataFrame:
    """Global place of each row within its source, in order of size and id.

    Rows are range-partitioned by (source, size, id), numbered within each partition as they lie
    there, and shifted by the counts of the partitions before: one source may fill any number of tasks.
    """
    order = ["source", "size", "id", "row_key"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(ordered.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "mixing-places")
    counts = numbered.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col("part").alias("in_part"), F.col("source").alias("of"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    joined = numbered.join(shifts, (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.select(*rows.columns, (F.col("place") + F.col("shift")).alias("place"))


def _crossed(place: Column, rate: Column, offset: Column) -> Column:
    """How many whole numbers the prefix sum of expected copies, moved by the offset, crosses at a row."""
    return F.floor((place + 1) * rate + offset) - F.floor(place * rate + offset)


def _whole_copies(large: DataFrame, most: int) -> DataFrame:
    """Rows (id, source, size, row_key, source_size, target) with ``copies``, whole numbers whose words follow the expected ones.

    From the largest document down, each is taken so often that the words taken come nearest to those
    expected so far, so what one has too much the next ones have too little. A source has fewer than
    ``1 / LARGE_SHARE`` times source_size / target such documents.
    """

    def settle(group: pa.Table) -> pa.Table:
        ordered = group.sort_by([("size", "descending"), ("id", "ascending"), ("row_key", "ascending")])
        rate = ordered["target"][0].as_py() / ordered["source_size"][0].as_py()
        expected, taken, copies = 0.0, 0, []
        for size in ordered["size"].to_pylist():
            expected += rate * size
            copies.append(min(most, max(0, math.floor((expected - taken) / size + 0.5))))
            taken += copies[-1] * size
        return ordered.append_column("copies", pa.array(copies, pa.int64()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in large.schema.fields)
    return large.groupBy("source").applyInArrow(settle, f"{fields}, copies long")


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document is taken so that each source comes near its target of words.

    Columns: id, ``size`` (words of the text, 0 for null), ``source_size``, ``target``, ``copies``,
    ``taken`` (copies * size), ``source`` and ``row_key`` (hash of the text). Documents of more than
    ``LARGE_SHARE`` of their source's target are expected a whole number of times (``_whole_copies``),
    so drawing adds no error for them. The others share what is left of the target evenly: they are
    ordered by size and id, the prefix sum of expected copies is place times their rate, and with
    one random offset a source, a document is emitted once per integer that its running sum crosses.
    Neighbours in this order are alike in size, so the words taken miss the target by about one of
    these small documents; a source of few documents, or of large ones only, misses it by what
    their sizes leave open. Every number depends on the rows and the seed alone. Null sources form one
    source, placed last; a source without words takes nothing; ties in size go by id, then text;
    repeated rows count each; texts of any length count whole; other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    sized = stored(docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("row_key"),
    ), "mixing-sizes")
    targets = stored(source_targets(sized, weights, most).withColumnRenamed("source", "of"), "mixing-targets")
    aimed = sized.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").select("id", "source", "size", "row_key", "source_size", "target")
    is_large = F.col("size") > F.col("target") * LARGE_SHARE
    large = stored(_whole_copies(aimed.filter(is_large & (F.col("size") > 0)), most), "mixing-large")
    small = _places(aimed.filter(~is_large | (F.col("size") == 0)))

    # one row a source
    spent = large.groupBy(F.col("source").alias("_of")).agg(F.sum(F.col("copies") * F.col("size")).alias("spent"), F.sum("size").alias("held"))
    left = targets.join(spent, F.col("of").eqNullSafe(F.col("_of")), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("spent", "held")})
    open_size = F.col("source_size") - F.col("held")
    rates = left.select("of", F.when(open_size > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), (F.col("target") - F.col("spent")) / open_size))).otherwise(F.lit(0.0)).alias("rate"))
    offset = F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = small.join(rates, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("copies", F.least(_crossed(F.col("place"), F.col("rate"), offset), F.lit(most)).cast("long"))
    names = ["id", "size", "source_size", "target", "copies", "source", "row_key"]
    every = drawn.select(*names).unionByName(large.select(*names))
    return every.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "row_key")


def emit(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` takes it, in the columns of ``docs``, whatever their names.

    Rows alike in id, text and source share what they are taken together evenly, in the order of a
    hash of the whole row. Only such rows, repeats of one document, are ordered within their group.
    """
    names = [f"_{k}" for k in range(len(docs.columns))]
    held = dict(zip(docs.columns, names))
    rows = docs.toDF(*names)
    rows = rows.withColumns({"row_key": F.xxhash64(held[text_col]), "draw": row_hash(rows)})
    times = mixed.groupBy(F.col(id_col).alias("id"), F.col("row_key").alias("key"), "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("alike")).filter("copies > 0")
    same = F.col(held[id_col]).eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key")) & F.col(held[source_col]).cast("string").eqNullSafe(F.col("source"))
    kept = rows.join(times, same)
    nth = F.row_number().over(Window.partitionBy("id", "key", "source").orderBy("draw"))
    shared = (F.floor(F.col("copies") * nth / F.col("alike")) - F.floor(F.col("copies") * (nth - 1) / F.col("alike"))).cast("long")
    apart = kept.filter("alike > 1").withColumn("copies", shared).select(*names, "copies")
    total = kept.filter("alike = 1").select(*names, "copies").unionByName(apart)
    return total.select(*names, F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).select(*names).toDF(*docs.columns)
