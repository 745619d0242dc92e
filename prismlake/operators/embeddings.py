"""The embedding pipeline: what is missing, batches through a user's model, search, sphere projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import dot, l2_normalize
from ..functions.spatial import sphere_to_latlon
from ..scratch import scratch_path, stored
from .blocks import is_usable, tile_pairs
from .schema import SEMANTIC_LAT, SEMANTIC_LON

#: Vectors in a block.
QUERY_ROWS, ITEM_ROWS = 256, 4096
#: Parts of an embedding job, each committed by itself.
RANGES = 8


def missing_embeddings(items: DataFrame, known: DataFrame, recompute: bool = False) -> DataFrame:
    return items if recompute else items.join(known.select("UUID_STRING").distinct(), "UUID_STRING", "left_anti")


def embed(items: DataFrame, column: str, embedder: Callable[[list], list], batch: int = 10) -> DataFrame:
    """(UUID_STRING, SEMANTIC_EMBEDDING): ``embedder`` maps a list of values to vectors, None for those it cannot read."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"UUID_STRING": part["UUID_STRING"].to_numpy(), "SEMANTIC_EMBEDDING": embedder(list(part[column]))})

    return items.select("UUID_STRING", column).mapInPandas(run, "UUID_STRING string, SEMANTIC_EMBEDDING array<float>")


def embed_incremental(items: DataFrame, known: DataFrame, column: str, embedder: Callable[[list], list], recompute: bool = False) -> DataFrame:
    return embed(missing_embeddings(items, known, recompute), column, embedder)


def embed_into(items: DataFrame, path: str, column: str, embedder: Callable[[list], list], recompute: bool = False, ranges: int = RANGES) -> int:
    """Embed the items that the keyed table at ``path`` lacks and merge them in by UUID; returns how many.

    Missing items are written once, in ``ranges`` parts by the table's buckets, and each part is
    embedded and committed by itself: a job that dies loses the part at hand, and the next run finds
    the finished ones in the table. Items that cannot be read are left for the next run; if none of them
    can, that is an error.
    """
    from ..sources.keyed_table import BUCKETS, bucket_of, layout_of, read_keyed, upsert
    from ..sources.sinks import exists

    spark = items.sparkSession
    layout = layout_of(spark, path)
    buckets = layout["buckets"] if layout else BUCKETS
    known = read_keyed(spark, path) if exists(spark, path) else items.limit(0)
    todo = scratch_path(spark, "to-embed")
    # a bucket belongs to one part, so it is written again once
    part = F.pmod(bucket_of("UUID_STRING", buckets), F.lit(ranges))
    missing_embeddings(items, known, recompute).select("UUID_STRING", column, part.alias("_part")).write.partitionBy("_part").parquet(todo)
    rows = spark.read.schema(T.StructType([*items.select("UUID_STRING", column).schema, T.StructField("_part", T.IntegerType())])).parquet(todo)
    tried = read = 0
    for n in range(ranges):
        found = stored(embed(rows.filter(F.col("_part") == n), column, embedder), "embedded")
        some, good = found.agg(F.count("*"), F.count("SEMANTIC_EMBEDDING")).first()
        tried, read = tried + some, read + good
        if good:
            upsert(found.filter("SEMANTIC_EMBEDDING is not null"), path, "UUID_STRING", buckets=buckets)
    if tried and not read:
        raise ValueError(f"none of {tried} items could be read")
    return read


def image_stats(pixels: list) -> list:
    """Mean and deviation of red, green and blue over 0..1, of unit length; None for what is not an image."""
    out = []
    for p in pixels:
        if p is None or len(p["data"]) != p["height"] * p["width"] * p["nChannels"] or p["nChannels"] < 3:
            out.append(None)
            continue
        a = np.frombuffer(p["data"], np.uint8).reshape(-1, p["nChannels"])[:, 2::-1] / 255.0  # stored blue first
        v = np.r_[a.mean(0), a.std(0)]
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32).tolist())
    return out


def drop_empty_embeddings(df: DataFrame) -> DataFrame:
    return df.dropna(subset=[SEMANTIC_LAT, SEMANTIC_LON])


def attach_projection(items: DataFrame, coordinates: DataFrame) -> DataFrame:
    from ..sources.sinks import assert_unique_key

    return items.join(assert_unique_key(coordinates, "UUID_STRING"), "UUID_STRING", "left")


def _blocks(vectors: DataFrame, rows: int, label: str) -> DataFrame:
    """(tile, dims, ids, data): up to ``rows`` vectors (id, vector of doubles) of one length a row, in order of id.

    The ids keep their type. Blocks are cut from each partition, numbered in it, and stored, so their
    numbers stay.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, made = context.partitionId() if context else 0, 0
        held: dict[int, tuple[list, list]] = {}

        def block(dims: int, kind: pa.DataType) -> pa.RecordBatch:
            nonlocal made
            ids, data = held.pop(dims)
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([dims], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([np.asarray(data, "<f8").tobytes()])], names=["tile", "dims", "ids", "data"])

        kind = pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for row_id, vector in zip(batch.column(0), batch.column(1)):
                values = np.asarray(vector.values, np.float64)
                ids, data = held.setdefault(len(values), ([], []))
                ids.append(row_id.as_py())
                data.append(values)
                if len(ids) == rows:
                    yield block(len(values), kind)
        for dims in list(held):
            yield block(dims, kind)

    id_type = vectors.schema["id"].dataType.simpleString()
    return stored(vectors.sortWithinPartitions("id").mapInArrow(pack, f"tile long, dims int, ids array<{id_type}>, data binary"), label)


def nearest(queries: np.ndarray, items: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``queries`` the places and distances of the ``k`` nearest ``items``, ties to the earlier place.

    One matrix product finds the candidates with a margin for its rounding; their distances are summed
    again one by one, in the same order for equal vectors, so that equal vectors tie.
    """
    near = queries @ items.T
    for query, row in zip(queries, near):
        at = np.arange(len(items))
        if len(items) > k:
            at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - 1e-9)
        distance = 1 - (items[at] * query).sum(1)
        best = np.lexsort((at, distance))[:k]
        yield at[best], distance[best]


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest ``items`` of each query by cosine distance, for any number of queries.

    Queries and items are packed in blocks; each pair of blocks is one task's matrix product that
    returns the block's ``k`` best of each query, and Spark ranks the blocks' answers. Work grows with
    queries times items. Vectors that are null, empty, or hold null or non-finite components take no
    part; vectors of another length are not candidates; a zero vector is at distance 1 of all.
    """
    def unit(df: DataFrame) -> DataFrame:
        return df.filter(is_usable(vector_col)).select(F.col(id_col).alias("id"), l2_normalize(F.col(vector_col)).alias("v"))

    pairs = tile_pairs(_blocks(unit(queries), QUERY_ROWS, "cosine-queries"), _blocks(unit(items), ITEM_ROWS, "cosine-items"), ordered=False)
    kinds = [df.schema[id_col].dataType.simpleString() for df in (queries, items)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            for n in range(batch.num_rows):
                of = {name: batch.column(c)[n] for name, c in at.items()}
                dims = of["dims"].as_py()
                q, v = (np.frombuffer(of[c].as_py(), "<f8").reshape(-1, dims) for c in ("data_a", "data_b"))
                places, distances = zip(*nearest(q, v, k))
                whose = np.repeat(np.arange(len(q)), [len(p) for p in places])
                yield pa.RecordBatch.from_arrays([of["ids_a"].values.take(pa.array(whose)), of["ids_b"].values.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(distances))], names=["query_id", "id", "distance"])

    found = pairs.mapInArrow(search, f"query_id {kinds[0]}, id {kinds[1]}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("id").alias(id_col), "distance", "rank")


def project_to_sphere(df: DataFrame, vector_col: str = "SEMANTIC_EMBEDDING") -> DataFrame:
    """Adds spherical coordinates of each vector: three principal components of the unit vectors, on the unit sphere.

    Null vectors get null; a table of one vector gets (0, 0). The three components keep the large
    structure of the vectors, not their neighbourhoods.
    """
    some = df.filter(F.col(vector_col).isNotNull())
    n = some.limit(2).count()
    if n < 2:
        zero = F.when(F.col(vector_col).isNotNull(), F.lit(0.0))
        return df.withColumns({SEMANTIC_LAT: zero, SEMANTIC_LON: zero})
    unit = array_to_vector(l2_normalize(F.col(vector_col)))
    model = PCA(k=3, inputCol="_unit", outputCol="_pc").fit(some.select(unit.alias("_unit")))
    placed = model.transform(some.withColumn("_unit", unit)).withColumn("_p", l2_normalize(vector_to_array("_pc")))
    lat, lon = sphere_to_latlon(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_p")[2]))), F.atan2(F.col("_p")[1], F.col("_p")[0]))
    done = placed.withColumns({SEMANTIC_LAT: lat, SEMANTIC_LON: lon}).drop("_unit", "_pc", "_p")
    return done.unionByName(df.filter(F.col(vector_col).isNull()), allowMissingColumns=True)
