"""Vectors packed into tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.blocks import is_usable, tile_pairs
from .common import stored

__all__ = ["is_usable", "packed", "tile_pairs"]


def packed(vectors: DataFrame, rows: int, label: str, **contents: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(tile, dims, ids) and a column for each of ``contents``: up to ``rows`` vectors (id, vector of doubles) of one length a row.

    ``contents`` make the columns of a tile's vectors, by default ``data``, their doubles. Tiles are cut from each partition, numbered in it,
    and stored, so their numbers stay.
    """
    made_of = contents or {"data": np.ndarray.tobytes}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, made = context.partitionId() if context else 0, 0
        held: dict[int, tuple[list, list]] = {}

        def tile(dims: int) -> pa.RecordBatch:
            nonlocal made
            ids, data = held.pop(dims)
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([dims], pa.int32()), pa.array([np.asarray(ids, "<i8").tobytes()]), *(pa.array([of(np.asarray(data, "<f8"))]) for of in made_of.values())], names=["tile", "dims", "ids", *made_of])

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.asarray(vector.values, np.float64)
                ids, data = held.setdefault(len(values), ([], []))
                ids.append(vec_id)
                data.append(values)
                if len(ids) == rows:
                    yield tile(len(values))
        for dims in list(held):
            yield tile(dims)

    return stored(vectors.mapInArrow(pack, "tile long, dims int, ids binary" + "".join(f", {name} binary" for name in made_of)), label)
