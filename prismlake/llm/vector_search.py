"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tiles import is_usable, packed, tile_pairs

TILE_ROWS, QUERY_ROWS = 4096, 256


def _scores(data: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Whole-number inner products; through doubles where they are exact there."""
    if np.abs(data).max(initial=0) * np.abs(query).max(initial=0) * data.shape[1] < 2.0**53:
        return (data @ query).astype(np.int64)
    return data.astype(np.int64) @ query.astype(np.int64)


def threshold_search(data: np.ndarray, ids: np.ndarray, order: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of a block for one query, ties to the smaller id.

    ``order`` holds, per dimension, the rows by ascending value. Lists are read from the end that
    favours the query, a growing depth at a time; rows met are scored whole. Any row not met scores
    at most the sum over dimensions of the query's weight times the list's value at that depth, and
    the search stops when this cannot reach the kth score.
    """
    n, dims = data.shape
    active = np.flatnonzero(query)
    met = np.zeros(n, bool)
    score = np.zeros(n, np.int64)
    depth, before = min(n, max(k + 1, 64)), 0
    while True:
        fresh = np.zeros(n, bool)
        for d in active:
            fresh[order[d, before:depth] if query[d] < 0 else order[d, n - depth : n - before]] = True
        if not len(active):
            fresh[:] = True
            depth = n
        fresh &= ~met
        rows = np.flatnonzero(fresh)
        score[rows] = _scores(data[rows], query)
        met |= fresh
        seen = np.flatnonzero(met & (ids != own))
        enough = len(seen) >= k
        if enough:
            least = np.partition(score[seen], len(seen) - k)[len(seen) - k]
        if depth == n:
            break
        edge = np.where(query[active] < 0, data[order[active, depth - 1], active], data[order[active, n - depth], active])
        if enough and float((query[active] * edge).sum()) < least:
            break
        before, depth = depth, min(n, depth * 4)
    if not len(seen):
        return []
    best = seen[score[seen] >= least] if enough else seen
    best = best[np.lexsort((ids[best], -score[best]))][:k]
    return [(int(score[b]), int(ids[b])) for b in best]


def _asked(row: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """(id, hash of the vector, vector) of each query of a block: rows of one id that differ are ranked apart."""
    for own, query in zip(np.frombuffer(row["ids_a"], "<i8").tolist(), np.frombuffer(row["data_a"], "<f8").reshape(-1, row["dims"])):
        yield own, int.from_bytes(xxhash.xxh64_digest(query.tobytes()), "big", signed=True), query


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row of ``queries`` the ``k`` rows of ``vectors`` with the highest integer inner product.

    Components become floor(scale * x). Columns: query_id, rank (from 1), ``id_col``, score; ties go
    to the smaller id; a query never finds its own id; fewer than ``k`` candidates are all
    returned. Candidates are packed in blocks with their sorted lists; each block answers a block of
    queries by the threshold algorithm, and the blocks' answers, k a query, are ranked. Null ids,
    and vectors that are null, empty, or hold null or non-finite components, take no part; vectors
    of another length are not candidates. Rows that repeat an id are candidates each; equal query
    rows are asked once, and rows of one id with different vectors are ranked apart. Other columns
    are ignored, whatever their names.
    """
    def whole(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
        return rows.filter(F.col("id").isNotNull() & is_usable("v")).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))

    def with_lists(data: np.ndarray) -> bytes:
        return data.tobytes() + np.argsort(data, axis=0, kind="stable").T.astype("<i2").tobytes()

    # rows alike in id and vector ask the same question
    pairs = tile_pairs(packed(whole(queries).distinct(), QUERY_ROWS, "search-queries"), packed(whole(vectors), TILE_ROWS, "search-blocks", data=with_lists), ordered=False)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dims = row["dims"]
                ids = np.frombuffer(row["ids_b"], "<i8")
                data = np.frombuffer(row["data_b"], "<f8", len(ids) * dims).reshape(-1, dims)
                order = np.frombuffer(row["data_b"], "<i2", len(ids) * dims, len(ids) * dims * 8).reshape(dims, -1)
                found = [(own, key, *hit) for own, key, query in _asked(row) for hit in threshold_search(data, ids, order, query, own, k)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["query_id", "query_key", "score", "id"])

    found = pairs.mapInArrow(search, "query_id long, query_key long, score long, id long")
    by_score = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
