"""A projection to the sphere that keeps neighbourhoods: landmarks placed by stress, all else by its nearest landmarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import l2_normalize
from ..functions.spatial import sphere_to_latlon
from ..scratch import stored
from .blocks import is_usable
from .schema import SEMANTIC_LAT, SEMANTIC_LON

#: Landmarks are at most so many vectors; each other vector is placed by so many of them.
LANDMARKS, NEAREST = 600, 4
#: Neighbours that draw a landmark towards them, and steps of the placing.
KEPT, ROUNDS = 12, 150


def place_landmarks(unit: np.ndarray, kept: int = KEPT, rounds: int = ROUNDS) -> np.ndarray:
    """Points on the sphere for unit vectors: near neighbours are drawn together, all others pushed apart.

    The start is the three principal components, so that the large structure stays. Each round moves
    points along the gradient of the neighbours' attraction and of a repulsion that falls with the
    square of the distance, within the tangent planes; steps shrink to nothing.
    """
    n = len(unit)
    centred = unit - unit.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]  # components have no sign of their own
    at = np.zeros((n, 3))
    at[:, : min(3, len(axes))] = centred @ axes[:3].T
    at += np.random.default_rng(5).normal(size=at.shape) * 1e-3
    at /= np.linalg.norm(at, axis=1)[:, None]
    if n <= 3:
        return at
    near = unit @ unit.T
    np.fill_diagonal(near, -np.inf)
    friends = np.argpartition(-near, min(kept, n - 1) - 1, axis=1)[:, : min(kept, n - 1)]
    pull = np.zeros((n, n))
    np.put_along_axis(pull, friends, 1.0, axis=1)
    pull = (pull + pull.T) / (2 * friends.shape[1])
    for k in range(rounds):
        gap2 = np.maximum(2 - 2 * at @ at.T, 0)
        push = 1 / (1 + 60 * gap2)
        np.fill_diagonal(push, 0)
        share = push**2 / push.sum()
        force = 4 * n * (share - pull * push / n)
        step = force.sum(1)[:, None] * at - force @ at
        step -= (step * at).sum(1)[:, None] * at  # within the tangent plane
        length = np.linalg.norm(step, axis=1)[:, None]
        at += step / np.maximum(length, 1e-12) * np.minimum(length, 0.15) * (1 - k / rounds)
        at /= np.linalg.norm(at, axis=1)[:, None]
    return at


def project_to_sphere_by_landmarks(df: DataFrame, vector_col: str = "SEMANTIC_EMBEDDING", landmarks: int = LANDMARKS, nearest: int = NEAREST) -> DataFrame:
    """Adds spherical coordinates of each vector that keep what is near it.

    About ``landmarks`` vectors, drawn by a hash of their content, are placed by ``place_landmarks``; their
    number bounds what the driver holds and is broadcast. Every other vector, where it is read, comes
    to the mean of its ``nearest`` landmarks, weighed by how near they are, so that equal vectors
    share a place. Vectors that are null or hold null or non-finite components get null, as do lengths
    of which no vector was drawn; a table of one vector gets (0, 0).
    """
    rows = df.withColumn("_unit", F.when(is_usable(vector_col), l2_normalize(F.col(vector_col))))
    some = stored(rows.filter(F.col("_unit").isNotNull()).select("_unit").distinct(), "landmark-vectors")
    total = some.count()
    drawn = some if total <= landmarks else some.withColumn("_draw", F.xxhash64("_unit")).orderBy("_draw").limit(landmarks).select("_unit")
    by_length: dict[int, list] = {}
    for v in sorted(r["_unit"] for r in drawn.collect()):  # in an order of their own, so that reruns agree
        by_length.setdefault(len(v), []).append(v)
    placed = {dims: (np.array(v), place_landmarks(np.array(v)) if len(v) > 1 else np.array([[0.0, 1.0, 0.0]])) for dims, v in by_length.items()}
    shared = df.sparkSession.sparkContext.broadcast(placed)
    place = len(df.columns)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = []
            for v in batch.column(place):
                unit = np.asarray(v.values, np.float64) if v.is_valid else None
                known = shared.value.get(len(unit)) if unit is not None else None
                if known is None:
                    points.append(None)
                    continue
                vectors, at = known
                gap = np.sqrt(np.maximum(0, 2 - 2 * vectors @ unit))
                top = np.argpartition(gap, min(nearest, len(gap)) - 1)[:nearest]
                weight = np.exp(-((gap[top] / max(np.median(gap[top]) * 0.8, 1e-9)) ** 2)) + 1e-12 if gap[top].min() > 1e-7 else (gap[top] <= 1e-7) * 1.0
                mean = weight @ at[top]
                norm = np.linalg.norm(mean)
                points.append((mean / norm if norm > 1e-12 else at[top[0]]).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(points, pa.list_(pa.float64()))], names=[*batch.schema.names[:place], "_point"])

    slim = rows.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(df.columns)], "_unit")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    out = slim.mapInArrow(put, f"{fields}, _point array<double>")
    p = F.col("_point")
    lat, lon = sphere_to_latlon(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p[2]))), F.atan2(p[1], p[0]))
    there = p.isNotNull()
    kept = [F.col(f"_{k}").alias(c) for k, c in enumerate(df.columns) if c not in (SEMANTIC_LAT, SEMANTIC_LON)]
    return out.select(*kept, F.when(there, lat).alias(SEMANTIC_LAT), F.when(there, lon).alias(SEMANTIC_LON))


def neighbour_overlap(vectors: np.ndarray, points: np.ndarray, k: int = 10) -> float:
    """The mean share of a vector's ``k`` nearest that are also among its point's ``k`` nearest."""
    def near(x: np.ndarray) -> np.ndarray:
        cosine = x @ x.T
        np.fill_diagonal(cosine, -np.inf)
        return np.argsort(-cosine, axis=1, kind="stable")[:, :k]

    return float(np.mean([len(set(a) & set(b)) / k for a, b in zip(near(vectors), near(points))]))
