"""The landmark projection keeps more neighbours than the linear one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismlake.operators.embeddings import project_to_sphere
from prismlake.operators.landmarks import neighbour_overlap, place_landmarks, project_to_sphere_by_landmarks
from prismlake.operators.schema import SEMANTIC_LAT, SEMANTIC_LON


def points_of(rows):
    lat, lon = np.radians([r[SEMANTIC_LAT] for r in rows]), np.radians([r[SEMANTIC_LON] for r in rows])
    return np.c_[np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]


def clustered(rng, n, dims, clusters, noise):
    x = rng.normal(size=(clusters, dims))[np.arange(n) % clusters] + rng.normal(size=(n, dims)) * noise
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("n, dims, clusters, noise, landmarks", [(100, 6, 3, 0.3, 600), (300, 24, 30, 0.4, 120)])
def test_more_neighbours_stay_than_linearly(spark, n, dims, clusters, noise, landmarks):
    x = clustered(np.random.default_rng(2), n, dims, clusters, noise)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "SEMANTIC_EMBEDDING": x.tolist()}))
    rows = sorted(project_to_sphere_by_landmarks(df, landmarks=landmarks).collect(), key=lambda r: r.i)
    linear = sorted(project_to_sphere(df).collect(), key=lambda r: r.i)
    assert all(-90 <= r[SEMANTIC_LAT] <= 90 and -180 <= r[SEMANTIC_LON] <= 180 for r in rows)
    own, before = neighbour_overlap(x, points_of(rows)), neighbour_overlap(x, points_of(linear))
    assert own > before + 0.05
    again = sorted(project_to_sphere_by_landmarks(df.repartition(3), landmarks=landmarks).collect(), key=lambda r: r.i)
    assert np.allclose(points_of(rows), points_of(again), atol=1e-6)


def test_odd_vectors(spark):
    rows = [(0, None), (1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [float("nan"), 1.0, 1.0]), (4, [-1.0, 0.5, 0.1]), (5, [0.3, -0.5, 0.1]), (6, [0.0, 0.0, 0.0]), (7, [])]
    df = spark.createDataFrame(rows, "i int, SEMANTIC_EMBEDDING array<double>").withColumn(SEMANTIC_LAT, F.lit("replaced"))
    got = {r.i: (r[SEMANTIC_LAT], r[SEMANTIC_LON]) for r in project_to_sphere_by_landmarks(df).collect()}
    assert got[0] == got[3] == got[7] == (None, None) and got[1] == got[2] != got[4] and None not in got[6]
    one = project_to_sphere_by_landmarks(df.filter("i = 1")).first()
    assert abs(one[SEMANTIC_LAT]) < 1e-9 and abs(one[SEMANTIC_LON]) < 1e-9
    assert project_to_sphere_by_landmarks(df.limit(0)).count() == 0
    assert place_landmarks(np.eye(3)).shape == (3, 3)
