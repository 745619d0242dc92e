"""Each test holds a part of the code to the whole of its input."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from prismlake.operators.embeddings import cosine_topk
from prismlake.plans.queries import QUERIES


def test_geo_view_takes_every_located_event(spark, tmp_path):
    n = 400
    ids = np.arange(n)
    events = pd.DataFrame({"event_id": ids, "ts": pd.Timestamp("2024-01-01"), "event_type": "click", "user_id": ids % 7, "value": 1.0})
    spark.createDataFrame(events).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["geo_view"](spark, str(tmp_path)).first()
    ids = ids[ids % 50 != 0]
    lat, lon = np.radians((ids * 7919) % 180001 / 1000 - 90), np.radians((ids * 104729) % 360001 / 1000 - 180)
    points = np.c_[np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]
    x, y, z = points.mean(0)
    centre = points.mean(0) / np.linalg.norm(points.mean(0))
    assert got.points == len(ids) and (lat < 0).any()
    assert abs(got.center_lat - np.degrees(np.arctan2(z, np.hypot(x, y)))) < 1e-3 and abs(got.center_lon - np.degrees(np.arctan2(y, x))) < 1e-3
    assert abs(got.radius_km - 6371 * np.arccos(np.clip(points @ centre, -1, 1)).max()) < 0.1


def test_cosine_topk_answers_any_number_of_queries(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(60, 6)), 2)
    vectors[40:] = vectors[:20]  # ties go to the smaller id
    items = spark.createDataFrame([(f"v{i:02}", v.tolist()) for i, v in enumerate(vectors)] + [("none", None), ("empty", []), ("short", [1.0])], "vec_id string, embedding array<double>")
    asked = np.round(rng.normal(size=(10_050, 6)), 2)
    queries = spark.createDataFrame(pd.DataFrame({"vec_id": [f"q{i}" for i in range(len(asked))], "embedding": asked.tolist()}))
    got = cosine_topk(queries, items, 3).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "distance"))).alias("best")).toPandas().set_index("query_id")["best"]
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    assert len(got) == len(asked)
    for i, query in enumerate(asked):
        distance = 1 - (unit * (query / np.linalg.norm(query))).sum(1)
        want = np.lexsort((np.arange(60), np.round(distance, 12)))[:3]
        assert [(b["rank"], b["vec_id"]) for b in got[f"q{i}"]] == [(r + 1, f"v{w:02}") for r, w in enumerate(want)]
        assert np.allclose([b["distance"] for b in got[f"q{i}"]], distance[want], atol=1e-9)
