"""Searches through inverted lists against all pairs."""

import numpy as np
import pandas as pd

from prismlake.operators.vector_index import VectorIndex


def table(spark, ids, vectors):
    return spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": [None if v is None else list(map(float, v)) for v in vectors]}), "vec_id string, embedding array<double>")


def plain(queries, items, k):
    found = {}
    for name, q in queries:
        if q is None:
            continue
        best = []
        for item, v in items:
            if v is not None and len(v) == len(q):
                norm = np.linalg.norm(q) * np.linalg.norm(v)
                best.append((round(1 - float(np.dot(q, v)) / norm if norm else 1.0, 9), item))
        if best:
            found[name] = sorted(best)[:k]
    return found


def test_lists_give_what_all_pairs_give(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 4
    vectors = [v for v in (centres[rng.integers(12, size=900)] + rng.normal(size=(900, 8)) * 0.4)]
    vectors[700:710] = vectors[:10]  # ties
    odd = [None, np.zeros(8), np.ones(3), np.array([1.0, 2, 3]), -vectors[5]]
    items = [(f"v{i:04}", v) for i, v in enumerate(vectors + odd)]
    asked = [(f"q{i:03}", v) for i, v in enumerate([*(centres[rng.integers(12, size=60)] + rng.normal(size=(60, 8)) * 0.4), *rng.normal(size=(10, 8)), *odd, np.ones(5)])]
    index = VectorIndex.build(table(spark, *zip(*items)), centres=16, sample_rows=300, block_rows=40)
    queries = table(spark, *zip(*asked))
    got = {}
    for r in index.search(queries, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], round(r.distance, 9), r.vec_id))
    want = plain(asked, items, 4)
    assert set(got) == set(want)
    for name, best in want.items():
        found = sorted(got[name])
        assert [f[0] for f in found] == list(range(1, len(best) + 1))
        assert np.allclose([f[1] for f in found], [b[0] for b in best], atol=1e-7)
        if len({b[0] for b in best}) == len(best):
            assert [f[2] for f in found] == [b[1] for b in best]
    assert got["q000"][0][1] < 0.2
    near = queries.filter("vec_id < 'q060'")
    assert index.share_read(near, 4) < 0.3
    assert index.search(queries.limit(0), 4).count() == 0
    assert VectorIndex.build(table(spark, ["x"], [None])).search(queries, 4).count() == 0
