"""Chains of selections by bitmaps against joins of rows."""

import numpy as np
import pandas as pd

from prismlake.operators import bucketing as B
from prismlake.operators import selection as X
from prismlake.operators.bitmaps import BLOCK_ROWS, BitmapIndex, count_selected, selected_rows


def test_chains_equal_those_of_joins(spark):
    rng = np.random.default_rng(6)
    n = 900
    ids = np.sort(rng.choice(3 * BLOCK_ROWS + 10, n, replace=False))
    ids[:2] = 0, 7
    ids[-1] = 3 * BLOCK_ROWS
    frame = pd.DataFrame({"df_id": ids, "cell": rng.integers(0, 12, n).astype(float), "kind": rng.choice(["a", "b", "c"], n)})
    frame.loc[rng.random(n) < 0.1, "cell"] = np.nan
    frame["kind"] = frame["kind"].mask(rng.random(n) < 0.2)
    base = spark.createDataFrame(frame).selectExpr("df_id", "cast(nullif(cell, double('NaN')) as int) as cell", "kind").cache()
    index = BitmapIndex.of(base, "cell", "kind")
    rows, chosen = base, index.everything
    assert count_selected(chosen) == n
    ids_of = lambda df: sorted(r.df_id for r in df.select("df_id").collect())
    for step, keep in enumerate((True, False)):
        buckets = B.bucket_by_column(rows, "cell", "kind")
        key = lambda r: (r.cell, r.kind)
        plain = sorted(((r.cell, r.kind, r.COUNT, r.df_id) for r in buckets.collect()))
        assert sorted((r.cell, r.kind, r.COUNT, r.df_id) for r in index.buckets(chosen).collect()) == plain
        picked = buckets.filter(f"cell % 4 != {step}") if keep else buckets.filter("cell = 5 and kind in ('a', 'Unknown')")
        rows = (X.filter_to_buckets if keep else X.subtract_buckets)(rows, picked, "cell", "kind")
        chosen = (index.kept if keep else index.without)(chosen, picked)
        assert ids_of(selected_rows(base, chosen)) == ids_of(rows) and count_selected(chosen) == rows.count() > 0
    none = index.kept(chosen, picked.limit(0))
    assert count_selected(none) == 0 and selected_rows(base, none).count() == 0 and index.buckets(none).count() == 0
    assert ids_of(selected_rows(base, index.without(chosen, picked.limit(0)))) == ids_of(rows)
