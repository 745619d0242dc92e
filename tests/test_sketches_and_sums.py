"""Levels from sketches against exact ones, and running sums over parts against a plain sum."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismlake.operators import bucketing as B
from prismlake.operators import selection as S
from prismlake.operators.frames import temporal_cdf
from prismlake.operators.prefix import running_sum
from prismlake.operators.sketches import LevelSketches
from prismlake.plans.session import LinkedSession


@pytest.fixture(scope="module")
def base(spark):
    rng = np.random.default_rng(12)
    n = 2000
    rows = pd.DataFrame({"df_id": np.arange(n), "DATA_TYPE": rng.choice(["PHOTO", "VIDEO"], n), "TIMESTAMP_UTC": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 2 * 86400, n), "s"), "GPS_LATITUDE": rng.uniform(37, 38, n), "GPS_LONGITUDE": rng.uniform(-123, -122, n)})
    df = spark.createDataFrame(rows).withColumn("GPS_LATITUDE", F.when(F.col("df_id") % 10 != 0, F.col("GPS_LATITUDE"))).withColumn("DATA_TYPE", F.when(F.col("df_id") % 13 != 0, F.col("DATA_TYPE"))).withColumn("TIMESTAMP_UTC", F.when(F.col("df_id") % 17 != 0, F.col("TIMESTAMP_UTC")))
    return B.add_bucketed_columns(df).cache()


def exact(df, family, budget):
    return (B.optimal_geo_level if family == "geo" else B.optimal_temporal_level)(B.drop_missing(df, family), budget)


def test_levels_of_subsets_equal_the_exact_ones(base):
    sketches = LevelSketches.of(base, ("geo", "time"), "DATA_TYPE")
    hours = B.bucket_by_column(base, "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE")
    some = hours.filter((F.hour("BUCKETED_TIMESTAMP_HOUR") < 9) & (F.col("DATA_TYPE") == "PHOTO"))
    kept = S.filter_to_buckets(base, some, "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE")
    rest = S.subtract_buckets(base, some, "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE")
    subsets = [(kept, sketches.kept(some, "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE")), (rest, sketches.without(some, "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE"))]
    for subset, of in subsets:
        for budget in (5, 90):
            for family in ("geo", "time"):
                assert of.level(family, budget, subset) == exact(subset, family, budget), (family, budget)


def test_far_levels_read_no_rows(spark, base):
    sketches = LevelSketches.of(base, ("geo",), "DATA_TYPE")
    unread = F.raise_error(F.lit("the base was read")).cast("long")
    unreadable = base.withColumns({c: unread for c in base.columns if c.startswith("BUCKETED_CELL")})
    counts = {r.column: r.n for r in B.level_counts(B.drop_missing(base, "geo"), [f"BUCKETED_CELL_L{k}" for k in range(16)]).collect()}
    budget = next(b for b in range(200, 1500, 10) if all(abs(n - b) > 0.1 * b for n in counts.values()))
    assert sketches.level("geo", budget, unreadable) == exact(base, "geo", budget) is not None


def test_session_levels_from_sketches_equal_the_exact_ones(base):
    session = LinkedSession(base.drop(*[c for c in base.columns if c.startswith("BUCKETED")]), max_rows=60)
    assert session.projections["time"].level == "BUCKETED_TIMESTAMP_HOUR"
    session.apply_filter("time", list(range(0, 60, 3)))
    assert session._sketches is not None
    assert {f: p.level for f, p in session.projections.items()} == {f: exact(session.subset, f, 60) for f in ("geo", "time")}
    session.apply_filter("geo", [0, 1])
    assert session._sketches is None
    assert {f: p.level for f, p in session.projections.items()} == {f: exact(session.subset, f, 60) for f in ("geo", "time")}
    session.reset()
    assert session._sketches is not None


def test_running_sums_over_any_number_of_parts(spark):
    rng = np.random.default_rng(3)
    n = 3000
    frame = pd.DataFrame({"id": rng.permutation(n), "g": rng.choice(["hot", "b", None], n, p=[0.9, 0.05, 0.05]), "t": rng.integers(0, 40, n), "v": rng.integers(-3, 9, n)})
    got = running_sum(spark.createDataFrame(frame).repartition(7), "v", ["t", "id"], "g", "total").toPandas().set_index("id")["total"]
    frame["g"] = frame["g"].fillna("?")
    want = frame.sort_values(["t", "id"]).assign(total=lambda f: f.groupby("g")["v"].cumsum()).set_index("id")["total"]
    assert (got.sort_index() == want.sort_index()).all()


def test_no_window_holds_a_whole_group(spark):
    df = spark.range(1000).selectExpr("id as df_id", "'all' as g", "id % 100 as t", "1 + id % 3 as COUNT")
    out = temporal_cdf(df, "t", "g")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_part#" in w or "_in#" in w for w in windows)
    rows = sorted(out.collect(), key=lambda r: (r.t, r.df_id))
    assert rows[-1].cdf == 1.0 and all(x.cdf < y.cdf for x, y in zip(rows, rows[1:])) and rows[0].cdf == 1 / sum(1 + k % 3 for k in range(1000))
