"""Counts of the cells of all levels from sorted points."""

from pyspark.sql import functions as F

from prismlake.operators import bucketing as B
from prismlake.operators.schema import bucket_column_name

NAMES = [bucket_column_name("geo", k) for k in range(16)]


def _both(df):
    found = [{r.level: (r.column, r.n) for r in got.collect()} for got in (B.geo_level_counts(df), B.level_counts(B.add_geo_cells(df), NAMES))]
    return found


def test_cells_are_counted_over_any_tasks_without_a_table_of_them(spark):
    near = spark.range(4000).select((F.rand(3) / 50 + 59.3).alias("GPS_LATITUDE"), (F.rand(4) / 50 + 18).alias("GPS_LONGITUDE"))
    wide = spark.range(3000).select((F.rand(5) * 180 - 90).alias("GPS_LATITUDE"), (F.rand(6) * 400 - 200).alias("GPS_LONGITUDE"))
    edges = spark.createDataFrame([(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (None, 1.0), (1.0, None), (float("nan"), 5.0)], "GPS_LATITUDE double, GPS_LONGITUDE double")
    rows = near.union(near).union(wide).union(edges).cache()
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for tasks in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            sorted_paths, table = _both(rows)
            assert sorted_paths == table and sorted_paths[15][1] > 3000 > 64 >= sorted_paths[0][1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_no_points_have_no_cells(spark):
    none = spark.createDataFrame([(None, None)], "GPS_LATITUDE double, GPS_LONGITUDE double")
    sorted_paths, table = _both(none)
    assert sorted_paths == table and {n for _, n in sorted_paths.values()} == {0}


def test_the_query_groups_no_cells(spark, tmp_path):
    from prismlake.plans.queries import QUERIES

    spark.sql("select 1L event_id, timestamp'2024-01-01' ts, 2L user_id, 'click' event_type, 1d value").write.parquet(str(tmp_path / "events.parquet"))
    counted = QUERIES["geo_level_counts"](spark, str(tmp_path))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and [r.n for r in counted.orderBy("level").collect()] == [1] * 16
