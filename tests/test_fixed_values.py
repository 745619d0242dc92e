"""Values that other programs rely on, and shapes at the edge."""

from pyspark.sql import functions as F

from prismlake.operators import bucketing as B
from prismlake.sources.readers import read_gpx


def test_point_ids_keep_their_bytes(spark, tmp_path):
    # Fixed value: the id that points of this place and time have in stores written before.
    known = {"2023-01-01T12:00:00Z": "F50CA1B84EF25277F204EAD8FF90010B"}
    marks = [("37.7750", "-122.4195", "2023-01-01T12:05:00Z"), ("37.7749", "-122.4194", "2023-01-01T12:00:00Z")]
    (tmp_path / "walk.gpx").write_text("<gpx><trk><trkseg>" + "".join(f'<trkpt lat="{lat}" lon="{lon}"><time>{at}</time></trkpt>' for lat, lon, at in marks) + "</trkseg></trk></gpx>")
    got = {r.TIMESTAMP_MAYBE_TIMEZONE_AWARE: r.id for r in read_gpx(spark, str(tmp_path))[0].select("TIMESTAMP_MAYBE_TIMEZONE_AWARE", F.hex("UUID").alias("id")).collect()}
    assert len(set(got.values())) == 2 and known.items() <= got.items()


def test_projection_without_groups_is_one_group(spark):
    rows = spark.range(30).select(F.col("id").alias("df_id"), (F.col("id") % 10).alias("fine"), (F.col("id") % 3).alias("coarse"))
    bucketed = B.grouped_bucketed_projection(rows, [], ["fine", "coarse"], 5).collect()
    assert {(r.group_name, r.bucket_column) for r in bucketed} == {("", "coarse")} and sum(r.COUNT for r in bucketed) == 30
    raw = B.grouped_bucketed_projection(rows, [], ["fine", "coarse"], 30).collect()
    assert len(raw) == 30 and {(r.group_name, r.bucket_column, r.COUNT) for r in raw} == {("", None, None)}
