"""GPX files that are read by many tasks."""

from pyspark.sql import functions as F

from prismlake.sources.gpx_points import gpx_points
from prismlake.sources.readers import read_gpx


def _point(n: int, tag: str = "trkpt") -> str:
    return f'<{tag} lat="{n % 90}.5" lon="{n % 180}"><time>2022-05-04T08:{n % 60:02d}:00Z</time><name>n{n}</name></{tag}>'


def _file(folder, name: str, body: str, end: str = "</gpx>") -> None:
    (folder / name).write_text(f'<?xml version="1.0"?><!-- a ride --><gpx version="1.1">{body}{end}')


def _names(rows) -> list[str]:
    return sorted(r[0].rsplit("/", 1)[1] for r in rows.select("file").distinct().collect())


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    points = 20_000
    _file(tmp_path, "long.gpx", "<trk><trkseg>" + "\n".join(map(_point, range(points))) + "</trkseg></trk>")
    _file(tmp_path, "cut.gpx", "<trk><trkseg>" + "\n".join(map(_point, range(points))), "")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        found, bad = read_gpx(spark, str(tmp_path))
        tasks = found.select(F.spark_partition_id().alias("task"), "GPS_LATITUDE", "TIMESTAMP_UTC").cache()
        assert tasks.count() == points and tasks.select("task").distinct().count() > 1
        assert {r.GPS_LATITUDE: r["count"] for r in tasks.groupBy("GPS_LATITUDE").count().collect()} == {k + 0.5: len(range(k, points, 90)) for k in range(90)}
        assert [r.SOURCE_FILE.rsplit("/", 1)[1] for r in bad.collect()] == ["cut.gpx"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_splits_and_runs_at_any_place_give_the_same(spark, tmp_path):
    track = "<trk><trkseg>" + "".join(map(_point, range(12))) + "</trkseg></trk>"
    _file(tmp_path, "comment.gpx", f"<!-- {_point(70)}{_point(71)} -->{track}<!-- a > b </x> -->")
    _file(tmp_path, "cdata.gpx", "".join(f'<wpt lat="1" lon="{n}"><time>2022-05-04T08:00:00Z</time><name><![CDATA[</wpt><wpt>]]></name></wpt>' for n in range(5)) + _point(9, "wpt"))
    _file(tmp_path, "elsewhere.gpx", f'<extensions>{_point(50)}<trkpt lat="?" lon="2"/></extensions><rte>{_point(1, "rtept")}</rte>{track}')
    _file(tmp_path, "nested.gpx", f'<trk><trkseg><trkpt lat="1" lon="1"><trkpt lat="2" lon="2"/><time>2022-05-04T08:00:00Z</time></trkpt>{_point(3)}</trkseg></trk>')
    _file(tmp_path, "number.gpx", track.replace('lat="5.5"', 'lat="?"'))
    _file(tmp_path, "order.gpx", track.replace("</trkseg></trk>", "</trk></trkseg>"))
    (tmp_path / "page.gpx").write_text(f"<html>{track}</html>")
    (tmp_path / "blank.gpx").write_text("  ")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split, run_bytes in (("128m", 1 << 17), ("331", 150)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            found, bad = gpx_points(spark, str(tmp_path), run_bytes=run_bytes)
            counts = {(r.file.rsplit("/", 1)[1], r.kind): r["count"] for r in found.groupBy("file", "kind").count().collect()}
            assert counts == {("comment.gpx", "trkpt"): 12, ("cdata.gpx", "wpt"): 6, ("elsewhere.gpx", "trkpt"): 12, ("nested.gpx", "trkpt"): 2}, split
            assert _names(bad) == ["number.gpx", "order.gpx", "page.gpx"], split
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
