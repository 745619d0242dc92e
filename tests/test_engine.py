import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.functions.scalars import build_path, classify_media, parse_utc
from prismlake.operators import bucketing as B
from prismlake.operators import selection as X
from prismlake.operators.embeddings import embed_into, image_stats, project_to_sphere
from prismlake.operators.frames import map_view
from prismlake.operators.schema import assign_df_id, clip_coordinates, validate_identifier
from prismlake.plans.session import LinkedSession
from prismlake.sources.catalog import catalog_collections
from prismlake.sources.readers import ingest_tracks, read_gpx, read_jsonl, read_takeout, scan_images
from prismlake.sources.keyed_table import read_keyed, upsert
from prismlake.sources.sinks import merged


@pytest.fixture(scope="module")
def places(spark):
    rows = [(0, "north", "WALK"), (1, "east", "WALK"), (2, "north", "RIDE"), (3, "west", "RIDE"), (4, "east", "WALK"), (5, "north", "RIDE")]
    return spark.createDataFrame(rows, "df_id long, category string, DATA_TYPE string")


def test_bucket_and_select_are_inverse(places):
    buckets = B.bucket_by_column(places, "category", "DATA_TYPE")
    assert buckets.agg(F.sum("COUNT")).first()[0] == 6
    picked = buckets.filter("(category = 'north' and DATA_TYPE = 'RIDE') or category = 'east'")
    kept = {r.df_id for r in X.filter_to_buckets(places, picked, "category", "DATA_TYPE").collect()}
    gone = {r.df_id for r in X.subtract_buckets(places, picked, "category", "DATA_TYPE").collect()}
    assert kept == {1, 2, 4, 5} and gone == {0, 3}
    assert X.filter_to_buckets(places, picked, "category", "DATA_TYPE", checked=True).count() == 4
    with pytest.raises(ValueError, match="count 4 rows, the base has 3"):
        X.filter_to_buckets(places.filter("df_id < 5"), picked, "category", "DATA_TYPE", checked=True)
    with pytest.raises(ValueError, match="twice"):
        X.filter_to_buckets(places, picked.union(picked), "category", "DATA_TYPE", checked=True)
    with pytest.raises(KeyError):
        X.pick(buckets, [99])
    with pytest.raises(KeyError):
        B.bucket_by_column(places, "none")


@pytest.mark.parametrize("budget, level", [(2, "DAY"), (10, "HOUR"), (1000, "MINUTE"), (10_000, None)])
def test_temporal_level_by_budget(spark, budget, level):
    rows = spark.range(10_000).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("TIMESTAMP_UTC"))
    found = B.optimal_temporal_level(B.add_temporal_buckets(rows), budget)
    assert found == (level and f"BUCKETED_TIMESTAMP_{level}")


def test_cells_nest_and_skip_nulls(spark):
    df = spark.createDataFrame([(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (None, 1.0)], "GPS_LATITUDE double, GPS_LONGITUDE double")
    rows = B.add_geo_cells(df).collect()
    assert rows[3].BUCKETED_CELL_L15 is None and rows[0].BUCKETED_CELL_L0 is not None
    assert clip_coordinates(spark.createDataFrame([(None, 500.0)], "GPS_LATITUDE double, GPS_LONGITUDE double")).first() == (None, 180.0)


def test_map_view_over_the_date_line(spark):
    v = map_view(spark.createDataFrame([(40.0, 179.0), (40.0, -179.0)], "GPS_LATITUDE double, GPS_LONGITUDE double")).first()
    assert abs(abs(v.center_lon) - 180) < 0.01 and v.radius_m < 500_000
    assert map_view(spark.createDataFrame([], "GPS_LATITUDE double, GPS_LONGITUDE double")).first().zoom == 1


def test_session_complements(spark):
    rows = spark.range(20).select(F.col("id").alias("df_id"), F.concat(F.lit("u"), "id").alias("UUID_STRING"), F.when(F.col("id") % 2 == 0, "GPX_WAYPOINT").otherwise("PHOTO").alias("DATA_TYPE"), F.timestamp_seconds(F.lit(1_704_103_200) + F.col("id") * 900).alias("TIMESTAMP_UTC"), (F.col("id") / 1000 + 37).alias("GPS_LATITUDE"), (F.col("id") / 1000 - 122).alias("GPS_LONGITUDE"))
    s = LinkedSession(rows, max_rows=6)
    ids = [r.df_id for r in s.projections["time"].rows.select("df_id").limit(3).collect()]
    s.apply_filter("time", ids)
    kept = {r.df_id for r in s.subset.collect()}
    s.reset()
    s.apply_filter("time", ids, "subtraction")
    gone = {r.df_id for r in s.subset.collect()}
    assert kept | gone == set(range(20)) and not kept & gone and kept
    s.apply_filter("geo", [], "subtraction")
    assert s.summary()["rows"] == len(gone)
    by_bits = LinkedSession(rows, families=("time",), max_rows=6, bitmaps=True)
    by_bits.apply_filter("time", ids, "subtraction")
    assert {r.df_id for r in by_bits.subset.collect()} == gone
    by_bits.apply_filter("time", [0], "intersection")
    by_joins = LinkedSession(rows, families=("time",), max_rows=6)
    by_joins.apply_filter("time", ids, "subtraction")
    by_joins.apply_filter("time", [0], "intersection")
    assert {r.df_id for r in by_bits.subset.collect()} == {r.df_id for r in by_joins.subset.collect()} != set()
    assert by_bits.projections["time"].level == by_joins.projections["time"].level
    by_bits.apply_filter("time", [], "intersection")
    assert by_bits.subset.count() == 0


def test_upsert_replaces_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert(spark.createDataFrame([(1, 1.1), (2, 2.2)], "k int, v double"), path, "k")
    upsert(spark.createDataFrame([(1, 1.2, "x"), (3, 3.3, "y")], "k int, v double, note string"), path, "k")
    assert sorted((r.k, r.v) for r in read_keyed(spark, path).collect()) == [(1, 1.2), (2, 2.2), (3, 3.3)]
    upsert(spark.createDataFrame([(5, 1.0), (5, 2.0)], "k int, v double").coalesce(1), path, "k")  # the later row wins
    assert [r.v for r in read_keyed(spark, path).filter("k = 5").collect()] == [2.0]
    spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, v double").write.parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError):
        upsert(spark.createDataFrame([(5, 1.0)], "k int, v double"), str(tmp_path / "twice"), "k")
    assert spark.read.parquet(str(tmp_path / "twice")).count() == 2
    patched = merged(spark.createDataFrame([(1, "a", "b")], "k int, x string, y string"), spark.createDataFrame([(1, "c")], "k int, x string"), "k", mode="patch")
    assert patched.first().asDict() == {"k": 1, "x": "c", "y": "b"}
    with pytest.raises(ValueError):
        validate_identifier("a;b")


def test_read_gpx_and_takeout(spark, tmp_path):
    good = """<?xml version="1.0"?><!-- a ride --><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="59.3293" lon="18.0686"><time>2022-05-04T08:40:00Z</time><name>Ferry quay</name><desc>Leave the bikes here</desc></wpt>
    <trk><trkseg><trkpt lat="59.3251" lon="18.0711"><time>2022-05-04T08:10:00Z</time></trkpt><trkpt lat="59.3260" lon="18.0702"><time>2022-05-04T08:20:30Z</time></trkpt><trkpt lat="59.3" lon="18.1"></trkpt></trkseg></trk></gpx>"""
    (tmp_path / "a.gpx").write_text(good)
    (tmp_path / "b.gpx").write_text("<gpx><trk>")
    (tmp_path / "page.gpx").write_text("<html><body>gpx</body></html>")
    (tmp_path / "words.gpx").write_text("not xml")
    (tmp_path / "none.gpx").write_text("<gpx></gpx>")
    (tmp_path / "empty.gpx").write_text("")
    points, bad = read_gpx(spark, str(tmp_path))
    assert points.count() == 3
    assert {r.SOURCE_FILE.rsplit("/", 1)[1] for r in bad.collect()} == {"b.gpx", "page.gpx", "words.gpx"}
    assert points.filter("NAME = 'Ferry quay' and CAPTION = 'Leave the bikes here'").count() == 1
    for name in ("one", "two", "three"):
        (tmp_path / "r" / name).mkdir(parents=True)
    (tmp_path / "r" / "one" / "Records.json").write_text(json.dumps({"locations": [{"timestamp": "2021-03-01T00:00:00Z", "latitudeE7": 593293000, "longitudeE7": 180686000}, "text", {"latitudeE7": 1}, {"timestamp": "2021-03-01T00:00:00Z", "latitudeE7": 1000000000, "longitudeE7": 0}]}))
    (tmp_path / "r" / "two" / "Records.json").write_text("{broken")
    (tmp_path / "r" / "three" / "Records.json").write_text(json.dumps({"places": []}))
    points, bad = read_takeout(spark, str(tmp_path / "r"))
    assert points.count() == 1 and {r.SOURCE_FILE.rsplit("/", 2)[1] for r in bad.collect()} == {"two", "three"}


def test_keep_first_of_each_key(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, 3, "b"), (2, 5, "c"), (3, 1, "d"), (3, 1, "e"), (3, 1, "e"), (None, 2, "f"), (None, 1, "g")], "k int, o int, v string")
    got = {r.k: (r.o, r.v) for r in X.keep_first(rows, "k", "o").collect()}
    assert X.keep_first(rows, "k", "o").count() == 4 and got[1] == (5, "a") and got[2] == (3, "b") and got[3][0] == 1 and got[None] == (1, "g")


def test_ingest_names_files_of_repeated_points(spark):
    rows = spark.createDataFrame([("u1", "a", 1.0), ("u1", "b", 1.0), ("u2", "b", 2.0), ("u2", "b", 2.0)], "UUID_STRING string, SOURCE_FILE string, GPS_LATITUDE double").withColumn("TIMESTAMP_UTC", F.lit("2020-01-01").cast("timestamp"))
    with pytest.raises(ValueError, match=r"a \(1\), b \(1\)|b \(1\), a \(1\)"):
        ingest_tracks(rows)
    assert ingest_tracks(rows.filter("UUID_STRING = 'u2'")).count() == 1


def test_catalog_ignores_only_its_own_collection(spark):
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "image int, collection int")
    names = spark.createDataFrame([(1, "Quick Collection"), (2, "previous import"), (3, "Trips")], "id_local int, name string")
    assert catalog_collections(links, names).first().COLLECTIONS == ["Trips", "previous import"]


def test_read_jsonl_numbers_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"UUID_STRING": f"u{i}", "DATA_TYPE": "PHOTO", "TIMESTAMP_UTC": "2024-01-01T10:00:00Z", "extra": i}) for i in range(7)))
    rows = read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()
    assert sorted(r.df_id for r in rows) == list(range(7)) and {r.extra for r in rows} == set(range(7))
    assert rows[0].TIMESTAMP_UTC == dt.datetime(2024, 1, 1, 10)
    (tmp_path / "b.jsonl").write_text('{"UUID_STRING": "a", "DATA_TYPE": "PHOTO"}\n{"UUID_STRING": "b"\n')
    with pytest.raises(ValueError, match="line 2 of .*b.jsonl"):
        read_jsonl(spark, str(tmp_path / "b.jsonl"))


def test_read_jsonl_places_bad_lines_in_files_of_several_splits(spark, tmp_path):
    lines = [json.dumps({"UUID_STRING": f"u{i}", "DATA_TYPE": "PHOTO", "x": i if i % 2 else i / 4, "deep": {"a": [1, {"b": None}]}, "mixed": i if i % 3 else "t", "none": None}) for i in range(120)]
    lines[40] = ""
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        rows = read_jsonl(spark, str(tmp_path / "a.jsonl"))
        assert dict(rows.dtypes)["x"] == "double" and dict(rows.dtypes)["mixed"] == "string"
        assert sorted(r.df_id for r in rows.collect()) == list(range(119)) and rows.filter("UUID_STRING = 'u7'").first().mixed == "7" and rows.filter("UUID_STRING = 'u6'").first().x == 1.5
        lines[77] = "[1, 2]"
        lines[99] = '{"UUID_STRING": '
        (tmp_path / "b.jsonl").write_text("\n".join(lines))
        with pytest.raises(ValueError, match=r"line 78 of .*b.jsonl: \[1, 2\]; line 100 of"):
            read_jsonl(spark, str(tmp_path / "b.jsonl"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "c.jsonl").write_text('{"UUID_STRING": "a", "DATA_TYPE": "SONG", "RATING_0_TO_5": 9}\n')
    with pytest.raises(ValueError, match=r"data_type_unknown \(1\), rating_range \(1\)"):
        read_jsonl(spark, str(tmp_path / "c.jsonl"))


def test_scalars(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00+01:00", "mov", "/r/", "a/b.jpg"), ("bad", None, "", None)], "t string, f string, r string, n string")
    a, b = df.select(parse_utc(F.col("t")).alias("t"), classify_media(F.col("f")).alias("m"), build_path(F.col("r"), F.lit("x"), F.col("n")).alias("p")).collect()
    assert a.t == dt.datetime(2024, 1, 1, 9) and a.m == "VIDEO" and a.p == "/r/x/a/b.jpg"
    assert b.t is None and b.m == "PHOTO" and b.p is None
    assert [(r.df_id, r.t) for r in assign_df_id(df).orderBy("df_id").collect()] == [(0, "2024-01-01T10:00:00+01:00"), (1, "bad")]
    assert [r.m for r in spark.createDataFrame([("ts",), ("DV",), ("vob",), ("mpeg",)], "f string").select(classify_media(F.col("f")).alias("m")).collect()] == ["VIDEO", "VIDEO", "VIDEO", "PHOTO"]


def test_sphere_projection_equals_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 6)) * [3, 2, 1.5, 0.4, 0.3, 0.2] + [1, 0, 0, 0, 0, 0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, None)]
    got = {r.i: (r.SEMANTIC_EMBEDDING_UMAP_LATITUDE, r.SEMANTIC_EMBEDDING_UMAP_LONGITUDE) for r in project_to_sphere(spark.createDataFrame(rows, "i int, SEMANTIC_EMBEDDING array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    axes = np.linalg.eigh(np.cov(unit.T))[1][:, ::-1][:, :3]
    assert got[60] == (None, None)
    errors = []
    for signs in np.array(np.meshgrid(*[[-1, 1]] * 3)).reshape(3, -1).T:  # components have no sign of their own
        p = unit @ (axes * signs)
        p /= np.linalg.norm(p, axis=1)[:, None]
        lat, lon = np.degrees(np.arcsin(p[:, 2])), np.degrees(np.arctan2(p[:, 0], p[:, 1]))
        errors.append(max(max(abs(got[i][0] - lat[i]), abs((got[i][1] - lon[i] + 180) % 360 - 180)) for i in range(60)))
    assert min(errors) < 1e-4
    assert project_to_sphere(spark.createDataFrame([(1, [1.0, 2.0])], "i int, SEMANTIC_EMBEDDING array<double>")).first()[2:] == (0.0, 0.0)


def test_embedding_job_adds_what_is_missing(spark, tmp_path):
    path, items = str(tmp_path / "e"), spark.createDataFrame([("a", "xx"), ("b", None), ("c", "x")], "UUID_STRING string, body string")
    lengths = lambda texts: [None if t is None else [float(len(t))] for t in texts]
    assert embed_into(items, path, "body", lengths) == 2
    with pytest.raises(ValueError, match="none of 1"):
        embed_into(items, path, "body", lengths)
    more = items.union(spark.createDataFrame([("d", "xxx")], items.schema))
    assert embed_into(more, path, "body", lengths) == 1
    assert {r.UUID_STRING: r.SEMANTIC_EMBEDDING for r in read_keyed(spark, path).collect()} == {"a": [2.0], "c": [1.0], "d": [3.0]}


def test_embedding_job_goes_on_where_it_died(spark, tmp_path):
    path, log = str(tmp_path / "e"), tmp_path / "log"
    items = spark.createDataFrame([(f"u{k}", "x" * (k + 1)) for k in range(60)], "UUID_STRING string, body string")
    state = tmp_path / "dies"
    state.write_text("yes")

    def lengths(texts):
        with open(log, "a") as out:
            out.write("".join(f"{len(t)}\n" for t in texts))
        if state.read_text() == "yes" and any(len(t) == 31 for t in texts):
            raise RuntimeError("killed")
        return [[float(len(t))] for t in texts]

    with pytest.raises(Exception, match="killed"):
        embed_into(items, path, "body", lengths, ranges=6)
    finished = {r.UUID_STRING for r in read_keyed(spark, path).collect()}
    assert 0 < len(finished) < 60
    log.write_text("")
    state.write_text("no")
    assert embed_into(items, path, "body", lengths, ranges=6) == 60 - len(finished)
    again = {f"u{int(n) - 1}" for n in log.read_text().split()}
    assert not again & finished and read_keyed(spark, path).count() == 60


def test_images(spark, tmp_path):
    for name in ("a/u1.jpg", "b/u1.jpg", "b/u2.jpg", "b/u3.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert {r.UUID_STRING: r.path.rsplit("/", 2)[1] for r in scan_images(spark, str(tmp_path)).collect()} == {"u1": "a", "u2": "b"}
    pixels = [{"height": 1, "width": 2, "nChannels": 3, "data": bytes([0, 0, 255, 0, 0, 255])}, None, {"height": 9, "width": 9, "nChannels": 3, "data": b"short"}]
    assert image_stats(pixels) == [[1.0, 0.0, 0.0, 0.0, 0.0, 0.0], None, None]


def test_queries_and_sql_name_the_same():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
