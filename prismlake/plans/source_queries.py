"""Queries through files: each writes what it reads, from the given tables, into the scratch folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bucketing as B
from ..operators import embeddings as E
from ..operators import frames as V
from ..operators import selection as X
from ..operators.bitmaps import BitmapIndex, selected_rows
from ..operators.landmarks import project_to_sphere_by_landmarks
from ..operators.sketches import LevelSketches
from ..operators.vector_index import VectorIndex
from ..scratch import scratch_path
from ..sources import readers as R
from ..sources.keyed_table import _Files, layout_of, read_keyed, upsert
from ..sources.sinks import write_parquet
from ..streaming.ingest import stream_bucket_counts
from .queries import _GEO, _PICKED, ORACLES, _cell, _events, _ntz, _picked, _query, _read
from .session import LinkedSession

#: Track files that points are dealt over.
FILES = 20


def _text_files(rows: DataFrame, folder: str, by: str, name: str) -> None:
    """Write the column ``line`` of each value of ``by``, in order of ``place``, as the file ``<by>=<value>/<name>``."""
    spark = rows.sparkSession
    rows.repartition(by).sortWithinPartitions(by, "place").select("line", by).write.partitionBy(by).text(folder)
    files = _Files(spark, folder)
    for value in (n for n in files.names() if n.startswith(f"{by}=")):
        (part,) = [n for n in files.names(value) if n.startswith("part-")]
        files.move((value, part), (value, name))


def _framed(points: DataFrame, by: str, first: str, line: Column, last: str, unfinished: Column | None = None) -> DataFrame:
    """(by, place, line): the points' lines between a first and a last one; groups that ``unfinished`` names lack the last."""
    groups = points.select(by).distinct()
    ended = groups if unfinished is None else groups.filter(~unfinished)
    return points.select(by, F.lit(1).alias("place"), line.alias("line")).unionByName(groups.select(by, F.lit(0).alias("place"), F.lit(first).alias("line"))).unionByName(ended.select(by, F.lit(2).alias("place"), F.lit(last).alias("line")))


def _utc_text(c: str = "TIMESTAMP_UTC") -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _location_exports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as one location export an event type, that of the clicks cut short."""
    e = _events(spark, sf_dir).withColumns({"latitudeE7": F.round(F.col("GPS_LATITUDE") * 1e7).cast("long"), "longitudeE7": F.round(F.col("GPS_LONGITUDE") * 1e7).cast("long"), "timestamp": _utc_text(), "note": F.concat(F.lit('a "}" brace '), "df_id")})
    line = F.concat(F.lit(","), F.to_json(F.struct("timestamp", "latitudeE7", "longitudeE7", "note")))
    folder = scratch_path(spark, "exports")
    _text_files(_framed(e, "DATA_TYPE", '{"locations": [{}', line, "]}", F.col("DATA_TYPE") == "click"), folder, "DATA_TYPE", "Records.json")
    return R.read_takeout(spark, folder)


def _folder(c: str = "SOURCE_FILE") -> Column:
    return F.regexp_extract(c, "=([^/]*)/[^/]*$", 1)


_LAT = "(event_id * 7919) % 180001 / 1000.0 - 90"
_LON = "(event_id * 104729) % 360001 / 1000.0 - 180"


@_query(f"SELECT event_type AS folder, date_trunc('second', ts)::TIMESTAMP AS utc, round({_LAT}, 5)::DOUBLE AS lat, round({_LON}, 5)::DOUBLE AS lon FROM events WHERE event_id % 50 <> 0 AND event_type <> 'click'")
def location_exports(spark, sf_dir):
    points, _ = _location_exports(spark, sf_dir)
    return points.select(_folder().alias("folder"), _ntz("TIMESTAMP_UTC").alias("utc"), F.round("GPS_LATITUDE", 5).alias("lat"), F.round("GPS_LONGITUDE", 5).alias("lon"))


@_query("SELECT DISTINCT event_type AS folder FROM events WHERE event_type = 'click'")
def quarantined_exports(spark, sf_dir):
    return _location_exports(spark, sf_dir)[1].select(_folder().alias("folder"))


def _gpx_files(spark: SparkSession, sf_dir: str) -> str:
    e = _events(spark, sf_dir).filter("GPS_LATITUDE is not null").withColumn("track", F.col("user_id") % FILES)
    line = F.format_string('<trkpt lat="%s" lon="%s"><time>%s</time></trkpt>', F.col("GPS_LATITUDE").cast("string"), F.col("GPS_LONGITUDE").cast("string"), _utc_text())
    folder = scratch_path(spark, "tracks")
    _text_files(_framed(e, "track", '<?xml version="1.0"?><gpx version="1.1"><trk><trkseg>', line, "</trkseg></trk></gpx>", F.col("track") == 3), folder, "track", "ride.gpx")
    return folder


@_query(f"SELECT CAST(user_id % {FILES} AS VARCHAR) AS track, 'GPX_TRACKPOINT' AS kind, date_trunc('second', ts)::TIMESTAMP AS utc, round({_LAT}, 5)::DOUBLE AS lat, round({_LON}, 5)::DOUBLE AS lon FROM events WHERE event_id % 50 <> 0 AND user_id % {FILES} <> 3")
def gps_tracks(spark, sf_dir):
    points, _ = R.read_gpx(spark, _gpx_files(spark, sf_dir))
    return points.select(_folder().alias("track"), F.col("DATA_TYPE").alias("kind"), _ntz("TIMESTAMP_UTC").alias("utc"), F.round("GPS_LATITUDE", 5).alias("lat"), F.round("GPS_LONGITUDE", 5).alias("lon"))


@_query(f"SELECT DISTINCT CAST(user_id % {FILES} AS VARCHAR) AS track FROM events WHERE event_id % 50 <> 0 AND user_id % {FILES} = 3")
def quarantined_tracks(spark, sf_dir):
    return R.read_gpx(spark, _gpx_files(spark, sf_dir))[1].select(_folder().alias("track"))


@_query(f"SELECT DISTINCT CAST(user_id % {FILES} AS VARCHAR) AS track, 'ride.gpx' AS name, true AS has_bytes FROM events WHERE event_id % 50 <> 0")
def discovered_files(spark, sf_dir):
    return R.discover_files(spark, _gpx_files(spark, sf_dir), "*.gpx").select(_folder("path").alias("track"), "name", (F.col("size") > 0).alias("has_bytes"))


@_query("SELECT event_id AS df_id, least(greatest((" + _LAT + ") * 1.5, -90), 90)::DOUBLE AS lat, least(greatest((" + _LON + ") * 1.5, -180), 180)::DOUBLE AS lon, CAST(NULL AS VARCHAR) AS caption FROM events WHERE event_id % 50 <> 0")
def stored_table(spark, sf_dir):
    e = _events(spark, sf_dir).filter("GPS_LATITUDE is not null").select("df_id", (F.col("GPS_LATITUDE") * 1.5).alias("GPS_LATITUDE"), (F.col("GPS_LONGITUDE") * 1.5).alias("GPS_LONGITUDE"))
    path = scratch_path(spark, "table")
    write_parquet(e.drop("GPS_LONGITUDE"), path)
    write_parquet(e, path)  # the later write stands
    return R.read_table(spark, path).select("df_id", F.col("GPS_LATITUDE").alias("lat"), F.col("GPS_LONGITUDE").alias("lon"), F.col("CAPTION").alias("caption"))


@_query("SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS seen FROM events WHERE user_id % 7 = 2 AND value > 10")
def queried_source(spark, sf_dir):
    text = "SELECT event_id, date_format(cast(ts as timestamp), \"yyyy-MM-dd'T'HH:mm:ssXXX\") AS seen FROM events_in WHERE user_id % 7 = :part AND value > :least"
    _read(spark, sf_dir, "events").createOrReplaceTempView("events_in")
    return R.query_source(spark, text, {"part": 2, "least": 10}, "seen").select("event_id", _ntz("seen").alias("seen"))


@_query("SELECT CAST(vec_id AS VARCHAR) AS uuid, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 3) AS total FROM embeddings WHERE vec_id % 3 <> 1")
def stored_embeddings(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("UUID_STRING"), F.when(F.col("vec_id") % 3 == 1, "TEXT").otherwise("IMAGE").alias("EMBEDDING_TYPE"), F.col("embedding").alias("EMBEDDING"))
    path = scratch_path(spark, "embeddings")
    write_parquet(v, path)
    total = F.aggregate("SEMANTIC_EMBEDDING", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return R.read_embeddings(spark, path, "IMAGE").select(F.col("UUID_STRING").alias("uuid"), F.size("SEMANTIC_EMBEDDING").alias("dims"), F.round(total, 3).alias("total"))


@_query("SELECT 'img' || album AS uuid, 'a' AS folder FROM (SELECT DISTINCT user_id % 12 AS album FROM events)")
def scanned_images(spark, sf_dir):
    """The same names in two folders: the first path is taken."""
    e = _events(spark, sf_dir).select((F.col("user_id") % 12).alias("album"), F.col("df_id").alias("place"), F.lit("pixels").alias("line"))
    root = scratch_path(spark, "images")
    for folder in ("b", "a"):
        _text_files(e, f"{root}/{folder}", "album", "x")
        files = _Files(spark, f"{root}/{folder}")
        for album in (n for n in files.names() if n.startswith("album=")):
            files.move((album, "x"), (f"img{album[6:]}.jpg",))
    return R.scan_images(spark, root).select(F.col("UUID_STRING").alias("uuid"), F.element_at(F.split("path", "/"), -2).alias("folder"))


_PIXEL = "sqrt(pow(event_id % 251, 2) + pow(event_id % 13, 2) + pow(event_id % 7 + 1, 2))"


@_query(f"SELECT CAST(event_id AS VARCHAR) AS uuid, round((event_id % 251) / {_PIXEL}, 4)::DOUBLE AS red, round((event_id % 13) / {_PIXEL}, 4)::DOUBLE AS green, round((event_id % 7 + 1) / {_PIXEL}, 4)::DOUBLE AS blue, 0.0::DOUBLE AS spread FROM events WHERE event_id % 9 <> 0")
def image_embeddings(spark, sf_dir):
    """Images of two equal pixels a row, embedded into a keyed table; every ninth cannot be read and is left out."""
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    one = F.concat(byte(F.col("df_id") % 7 + 1), byte(F.col("df_id") % 13), byte(F.col("df_id") % 251))
    data = F.unhex(F.when(F.col("df_id") % 9 == 0, "00").otherwise(F.concat(one, one)))
    items = _events(spark, sf_dir).select(F.col("df_id").cast("string").alias("UUID_STRING"), F.struct(F.lit(1).alias("height"), F.lit(2).alias("width"), F.lit(3).alias("nChannels"), data.alias("data")).alias("pixels"))
    path = scratch_path(spark, "image-embeddings")
    E.embed_into(items, path, "pixels", E.image_stats, ranges=2)
    v = F.col("SEMANTIC_EMBEDDING")
    return read_keyed(spark, path).select(F.col("UUID_STRING").alias("uuid"), *[F.round(v[k].cast("double"), 4).alias(c) for k, c in enumerate(("red", "green", "blue"))], F.round((v[3] + v[4] + v[5]).cast("double"), 4).alias("spread"))


@_query(f"""WITH b AS (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT count(*) AS n FROM events)
    SELECT 'hours' AS part, (SELECT n FROM c) AS all_rows, (SELECT n FROM c) AS rows, (SELECT count(*) FROM b) AS points, 'BUCKETED_TIMESTAMP_HOUR' AS level
    UNION ALL SELECT 'picked', (SELECT n FROM c), coalesce(CAST((SELECT sum(n) FROM b WHERE n >= 3) AS BIGINT), 0), (SELECT count(*) FROM b WHERE n >= 3), CASE WHEN (SELECT sum(n) FROM b WHERE n >= 3) <= 750 THEN NULL ELSE 'BUCKETED_TIMESTAMP_HOUR' END
    UNION ALL SELECT 'reset', (SELECT n FROM c), (SELECT n FROM c), (SELECT count(*) FROM b), 'BUCKETED_TIMESTAMP_HOUR'""")
def session_summaries(spark, sf_dir):
    """What a session reports at its start, after a selection, and after a reset."""
    s = LinkedSession(_events(spark, sf_dir), families=("time",), max_rows=750)
    found = []

    def note(part: str) -> None:
        summary = s.summary()
        time = summary["projections"]["time"]
        found.append((part, summary["all_rows"], summary["rows"], time["points"], time["level"]))

    note("hours")
    s.apply_filter("time", [r.df_id for r in s.projections["time"].rows.filter("COUNT >= 3").select("df_id").collect()])
    note("picked")
    s.reset()
    note("reset")
    return spark.createDataFrame(found, "part string, all_rows long, rows long, points long, level string")


@_query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour_start, event_type AS grp, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_bucket_counts(spark, sf_dir):
    """Events that arrive twice over, in several batches, counted once."""
    e = _events(spark, sf_dir).select(F.col("df_id").cast("string").alias("UUID_STRING"), "DATA_TYPE", F.date_format("TIMESTAMP_UTC", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("TIMESTAMP_UTC"))
    source, target, state = (scratch_path(spark, f"counts-{k}") for k in ("source", "target", "state"))
    e.union(e.filter("UUID_STRING % 4 = 0")).repartition(4).write.json(source)
    stream_bucket_counts(spark, source, e.schema, target, state, late_by="400 days", files_per_batch=2).awaitTermination()
    return read_keyed(spark, target).select(_ntz("BUCKETED_TIMESTAMP_HOUR").alias("hour_start"), F.col("DATA_TYPE").alias("grp"), F.col("COUNT").alias("n"))


@_query(f"{_GEO}, p AS (SELECT * FROM g WHERE x IS NOT NULL AND {_PICKED.replace('FROM events', 'FROM e')}) SELECT CASE WHEN count(*) <= 60 THEN 'none' " + " ".join(f"WHEN count(DISTINCT {_cell(k)}) <= 60 THEN 'BUCKETED_CELL_L{k}'" for k in reversed(range(16))) + " ELSE 'BUCKETED_CELL_L0' END AS level FROM p")
def level_from_sketches(spark, sf_dir):
    """The geo level of some picked hours, from stored sketches."""
    base = B.add_bucketed_columns(_events(spark, sf_dir))
    picked = _picked(spark, sf_dir)
    sketches = LevelSketches.of(base, ("geo",), "DATA_TYPE").kept(picked, "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE")
    level = sketches.level("geo", 60, X.filter_to_buckets(base, picked, "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE"))
    return base.groupBy().agg(F.max(F.lit(level or "none")).alias("level"))


@_query("SELECT event_id AS df_id, round(count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY event_type), 6)::DOUBLE AS cdf FROM events")
def event_cdf(spark, sf_dir):
    """The cumulative share of every single event of its type: groups as large as the table."""
    return V.temporal_cdf(_events(spark, sf_dir), "TIMESTAMP_UTC", "DATA_TYPE").select("df_id", F.round("cdf", 6).alias("cdf"))


@_query(ORACLES["cosine_topk"])
def cosine_topk_indexed(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings")
    found = VectorIndex.build(v, centres=64).search(v.filter("vec_id % 100 = 0"), 5)
    return found.select("query_id", "rank", "vec_id", F.round("distance", 5).alias("distance"))


@_query("SELECT l_orderkey, count(*) AS lines, CASE WHEN l_orderkey % 500 = 1 THEN 'late' END AS note, true AS few_buckets FROM lineitem GROUP BY 1")
def keyed_batches(spark, sf_dir):
    """A keyed table and a small later batch, which rewrites a share of the buckets."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    path = scratch_path(spark, "keyed")
    upsert(lines.withColumn("lines", F.when(F.col("l_orderkey") % 500 == 1, -1).otherwise(F.col("lines")).cast("long")), path, "l_orderkey", buckets=256)
    late = lines.filter("l_orderkey % 500 = 1").withColumn("note", F.lit("late"))
    written, rows = upsert(late, path, "l_orderkey"), late.count()
    few = written <= min(rows, layout_of(spark, path)["buckets"])
    return read_keyed(spark, path).select("l_orderkey", "lines", "note", F.lit(few).alias("few_buckets"))


@_query("SELECT vec_id, embedding IS NOT NULL AS placed, true AS in_range FROM embeddings")
def landmark_projection(spark, sf_dir):
    """Every vector's place on the sphere; where it lies is held by a test, SQL only tells that it lies somewhere."""
    v = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("SEMANTIC_EMBEDDING"))
    lat, lon = F.col("SEMANTIC_EMBEDDING_UMAP_LATITUDE"), F.col("SEMANTIC_EMBEDDING_UMAP_LONGITUDE")
    return project_to_sphere_by_landmarks(v).select("vec_id", lat.isNotNull().alias("placed"), F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(True)).alias("in_range"))


@_query("""WITH e AS (SELECT event_id, date_trunc('hour', ts) AS h, event_type, CASE WHEN event_type = 'click' AND extract(hour FROM ts) < 6 THEN 1 ELSE 0 END AS a, CASE WHEN extract(hour FROM ts) BETWEEN 3 AND 8 THEN 1 ELSE 0 END AS b FROM events)
    SELECT h::TIMESTAMP AS hour_start, event_type AS grp, count(*) AS n, min(event_id) AS df_id FROM e WHERE a = 0 AND b = 1 GROUP BY 1, 2""")
def bitmap_selections(spark, sf_dir):
    """Hour buckets after one selection is kept and another taken away, from bitmaps alone."""
    base = B.add_temporal_buckets(_events(spark, sf_dir))
    index = BitmapIndex.of(base, "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE")
    buckets = index.buckets(index.everything)
    hours = F.hour("BUCKETED_TIMESTAMP_HOUR")
    kept = index.kept(index.everything, buckets.filter(hours.between(3, 8)))
    left = index.without(kept, buckets.filter((F.col("DATA_TYPE") == "click") & (hours < 6)))
    return index.buckets(left).select(_ntz("BUCKETED_TIMESTAMP_HOUR").alias("hour_start"), F.col("DATA_TYPE").alias("grp"), F.col("COUNT").alias("n"), "df_id")


@_query("SELECT event_id AS df_id, user_id FROM events WHERE NOT (event_type = 'click' AND extract(hour FROM ts) < 6)")
def bitmap_rows(spark, sf_dir):
    """The rows that a selection by bitmaps leaves."""
    base = B.add_temporal_buckets(_events(spark, sf_dir))
    index = BitmapIndex.of(base, "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE")
    left = index.without(index.everything, _picked(spark, sf_dir))
    return selected_rows(base, left).select("df_id", "user_id")
