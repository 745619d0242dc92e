"""The registered queries of the linked-projection engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.spatial import haversine, level_depth, sphere_to_latlon
from ..operators import bucketing as B
from ..operators import embeddings as E
from ..operators import frames as V
from ..operators import profile as P
from ..operators import selection as X
from ..operators.schema import SEMANTIC_LAT, SEMANTIC_LON, TIME_LEVELS, bucket_column_name, normalize, validation_report
from ..scratch import scratch_path
from ..sources import catalog as C
from ..sources import readers as R
from ..sources.keyed_table import read_keyed, upsert
from ..sources.sinks import merged
from ..streaming.ingest import stream_ingest
from .session import LinkedSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the engine's names; coordinates are worked out from the id, a fiftieth missing."""
    e = _read(spark, sf_dir, "events")
    gone = F.col("event_id") % 50 == 0
    return e.select(
        F.col("event_id").alias("df_id"), F.col("ts").cast("timestamp").alias("TIMESTAMP_UTC"), F.col("event_type").alias("DATA_TYPE"), "user_id", "value",
        F.when(~gone, (F.col("event_id") * 7919) % 180001 / 1000.0 - 90).alias("GPS_LATITUDE"),
        F.when(~gone, (F.col("event_id") * 104729) % 360001 / 1000.0 - 180).alias("GPS_LONGITUDE"),
    )


_GEO = """WITH e AS (SELECT event_id AS df_id, ts, event_type, user_id, value,
    CASE WHEN event_id % 50 <> 0 THEN (event_id * 7919) % 180001 / 1000.0 - 90 END::DOUBLE AS lat,
    CASE WHEN event_id % 50 <> 0 THEN (event_id * 104729) % 360001 / 1000.0 - 180 END::DOUBLE AS lon FROM events),
    g AS (SELECT *, CAST(floor((lon + 180) / 360 * 16777216) AS BIGINT) % 16777216 AS x,
    least(CAST(floor((sin(radians(lat)) + 1) / 2 * 16777216) AS BIGINT), 16777215) AS y FROM e) """


def _cell(level: int) -> str:
    d = level_depth(level)
    return f"((y >> {24 - d}) << {d}) + (x >> {24 - d})"


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz")


@_query("SELECT event_id AS df_id, " + ", ".join(f"CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS {u.lower()}_start" for u in TIME_LEVELS) + " FROM events")
def temporal_buckets(spark, sf_dir):
    e = B.add_temporal_buckets(_events(spark, sf_dir))
    return e.select("df_id", *[_ntz(bucket_column_name("time", u)).alias(f"{u.lower()}_start") for u in TIME_LEVELS])


@_query("SELECT CAST(k AS INTEGER) AS level, n FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, count(DISTINCT date_trunc('{u}', ts)) AS n FROM events" for k, u in enumerate(TIME_LEVELS)) + ")")
def temporal_level_counts(spark, sf_dir):
    e = B.add_temporal_buckets(_events(spark, sf_dir))
    return B.level_counts(e, [bucket_column_name("time", u) for u in TIME_LEVELS]).select("level", "n")


@_query("""WITH c AS (SELECT count(*) AS total, """ + ", ".join(f"count(DISTINCT date_trunc('{u}', ts)) AS n{k}" for k, u in enumerate(TIME_LEVELS)) + """ FROM events)
    SELECT CASE WHEN total <= 1000 THEN 'none' """ + " ".join(f"WHEN n{k} <= 1000 THEN 'BUCKETED_TIMESTAMP_{u}'" for k, u in enumerate(TIME_LEVELS)) + """ ELSE 'BUCKETED_TIMESTAMP_YEAR' END AS level FROM c""")
def temporal_level_choice(spark, sf_dir):
    e = B.add_temporal_buckets(_events(spark, sf_dir))
    level = B.optimal_temporal_level(e, 1000)
    return e.groupBy().agg(F.max(F.lit(level or "none")).alias("level"))


_HOURS = """SELECT date_trunc('hour', ts)::TIMESTAMP AS hour_start, event_type AS grp, count(*) AS n, min(event_id) AS df_id FROM events GROUP BY 1, 2"""


def _hours(spark, sf_dir):
    return B.bucket_by_column(B.add_temporal_buckets(_events(spark, sf_dir)), "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE")


@_query(f"WITH b AS ({_HOURS}) SELECT hour_start, grp, n, b.df_id, e.user_id, e.value FROM b JOIN events e ON e.event_id = b.df_id")
def bucket_hour_by_type(spark, sf_dir):
    return _hours(spark, sf_dir).select(_ntz("BUCKETED_TIMESTAMP_HOUR").alias("hour_start"), F.col("DATA_TYPE").alias("grp"), F.col("COUNT").alias("n"), "df_id", "user_id", "value")


@_query(f"""WITH b AS ({_HOURS}) SELECT hour_start, grp, n, df_id, CAST(sum(n) OVER w AS BIGINT) AS total, grp || ' (' || CAST(CAST(sum(n) OVER w AS BIGINT) AS VARCHAR) || ')' AS label,
    round(sum(n) OVER (PARTITION BY grp ORDER BY hour_start, df_id ROWS UNBOUNDED PRECEDING) / sum(n) OVER w, 6)::DOUBLE AS cdf FROM b WINDOW w AS (PARTITION BY grp)""")
def temporal_cdf(spark, sf_dir):
    f = V.cdf_frame(_hours(spark, sf_dir), "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE")
    return f.select(_ntz("BUCKETED_TIMESTAMP_HOUR").alias("hour_start"), F.col("DATA_TYPE").alias("grp"), F.col("COUNT").alias("n"), "df_id", "total", "label", F.round("cdf", 6).alias("cdf"))


_PICKED = "date_trunc('hour', ts) IN (SELECT date_trunc('hour', ts) FROM events WHERE event_type = 'click') AND event_type = 'click' AND extract(hour FROM ts) < 6"


def _picked(spark, sf_dir):
    return _hours(spark, sf_dir).filter((F.col("DATA_TYPE") == "click") & (F.hour("BUCKETED_TIMESTAMP_HOUR") < 6))


@_query(f"SELECT event_id AS df_id FROM events WHERE {_PICKED}")
def filter_intersection(spark, sf_dir):
    base = B.add_temporal_buckets(_events(spark, sf_dir))
    return X.filter_to_buckets(base, _picked(spark, sf_dir), "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE").select("df_id")


@_query(f"SELECT event_id AS df_id FROM events WHERE NOT ({_PICKED})")
def filter_subtraction(spark, sf_dir):
    base = B.add_temporal_buckets(_events(spark, sf_dir))
    return X.subtract_buckets(base, _picked(spark, sf_dir), "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE").select("df_id")


@_query(f"{_GEO} SELECT {_cell(2)} AS cell, event_type AS grp, count(*) AS n, min(df_id) AS df_id FROM g WHERE x IS NOT NULL AND extract(hour FROM ts) < 6 AND event_type = 'click' GROUP BY 1, 2")
def linked_refilter(spark, sf_dir):
    base = B.add_bucketed_columns(_events(spark, sf_dir))
    kept = X.filter_to_buckets(base, _picked(spark, sf_dir), "BUCKETED_TIMESTAMP_HOUR", "DATA_TYPE")
    return B.bucket_by_column(kept, "BUCKETED_CELL_L2", "DATA_TYPE").select(F.col("BUCKETED_CELL_L2").alias("cell"), F.col("DATA_TYPE").alias("grp"), F.col("COUNT").alias("n"), "df_id")


@_query(f"{_GEO} SELECT df_id, " + ", ".join(f"{_cell(k)} AS c{k}" for k in range(16)) + " FROM g")
def geo_cells(spark, sf_dir):
    return B.add_geo_cells(_events(spark, sf_dir)).select("df_id", *[F.col(bucket_column_name("geo", k)).alias(f"c{k}") for k in range(16)])


@_query(f"{_GEO} SELECT CAST(k AS INTEGER) AS level, n FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, count(DISTINCT {_cell(k)}) AS n FROM g" for k in range(16)) + ")")
def geo_level_counts(spark, sf_dir):
    return B.geo_level_counts(_events(spark, sf_dir)).select("level", "n")


_GEO_BUCKETS = f"b AS (SELECT {_cell(3)} AS cell, event_type AS grp, count(*) AS n, min(df_id) AS df_id FROM g WHERE x IS NOT NULL GROUP BY 1, 2)"


def _geo_buckets(spark, sf_dir):
    return B.bucket_by_column(B.add_geo_cells(_events(spark, sf_dir)), "BUCKETED_CELL_L3", "DATA_TYPE")


@_query(f"{_GEO}, {_GEO_BUCKETS} SELECT cell, grp, n, b.df_id, round(g.lat, 6) AS lat, round(g.lon, 6) AS lon FROM b JOIN g ON g.df_id = b.df_id")
def geo_projection(spark, sf_dir):
    return _geo_buckets(spark, sf_dir).select(F.col("BUCKETED_CELL_L3").alias("cell"), F.col("DATA_TYPE").alias("grp"), F.col("COUNT").alias("n"), "df_id", F.round("GPS_LATITUDE", 6).alias("lat"), F.round("GPS_LONGITUDE", 6).alias("lon"))


@_query(f"{_GEO}, {_GEO_BUCKETS} SELECT df_id, CAST(sum(n) OVER (PARTITION BY grp) AS BIGINT) AS total, round(greatest(3.0, sqrt(n * 400 / max(n) OVER ())), 6)::DOUBLE AS marker_size FROM b")
def geo_markers(spark, sf_dir):
    return V.geo_frame(_geo_buckets(spark, sf_dir), "DATA_TYPE").select("df_id", "total", F.round("marker_size", 6).alias("marker_size"))


@_query(f"""{_GEO}, m AS (SELECT count(*) AS points, avg(cos(radians(lat)) * cos(radians(lon))) AS mx, avg(cos(radians(lat)) * sin(radians(lon))) AS my, avg(sin(radians(lat))) AS mz FROM e WHERE lat IS NOT NULL),
    c AS (SELECT points, degrees(atan2(mz, sqrt(mx * mx + my * my))) AS clat, degrees(atan2(my, mx)) AS clon FROM m),
    r AS (SELECT max(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lon - clon) / 2), 2))))) AS radius FROM e, c WHERE lat IS NOT NULL)
    SELECT points, round(clat, 4) AS center_lat, round(clon, 4) AS center_lon, round(radius / 1000, 2) AS radius_km, least(greatest(CAST(trunc(log2(156543.03392804097 / (radius / 200 / cos(radians(clat))))) AS INTEGER), 0), 20) AS zoom FROM c, r""")
def geo_view(spark, sf_dir):
    v = V.map_view(_events(spark, sf_dir))
    return v.select("points", F.round("center_lat", 4).alias("center_lat"), F.round("center_lon", 4).alias("center_lon"), F.round(F.col("radius_m") / 1000, 2).alias("radius_km"), "zoom")


@_query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS g, date_trunc('day', o_orderdate) AS d, date_trunc('month', o_orderdate) AS m, date_trunc('year', o_orderdate) AS y FROM orders),
    s AS (SELECT g, count(*) AS n, count(DISTINCT d) AS nd, count(DISTINCT m) AS nm, count(DISTINCT y) AS ny FROM o GROUP BY g),
    l AS (SELECT g, CASE WHEN n <= 100 THEN NULL WHEN nd <= 100 THEN 'day' WHEN nm <= 100 THEN 'month' ELSE 'year' END AS level FROM s)
    SELECT o.g AS group_name, level, min(o_orderkey) AS df_id, CASE WHEN level IS NOT NULL THEN count(*) END AS n FROM o JOIN l ON o.g = l.g
    GROUP BY o.g, level, CASE WHEN level = 'day' THEN CAST(d AS VARCHAR) WHEN level = 'month' THEN CAST(m AS VARCHAR) WHEN level = 'year' THEN CAST(y AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END""")
def grouped_projection(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("df_id"), "o_orderpriority", *[F.date_trunc(u, F.col("o_orderdate")).alias(u) for u in ("day", "month", "year")])
    p = B.grouped_bucketed_projection(rows, ["o_orderpriority"], ["day", "month", "year"], 100)
    return p.select("group_name", F.col("bucket_column").alias("level"), "df_id", F.col("COUNT").alias("n"))


@_query("""WITH f AS (SELECT user_id, min(event_id) AS df_id FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), t AS (SELECT * FROM f ORDER BY df_id LIMIT 100)
    SELECT string_agg('u' || user_id, ',' ORDER BY df_id) AS uuids, count(*) AS n FROM t""")
def active_ids(spark, sf_dir):
    e = _events(spark, sf_dir)
    kinds = F.when(F.col("DATA_TYPE") == "click", "PHOTO").when(F.col("DATA_TYPE") == "view", "VIDEO").otherwise("OTHER")
    return X.active_uuids(e.withColumn("DATA_TYPE", kinds).withColumn("UUID_STRING", F.concat(F.lit("u"), "user_id")), 100)


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 3 = 0 THEN 'new' END AS note FROM orders""")
def upsert_merge(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("new").alias("note"))
    return merged(o, new, "o_orderkey")


@_query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def dedup_key(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return X.keep_first(o, "o_custkey", "o_orderkey")


@_query("SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem")
def dedup_rows(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").transform(X.dedup_rows)


@_query("SELECT o_orderpriority AS source, count(*) AS rows FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) GROUP BY 1")
def duplicate_report(spark, sf_dir):
    return P.duplicate_report(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority").withColumnRenamed("o_orderpriority", "source")


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_embeddings(spark, sf_dir):
    items = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("UUID_STRING"))
    known = _read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("UUID_STRING"))
    return E.missing_embeddings(items, known).withColumnRenamed("UUID_STRING", "c_custkey")


@_query("SELECT e.event_id AS df_id, c.c_name AS name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def attach_projection(spark, sf_dir):
    names = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("UUID_STRING"), F.col("c_name").alias("name"))
    e = _events(spark, sf_dir).select("df_id", F.col("user_id").alias("UUID_STRING"))
    return E.attach_projection(e, names).select("df_id", "name")


@_query("SELECT doc_id, CASE WHEN length(text) >= 5 THEN array_to_string([CAST(unicode(substr(text, CAST(i AS INTEGER), 1)) AS VARCHAR) for i in generate_series(1, 5)], ',') END AS codes FROM documents")
def text_code_embedding(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(S.text_code_embedding(F.col("text")), ",").alias("codes"))


@_query("SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) / n for x in embedding]), 5) AS total FROM (SELECT vec_id, embedding, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])) AS n FROM embeddings)")
def l2_normalize(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings").select("vec_id", S.l2_normalize(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@_query("""WITH n AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, 1 - list_cosine_similarity(q.v, c.v) AS d FROM n q JOIN n c ON q.vec_id % 100 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, round(d, 5) AS distance FROM s QUALIFY rank <= 5""")
def cosine_topk(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings")
    return E.cosine_topk(v.filter("vec_id % 100 = 0"), v, 5).select("query_id", "rank", "vec_id", F.round("distance", 5).alias("distance"))


@_query("SELECT event_id AS df_id, round(90 - degrees(acos(cos(event_id / 1000.0))), 6)::DOUBLE AS lat, round(degrees(atan2(sin(event_id / 1000.0) * cos(event_id / 700.0), sin(event_id / 1000.0) * sin(event_id / 700.0))), 6)::DOUBLE AS lon FROM events")
def sphere_coordinates(spark, sf_dir):
    lat, lon = sphere_to_latlon(F.col("df_id") / 1000.0, F.col("df_id") / 700.0)
    return _events(spark, sf_dir).select("df_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@_query(f"{_GEO} SELECT df_id, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(lat)) * pow(sin(radians(lon + 74.0) / 2), 2)))), 4) AS km FROM e")
def haversine_km(spark, sf_dir):
    return _events(spark, sf_dir).select("df_id", F.round(haversine(F.lit(40.0), F.lit(-74.0), F.col("GPS_LATITUDE"), F.col("GPS_LONGITUDE")) / 1000, 4).alias("km"))


@_query("SELECT event_id AS df_id, substr(sha256('first|' || CAST(user_id AS VARCHAR) || '|' || event_type || '|' || CAST(event_id AS VARCHAR)), 1, 32) AS id FROM events")
def point_uuid(spark, sf_dir):
    u = S.point_uuid([F.lit("first"), F.col("user_id").cast("string")], [F.col("DATA_TYPE"), F.col("df_id").cast("string")])
    return _events(spark, sf_dir).select("df_id", F.lower(F.hex(u)).alias("id"))


@_query("SELECT event_id AS df_id, lpad(lower(to_hex(1700000000000 + event_id)), 12, '0') || '7' || lpad(lower(to_hex(event_id % 4096)), 3, '0') || lower(to_hex(2147483648)) || lpad(lower(to_hex(user_id)), 8, '0') AS id FROM events")
def uuid7(spark, sf_dir):
    u = S.uuid7(F.lit(1_700_000_000_000) + F.col("df_id"), F.col("df_id") % 4096, F.col("user_id"))
    return _events(spark, sf_dir).select("df_id", F.lower(F.hex(u)).alias("id"))


@_query("""SELECT 'doc_id' AS "column", count(*) AS rows, CAST(8 * count(doc_id) AS BIGINT) AS bytes FROM documents UNION ALL SELECT 'text', count(*), CAST(sum(octet_length(encode(text))) AS BIGINT) FROM documents
    UNION ALL SELECT 'lang', count(*), CAST(sum(octet_length(encode(lang))) AS BIGINT) FROM documents UNION ALL SELECT 'source', count(*), CAST(sum(octet_length(encode(source))) AS BIGINT) FROM documents UNION ALL SELECT 'n_chars', count(*), CAST(8 * count(n_chars) AS BIGINT) FROM documents""")
def column_profile(spark, sf_dir):
    return P.column_sizes(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@_query(f"{_GEO} SELECT 'data_type_missing' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'data_type_unknown', count(*) FROM e UNION ALL SELECT 'latitude_range', count(*) FILTER (lat * 1.5 NOT BETWEEN -90 AND 90) FROM e UNION ALL SELECT 'longitude_range', count(*) FILTER (lon NOT BETWEEN -180 AND 180) FROM e UNION ALL SELECT 'rating_range', 0 UNION ALL SELECT 'size_negative', count(*) FILTER (user_id - 50 < 0) FROM e")
def validation(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("GPS_LATITUDE", F.col("GPS_LATITUDE") * 1.5).withColumn("SIZE_IN_BYTES", F.col("user_id") - 50)
    return validation_report(normalize(e))


@_query("SELECT event_type AS group_name, count(*) AS rows FROM events GROUP BY 1")
def order_groups(spark, sf_dir):
    return B.order_groups(_events(spark, sf_dir).withColumn("group_name", B.group_name(["DATA_TYPE"])).withColumn("COUNT", F.lit(None).cast("long")))


@_query("SELECT count(*) FILTER (event_id % 50 = 0) AS GPS_LATITUDE, 0::BIGINT AS DATA_TYPE FROM events")
def count_missing(spark, sf_dir):
    return P.count_missing(_events(spark, sf_dir), ["GPS_LATITUDE", "DATA_TYPE"])


@_query()
def project_to_sphere(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("SEMANTIC_EMBEDDING"))
    return E.project_to_sphere(v).drop("SEMANTIC_EMBEDDING")


@_query("WITH c AS (" + _GEO + "SELECT count(*) AS total, " + ", ".join(f"count(DISTINCT {_cell(k)}) AS n{k}" for k in range(16)) + " FROM g) SELECT CASE WHEN total <= 1000 THEN 'none' " + " ".join(f"WHEN n{k} <= 1000 THEN '{bucket_column_name('geo', k)}'" for k in reversed(range(16))) + f" ELSE '{bucket_column_name('geo', 0)}' END AS level FROM c")
def geo_level_choice(spark, sf_dir):
    e = B.add_geo_cells(_events(spark, sf_dir))
    level = B.optimal_geo_level(e, 1000)
    return e.groupBy().agg(F.max(F.lit(level or "none")).alias("level"))


@_query(f"WITH b AS ({_HOURS}) SELECT row_number() OVER (ORDER BY df_id) - 1 AS df_id, df_id AS row_id, grp, n FROM b")
def bucket_numbers(spark, sf_dir):
    return B.renumbered(_hours(spark, sf_dir)).select("df_id", "row_id", F.col("DATA_TYPE").alias("grp"), F.col("COUNT").alias("n"))


@_query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS g, date_trunc('day', o_orderdate) AS d FROM orders), s AS (SELECT g, count(*) AS n FROM o GROUP BY g),
    p AS (SELECT o.g, min(o_orderkey) AS row_id, CASE WHEN s.n > 100 THEN count(*) END AS n, any_value(s.n) AS total FROM o JOIN s ON o.g = s.g GROUP BY o.g, s.n, CASE WHEN s.n > 100 THEN CAST(d AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END)
    SELECT row_number() OVER (ORDER BY total DESC, g, row_id) - 1 AS df_id, row_id, g AS group_name, n FROM p""")
def grouped_order(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("df_id"), "o_orderpriority", F.date_trunc("day", F.col("o_orderdate")).alias("day"))
    p = B.in_group_order(B.grouped_bucketed_projection(rows, ["o_orderpriority"], ["day"], 100))
    return p.select("df_id", "row_id", "group_name", F.col("COUNT").alias("n"))


@_query("SELECT CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+01:00' WHEN 2 THEN '-07:00' END AS \"offset\", count(*) AS rows FROM events GROUP BY 1")
def utc_offset_counts(spark, sf_dir):
    e = _events(spark, sf_dir)
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+01:00"), F.lit("-07:00"), F.lit("")), (F.col("df_id") % 4 + 1).cast("int"))
    text = F.concat(F.date_format("TIMESTAMP_UTC", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return P.utc_offset_counts(e.withColumn("TIMESTAMP_MAYBE_TIMEZONE_AWARE", text))


@_query("""SELECT event_id AS df_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE event_id / 8.0 END::DOUBLE AS number, event_id * 1000 / 1e7 AS degrees,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN date_trunc('second', ts) - INTERVAL 1 HOUR ELSE date_trunc('second', ts) END::TIMESTAMP AS utc FROM events""")
def parsed_scalars(spark, sf_dir):
    e = _events(spark, sf_dir)
    number = F.when(F.col("df_id") % 3 == 0, "n/a").otherwise((F.col("df_id") / 8).cast("string"))
    zone = F.when(F.col("df_id") % 5 == 0, " at noon").when(F.col("df_id") % 5 == 1, "+01:00").when(F.col("df_id") % 5 == 2, "Z").otherwise("")
    time = F.concat(F.date_format("TIMESTAMP_UTC", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return e.select("df_id", S.to_number(number, 0.0).alias("number"), S.e7_to_degrees(F.col("df_id") * 1000).alias("degrees"), S.parse_utc(time).cast("timestamp_ntz").alias("utc"))


@_query("SELECT event_id AS df_id, event_type AS data_type FROM events WHERE user_id = (SELECT max(user_id) FROM events) ORDER BY event_id LIMIT 1")
def row_metadata(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("UUID_STRING", F.col("user_id").cast("string"))
    row = F.from_json(F.lit(X.row_metadata(e, str(e.agg(F.max("user_id")).first()[0]))), "df_id long, DATA_TYPE string")
    return e.limit(1).select(row["df_id"].alias("df_id"), row["DATA_TYPE"].alias("data_type"))


@_query(f"WITH b AS ({_HOURS}) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS points, true AS bucketed, 'BUCKETED_TIMESTAMP_HOUR' AS level FROM b")
def plot_totals(spark, sf_dir):
    return V.plot_totals(_hours(spark, sf_dir), "BUCKETED_TIMESTAMP_HOUR")


@_query(f"WITH b AS ({_HOURS}) SELECT count(*) AS points, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM b WHERE grp = 'click' AND extract(hour FROM hour_start) < 6")
def selection_stats(spark, sf_dir):
    return V.selection_stats(_picked(spark, sf_dir))


@_query(f"{_GEO} SELECT 'f' || user_id AS source_file, ts::TIMESTAMP AS first_time, event_type AS data_type, lat, lon FROM e WHERE lat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, lat, lon) = 1")
def first_point_per_file(spark, sf_dir):
    points = _events(spark, sf_dir).filter("GPS_LATITUDE is not null").withColumn("SOURCE_FILE", F.concat(F.lit("f"), "user_id"))
    return R.first_point_per_file(points).select(F.col("SOURCE_FILE").alias("source_file"), _ntz("TIMESTAMP_UTC").alias("first_time"), F.col("DATA_TYPE").alias("data_type"), F.col("GPS_LATITUDE").alias("lat"), F.col("GPS_LONGITUDE").alias("lon"))


@_query("SELECT event_id AS df_id, event_id % 3 = 0 AS kept FROM events WHERE event_id % 3 = 0 OR event_id % 3 = 1")
def filter_by_ids(spark, sf_dir):
    e = _events(spark, sf_dir).select("df_id")
    chosen = e.filter("df_id % 3 = 0").union(e.select(-F.col("df_id") - 1))
    rest = X.subtract_ids(e, e.filter("df_id % 3 <> 1"))
    return X.filter_to_ids(e, chosen).withColumn("kept", F.lit(True)).union(rest.withColumn("kept", F.lit(False)))


_LEVEL = "CASE WHEN (SELECT count(DISTINCT date_trunc('second', ts)) FROM events) <= 1000 THEN date_trunc('second', ts) WHEN (SELECT count(DISTINCT date_trunc('minute', ts)) FROM events) <= 1000 THEN date_trunc('minute', ts) WHEN (SELECT count(DISTINCT date_trunc('hour', ts)) FROM events) <= 1000 THEN date_trunc('hour', ts) ELSE date_trunc('day', ts) END"


@_query(f"WITH b AS (SELECT event_id, count(*) OVER (PARTITION BY {_LEVEL}, event_type) AS n FROM events) SELECT event_id AS df_id FROM b WHERE n >= 3")
def session_filter(spark, sf_dir):
    s = LinkedSession(_events(spark, sf_dir), families=("time",), max_rows=1000)
    s.apply_filter("time", [r.df_id for r in s.projections["time"].rows.filter("COUNT >= 3").select("df_id").collect()])
    return s.subset.select("df_id")


_SEMANTIC = _GEO.replace("7919) % 180001", "104729) % 180001").replace("104729) % 360001", "7919) % 360001")


def _semantic(spark, sf_dir):
    gone = F.col("event_id") % 50 == 0
    e = _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("df_id"), F.col("event_type").alias("DATA_TYPE"),
        F.when(~gone, (F.col("event_id") * 104729) % 180001 / 1000.0 - 90).alias(SEMANTIC_LAT),
        F.when(~gone, (F.col("event_id") * 7919) % 360001 / 1000.0 - 180).alias(SEMANTIC_LON))
    return B.add_semantic_cells(E.drop_empty_embeddings(e))


@_query(f"{_SEMANTIC}, b AS (SELECT {_cell(3)} AS cell, coalesce(event_type, 'Unknown') AS grp, count(*) AS n, min(df_id) AS df_id FROM g WHERE x IS NOT NULL GROUP BY 1, 2) SELECT cell, grp, n, df_id, CAST(sum(n) OVER (PARTITION BY grp) AS BIGINT) AS total, round(greatest(3.0, sqrt(n * 400 / max(n) OVER ())), 6)::DOUBLE AS marker_size FROM b")
def semantic_projection(spark, sf_dir):
    level = bucket_column_name("semantic", 3)
    f = V.semantic_frame(B.bucket_by_column(_semantic(spark, sf_dir), level, "DATA_TYPE"), "DATA_TYPE", SEMANTIC_LAT, SEMANTIC_LON)
    return f.select(F.col(level).alias("cell"), F.col("DATA_TYPE").alias("grp"), F.col("COUNT").alias("n"), "df_id", "total", F.round("marker_size", 6).alias("marker_size"))


@_query("WITH c AS (" + _SEMANTIC + "SELECT count(*) AS total, " + ", ".join(f"count(DISTINCT {_cell(k)}) AS n{k}" for k in range(16)) + " FROM g WHERE x IS NOT NULL) SELECT CASE WHEN total <= 500 THEN 'none' " + " ".join(f"WHEN n{k} <= 500 THEN '{bucket_column_name('semantic', k)}'" for k in reversed(range(16))) + f" ELSE '{bucket_column_name('semantic', 0)}' END AS level FROM c")
def semantic_level_choice(spark, sf_dir):
    e = _semantic(spark, sf_dir)
    level = B.optimal_semantic_level(e, 500)
    return e.groupBy().agg(F.max(F.lit(level or "none")).alias("level"))


@_query("SELECT coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type END, '?') || ', ' || (user_id % 3) AS marked, coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type END, 'Unknown') AS filled, count(*) AS n FROM events GROUP BY 1, 2")
def null_groups(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("DATA_TYPE", F.when(F.col("df_id") % 7 != 0, F.col("DATA_TYPE"))).withColumn("third", F.col("user_id") % 3)
    return e.groupBy(B.group_name(["DATA_TYPE", "third"]).alias("marked"), B.fill_group_unknown("DATA_TYPE").alias("filled")).agg(F.count("*").alias("n"))


@_query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def missing_some(spark, sf_dir):
    items = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("UUID_STRING"))
    return E.missing_embeddings(items, items.filter("UUID_STRING % 3 = 0")).withColumnRenamed("UUID_STRING", "c_custkey")


@_query("SELECT 0::BIGINT AS o_orderkey, count(*) FILTER (o_orderkey % 7 = 0) AS clerk FROM orders")
def missing_values(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").withColumn("clerk", F.when(F.col("o_orderkey") % 7 != 0, "c"))
    return P.count_missing(o, ["o_orderkey", "clerk"])


@_query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(coalesce(text, '')) AS DOUBLE) AS length FROM documents WHERE doc_id % 3 <> 0")
def embed_missing(spark, sf_dir):
    items = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("UUID_STRING"), "text")
    found = E.embed_incremental(items, items.filter("UUID_STRING % 3 = 0"), "text", lambda texts: [[float(len(t or ""))] for t in texts])
    return found.select(F.col("UUID_STRING").alias("id"), F.col("SEMANTIC_EMBEDDING")[0].cast("double").alias("length"))


_CATALOG = """SELECT 'g' || o_orderkey AS uuid, CASE WHEN o_orderkey % 4 = 0 THEN 'VIDEO' ELSE 'PHOTO' END AS data_type, 'f' || c_custkey || '.jpg' AS name, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS caption,
    '/root' || r_regionkey || '/' || n_name || '/' || 'f' || c_custkey || '.jpg' AS path, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 90 END::DOUBLE AS lat, CAST(o_orderkey % 6 AS INTEGER) AS rating
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""


@_query(_CATALOG)
def catalog_images(spark, sf_dir):
    o, c, n, r = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    key = F.col("o_orderkey")
    tables = {
        "Adobe_images": o.select(key.alias("id_local"), F.concat(F.lit("g"), key).alias("id_global"), F.col("o_custkey").alias("rootFile"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("captureTime"), (key % 6).alias("rating"), F.when(key % 4 == 0, "ts").otherwise("RAW").alias("fileFormat")),
        "AgLibraryFile": c.select(F.col("c_custkey").alias("id_local"), F.concat(F.lit("f"), "c_custkey", F.lit(".jpg")).alias("idx_filename"), F.col("c_nationkey").alias("folder")),
        "AgLibraryFolder": n.select(F.col("n_nationkey").alias("id_local"), F.concat("n_name", F.lit("/")).alias("pathFromRoot"), F.col("n_regionkey").alias("rootFolder")),
        "AgLibraryRootFolder": r.select(F.col("r_regionkey").alias("id_local"), F.concat(F.lit("/root"), "r_regionkey").alias("absolutePath")),
        "AgHarvestedExifMetadata": o.filter(key % 3 == 0).select(key.alias("image"), (key % 90).cast("string").alias("gpsLatitude"), F.lit("x").alias("gpsLongitude")),
        "AgLibraryIPTC": o.filter(key % 5 == 0).select(key.alias("image"), F.col("o_orderpriority").alias("caption")),
    }
    found = C.catalog_images(tables)
    return found.select(F.col("UUID_STRING").alias("uuid"), F.col("DATA_TYPE").alias("data_type"), F.col("NAME").alias("name"), F.col("CAPTION").alias("caption"), F.col("SOURCE_FILE").alias("path"), F.col("GPS_LATITUDE").alias("lat"), F.col("RATING_0_TO_5").alias("rating"))


@_query("""WITH k AS (SELECT l_orderkey AS image_id, string_agg('s' || l_suppkey, ',' ORDER BY 's' || l_suppkey) AS names FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1)
    SELECT o_orderkey AS image_id, coalesce(names, '') AS keywords FROM orders LEFT JOIN k ON image_id = o_orderkey""")
def catalog_keywords(spark, sf_dir):
    links = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_suppkey").alias("tag"))
    names = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id_local"), F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("s"), "s_suppkey")).alias("name"))
    images = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    return C.attach_lists(images, C.catalog_keywords(links, names), "KEYWORDS").select("image_id", F.array_join("KEYWORDS", ",").alias("keywords"))


@_query("""SELECT l_orderkey AS image_id, string_agg('s' || l_suppkey, ',' ORDER BY 's' || l_suppkey) AS collections FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1""")
def catalog_collections(spark, sf_dir):
    links = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_suppkey").alias("collection"))
    names = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id_local"), F.when(F.col("s_suppkey") % 5 == 0, "Quick Collection").otherwise(F.concat(F.lit("s"), "s_suppkey")).alias("name"))
    return C.catalog_collections(links, names).select("image_id", F.array_join("COLLECTIONS", ",").alias("collections"))


@_query(ORACLES["upsert_merge"])
def upsert_table(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = scratch_path(spark, "upsert")
    upsert(o, path, "o_orderkey")
    upsert(o.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("new").alias("note")), path, "o_orderkey")
    return read_keyed(spark, path)


@_query("SELECT CAST(event_id AS VARCHAR) AS uuid, date_trunc('second', ts)::TIMESTAMP AS utc, date_trunc('hour', ts)::TIMESTAMP AS hour_start FROM events")
def stream_of_files(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("df_id").cast("string").alias("UUID_STRING"), F.date_format("TIMESTAMP_UTC", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("TIMESTAMP_UTC"))
    source, target, state = (scratch_path(spark, f"stream-{k}") for k in ("source", "target", "state"))
    e.union(e.filter("UUID_STRING % 4 = 0")).write.json(source)
    stream_ingest(spark, source, e.schema, target, state).awaitTermination()
    return read_keyed(spark, target).select(F.col("UUID_STRING").alias("uuid"), _ntz("TIMESTAMP_UTC").alias("utc"), _ntz("BUCKETED_TIMESTAMP_HOUR").alias("hour_start"))


@_query("SELECT row_number() OVER (ORDER BY event_id) - 1 >= 0 AS numbered, CAST(event_id AS VARCHAR) AS uuid, date_trunc('second', ts)::TIMESTAMP AS utc, CAST(user_id % 6 AS INTEGER) AS rating FROM events")
def json_lines(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("df_id").cast("string").alias("UUID_STRING"), F.lit("PHOTO").alias("DATA_TYPE"), F.date_format("TIMESTAMP_UTC", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("TIMESTAMP_UTC"), (F.col("user_id") % 6).alias("RATING_0_TO_5"))
    path = scratch_path(spark, "json-lines")
    e.write.json(path)
    return R.read_jsonl(spark, path).select((F.col("df_id") >= 0).alias("numbered"), F.col("UUID_STRING").alias("uuid"), _ntz("TIMESTAMP_UTC").alias("utc"), F.col("RATING_0_TO_5").alias("rating"))


@_query("SELECT 'e' || event_id AS uuid, event_type AS data_type FROM events UNION ALL SELECT 'o' || o_orderkey, 'ORDER' FROM orders")
def union_of_sources(spark, sf_dir):
    e = _events(spark, sf_dir).select("df_id", F.concat(F.lit("e"), "df_id").alias("UUID_STRING"), "DATA_TYPE")
    o = _read(spark, sf_dir, "orders").select(F.lit(0).alias("df_id"), F.concat(F.lit("o"), "o_orderkey").alias("UUID_STRING"), F.lit("ORDER").alias("DATA_TYPE"))
    return R.union_sources(e, o).select(F.col("UUID_STRING").alias("uuid"), F.col("DATA_TYPE").alias("data_type"))


@_query(f"{_GEO} SELECT CAST(df_id AS VARCHAR) AS uuid, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_start, {_cell(5)} AS cell FROM g WHERE x IS NOT NULL")
def ingest_points(spark, sf_dir):
    points = _events(spark, sf_dir).filter("GPS_LATITUDE is not null").withColumn("UUID_STRING", F.col("df_id").cast("string")).withColumn("SOURCE_FILE", F.concat(F.lit("f"), "user_id"))
    found = R.ingest_tracks(points.union(points.filter("df_id % 4 = 1")))
    return found.select(F.col("UUID_STRING").alias("uuid"), _ntz("BUCKETED_TIMESTAMP_HOUR").alias("hour_start"), F.col("BUCKETED_CELL_L5").alias("cell"))
