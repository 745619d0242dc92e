"""Photo-catalog tables, given as DataFrames, to the common schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import build_path, classify_media, parse_utc, to_number
from ..operators.schema import normalize

# Fixed value: the collection that is the catalog's own.
IGNORED_COLLECTIONS = ["quick collection"]

# Further columns of the catalog's tables that are kept under their own names.
EXTRA = {
    "i": ["rootFile", "captureTime", "rating", "colorLabels", "fileFormat", "originalCaptureTime", "pick", "touchTime"],
    "f": ["importHash", "baseName", "extension"],
    "d": ["pathFromRoot"],
    "r": ["absolutePath"],
    "x": ["focalLength", "aperture", "flashFired"],
}
_TABLE_OF = {"i": "Adobe_images", "f": "AgLibraryFile", "d": "AgLibraryFolder", "r": "AgLibraryRootFolder", "x": "AgHarvestedExifMetadata"}


def catalog_images(tables: dict[str, DataFrame]) -> DataFrame:
    """Images with file, folder, root, exposure and text tables left-joined, one row an image; the columns of ``EXTRA`` follow where their tables have them."""
    t = tables
    images = t["Adobe_images"].alias("i")
    joined = (
        images.join(t["AgLibraryFile"].alias("f"), F.col("i.rootFile") == F.col("f.id_local"), "left")
        .join(t["AgLibraryFolder"].alias("d"), F.col("f.folder") == F.col("d.id_local"), "left")
        .join(t["AgLibraryRootFolder"].alias("r"), F.col("d.rootFolder") == F.col("r.id_local"), "left")
        .join(t["AgHarvestedExifMetadata"].alias("x"), F.col("i.id_local") == F.col("x.image"), "left")
        .join(t["AgLibraryIPTC"].alias("p"), F.col("i.id_local") == F.col("p.image"), "left")
    )
    rows = joined.select(
        F.col("i.id_local").alias("image_id"),
        F.col("i.id_global").alias("UUID_STRING"),
        classify_media(F.col("i.fileFormat")).alias("DATA_TYPE"),
        F.col("f.idx_filename").alias("NAME"),
        F.col("p.caption").alias("CAPTION"),
        build_path(F.col("r.absolutePath"), F.col("d.pathFromRoot"), F.col("f.idx_filename")).alias("SOURCE_FILE"),
        F.col("i.captureTime").alias("TIMESTAMP_MAYBE_TIMEZONE_AWARE"),
        parse_utc(F.col("i.captureTime")).alias("TIMESTAMP_UTC"),
        to_number(F.col("x.gpsLatitude")).alias("GPS_LATITUDE"),
        to_number(F.col("x.gpsLongitude")).alias("GPS_LONGITUDE"),
        to_number(F.col("i.rating"), 0).cast("int").alias("RATING_0_TO_5"),
        *[F.col(f"{of}.{name}").alias(name) for of, names in EXTRA.items() for name in names if name in t[_TABLE_OF[of]].columns],
    )
    return normalize(rows.distinct())


def _lists(links: DataFrame, names: DataFrame, link: str, out: str) -> DataFrame:
    named = links.join(names, F.col(link) == F.col("id_local")).filter("name is not null")
    return named.groupBy(F.col("image").alias("image_id")).agg(F.sort_array(F.collect_list("name")).alias(out))


def catalog_keywords(links: DataFrame, keywords: DataFrame) -> DataFrame:
    """(image_id, KEYWORDS): sorted names; nameless ones are left out, repeated ones stay."""
    return _lists(links.select("image", "tag"), keywords.select("id_local", "name"), "tag", "KEYWORDS")


def catalog_collections(links: DataFrame, collections: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """(image_id, COLLECTIONS), without the ignored names, whatever their case."""
    left_out = [n.lower() for n in (IGNORED_COLLECTIONS if ignore is None else ignore)]
    kept = collections.select("id_local", "name").filter(~F.lower("name").isin(left_out)) if left_out else collections.select("id_local", "name")
    return _lists(links.select("image", "collection"), kept, "collection", "COLLECTIONS")


def attach_lists(images: DataFrame, lists: DataFrame, column: str) -> DataFrame:
    """Left join; images without any get an empty list."""
    return images.join(lists, "image_id", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
