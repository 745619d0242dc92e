"""Column functions: times, numbers, identifiers, paths and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

# File formats that count as video.
VIDEO_FORMATS = ["MP4", "MOV", "AVI", "MKV", "WMV", "FLV", "WEBM", "M4V", "3GP", "3G2", "MTS", "M2TS", "TS", "MXF", "DV", "F4V", "ASF", "RM", "RMVB", "VOB", "OGV"]


def parse_utc(text: Column) -> Column:
    """ISO-8601 text to a time: naive is UTC (the session's zone), offsets are applied, bad or null is null."""
    return F.try_to_timestamp(text)


def utc_offset(text: Column) -> Column:
    """The offset written in a time text, null if there is none."""
    found = F.regexp_extract(text, r"\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$", 1)
    return F.when(found != "", found)


def e7_to_degrees(value: Column) -> Column:
    return value / F.lit(1e7)


def to_number(value: Column, missing: float | None = None) -> Column:
    number = value.try_cast("double")
    return number if missing is None else F.coalesce(number, F.lit(missing))


def plain_double(value: Column) -> Column:
    """A double's text without an exponent, as identifiers use it."""
    plain = F.call_function("format_number", value, F.lit("0.0###############"))
    return F.when((F.abs(value) >= 1e-3) | (value == 0), value.cast("string")).otherwise(plain)


def iso_utc(ts: Column) -> Column:
    """ISO text with +00:00; a fraction only where it is not zero."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")), F.lit("+00:00"))


def point_uuid(first: list[Column], point: list[Column]) -> Column:
    """16 bytes: the head of SHA-256 over the file's first point and this point, joined by a bar."""
    return F.unhex(F.substring(F.sha2(F.concat_ws("|", *first, *point), 256), 1, 32))


def uuid7(millis: Column, random_12: Column, random_62: Column) -> Column:
    """48 bits of milliseconds, version 7, 12 bits, variant 2, 62 bits; as 16 bytes."""
    def digits(value: Column, n: int) -> Column:
        return F.lpad(F.hex(value), n, "0")

    high = F.shiftrightunsigned(random_62.bitwiseAND(F.lit((1 << 62) - 1)), 32).bitwiseOR(F.lit(1 << 31))
    low = random_62.bitwiseAND(F.lit((1 << 32) - 1))
    return F.unhex(F.concat(digits(millis.bitwiseAND(F.lit((1 << 48) - 1)), 12), F.lit("7"), digits(random_12.bitwiseAND(F.lit(4095)), 3), digits(high, 8), digits(low, 8)))


def uuid_text(value: Column) -> Column:
    h = F.lower(F.hex(value))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def classify_media(file_format: Column) -> Column:
    return F.when(F.upper(file_format).isin(VIDEO_FORMATS), F.lit("VIDEO")).otherwise(F.lit("PHOTO"))


def _join_path(left: Column, right: Column) -> Column:
    return F.when(right.startswith("/"), right).when((left == "") | left.endswith("/"), F.concat(left, right)).otherwise(F.concat(left, F.lit("/"), right))


def build_path(root: Column, relative: Column, name: Column) -> Column:
    """Root, relative folder and name joined; an absolute later part wins; no name gives null."""
    base = _join_path(F.coalesce(root, F.lit("")), F.coalesce(relative, F.lit("")))
    return F.when(name.isNotNull(), _join_path(base, name))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """The unit vector; a zero vector stays as it is, null stays null."""
    def scaled(norm: Column) -> Column:
        return F.transform(vector, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))

    return F.get(F.transform(F.array(l2_norm(vector)), scaled), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def text_code_embedding(text: Column) -> Column:
    """Code points of the first five characters; null if there are fewer."""
    codes = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.ascii(F.substring(text, i, F.lit(1))))
    return F.when(F.length(text) >= 5, codes)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of a whole row of ``df``; maps, which Spark does not hash, as their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema.fields])
