"""Column functions on the globe: nested equal-area cells, distances, sphere coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
LEVELS = 16
DEPTH = 24


def level_depth(level: int) -> int:
    if not 0 <= level < LEVELS:
        raise ValueError(f"level {level} is not in 0..{LEVELS - 1}")
    return 3 + 7 * level // 5


def _grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Column and row of a point in the finest grid."""
    side = 1 << DEPTH
    x = F.pmod(F.floor((lon + 180) / 360 * side), F.lit(side)).cast("long")
    y = F.least(F.floor((F.sin(F.radians(lat)) + 1) / 2 * side), F.lit(side - 1)).cast("long")
    return x, y


def cell_key(lat: Column, lon: Column, level: int) -> Column:
    """The cell of a point at a level; null if either coordinate is. Cells of a level nest in the next coarser."""
    depth = level_depth(level)
    x, y = _grid(lat, lon)
    key = F.shiftleft(F.shiftright(y, DEPTH - depth), depth) + F.shiftright(x, DEPTH - depth)
    return F.when(lat.isNotNull() & lon.isNotNull(), key)


def cell_paths(df: DataFrame, lat: str, lon: str, name: str = "path") -> DataFrame:
    """One column: the bits of each point's row and column in turn, so that the leading ``2 * level_depth(k)`` of 48 bits name its cell at level k. Points without a place are left out."""
    bits = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*[c.alias(n) for c, n in zip(_grid(F.col(lat), F.col(lon)), "xy")])
    for step in (16, 8, 4, 2, 1):
        mask = F.lit(sum(((1 << step) - 1) << (2 * step * k) for k in range(32 // step)) & ((1 << 63) - 1))
        bits = bits.select(*[(F.col(c).bitwiseOR(F.shiftleft(c, step))).bitwiseAND(mask).alias(c) for c in "xy"])
    return bits.select(F.shiftleft("y", 1).bitwiseOR(F.col("x")).alias(name))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def sphere_to_latlon(theta: Column, phi: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of spherical angles."""
    lat = 90 - F.degrees(F.acos(F.cos(theta)))
    lon = F.degrees(F.atan2(F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi)))
    return lat, lon


def zoom_of(radius_m: Column, lat: Column, points: Column) -> Column:
    """Map zoom that shows a radius: 0..20; one point 14; no point 1."""
    per_pixel = radius_m / 200 / F.cos(F.radians(lat))
    # Fixed value: metres a pixel of the whole map at the equator.
    zoom = F.log2(F.lit(156543.03392804097) / per_pixel).cast("int")
    fitted = F.when(per_pixel > 0, F.least(F.greatest(zoom, F.lit(0)), F.lit(20))).otherwise(F.lit(20))
    return F.when(points == 0, F.lit(1)).when(points == 1, F.lit(14)).otherwise(fitted)


def clip(value: Column, bound: float) -> Column:
    """Clamp to -bound..bound; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(-float(bound)), F.least(F.lit(float(bound)), value)))

