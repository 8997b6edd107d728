"""Projections between blocks, degrees, Mercator tiles and raster pixels, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.constants import CIRCUMFERENCE_M, CLIMATE_LAT, COVER_LAT, MAX_STEP, MERCATOR_LAT, TILE_PX


def block_to_lonlat(x: Column, z: Column, scale: float) -> tuple[Column, Column]:
    """Degrees of a block position; north is negative z. A scale of 0 or less gives 0."""
    if scale <= 0:
        return F.lit(0.0), F.lit(0.0)
    per_degree = CIRCUMFERENCE_M / 360.0 / scale
    return x / F.lit(per_degree), -z / F.lit(per_degree)


def lonlat_to_block(lon: Column, lat: Column, scale: float) -> tuple[Column, Column]:
    if scale <= 0:
        return F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    per_degree = CIRCUMFERENCE_M / 360.0 / scale
    return F.floor(lon * per_degree), F.floor(-lat * per_degree)


def mercator_xy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional tile position, or null outside the projection."""
    n, phi = float(2**zoom), F.radians(lat)
    x = (lon + 180.0) / 360.0 * n
    y = (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n
    ok = lat.between(-MERCATOR_LAT, MERCATOR_LAT) & lon.between(-180, 180) & (x >= 0) & (x < n) & (y >= 0) & (y < n)
    return F.when(ok, x), F.when(ok, y)


def mercator_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    x, y = mercator_xy(lon, lat, zoom)
    return F.floor(x), F.floor(y)


def pixel_to_lonlat(px: Column, py: Column, zoom: int) -> tuple[Column, Column]:
    size = float(TILE_PX * 2**zoom)
    return px / size * 360.0 - 180.0, F.degrees(F.atan(F.sinh(math.pi - 2 * math.pi * py / size)))


LIMITS = {"cover": COVER_LAT, "climate": CLIMATE_LAT, "mercator": (-MERCATOR_LAT, MERCATOR_LAT)}


def valid_lonlat(lon: Column, lat: Column, layer: str) -> Column:
    return lat.between(*LIMITS[layer]) & lon.between(-180, 180)


def geo_tile(lon: Column, lat: Column, step: int = 3) -> tuple[Column, Column]:
    return (F.floor(lat / step) * step).cast("bigint"), (F.floor(lon / step) * step).cast("bigint")


def tile_name(lat: Column, lon: Column) -> Column:
    """Like N30E084 or S03W060."""
    return F.format_string("%s%02d%s%03d", F.when(lat >= 0, "N").otherwise("S"), F.abs(lat), F.when(lon >= 0, "E").otherwise("W"), F.abs(lon))


def cache_name(z: Column, x: Column, y: Column, suffix: str = ".png") -> Column:
    """Path of a tile under a cache's root, like 7/81/44.png."""
    return F.concat(F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string")), F.lit(suffix))


def to_pixel(lon: Column, lat: Column, tie_lon: float, tie_lat: float, sx: float, sy: float, width: int, height: int) -> tuple[Column, Column]:
    """Pixel of a georeferenced raster, or null outside it."""
    px, py = F.floor((lon - tie_lon) / sx), F.floor((F.lit(tie_lat) - lat) / sy)
    ok = px.between(0, width - 1) & py.between(0, height - 1)
    return F.when(ok, px), F.when(ok, py)


def pixel_center(px: Column, py: Column, tie_lon: float, tie_lat: float, sx: float, sy: float) -> tuple[Column, Column]:
    return F.lit(tie_lon) + (px + 0.5) * sx, F.lit(tie_lat) - (py + 0.5) * sy


def downsample_step(scale: float, res: float) -> int:
    return min(MAX_STEP, max(1, int(scale / res // 4))) if scale / res > 4 else 1


def snap(v: Column, scale: float, res: float) -> Column:
    """Coordinate of the middle of the coarse cell that holds ``v``."""
    step = downsample_step(scale, res)
    return v.cast("double") if step == 1 else F.floor(F.floor(v) / step) * step + step * 0.5


def zoom_for_scale(scale: Column, low: int, high: int) -> Column:
    zoom = F.floor(F.log2(F.lit(CIRCUMFERENCE_M) / (TILE_PX * scale)) + 0.5)
    return F.least(F.lit(high), F.greatest(F.lit(low), zoom)).cast("bigint")


def bucket(v: Column, size: int) -> Column:
    return F.floor(v / size)


def pack_key(x: Column, z: Column) -> Column:
    return F.shiftleft(x.cast("bigint"), 32).bitwiseXOR(z.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def tile_local(px: Column, py: Column, tw: int, th: int, per_row: int) -> tuple[Column, Column]:
    """Tile index and offset in the tile of a pixel."""
    return F.floor(py / th) * per_row + F.floor(px / tw), F.pmod(px, F.lit(tw)) + F.pmod(py, F.lit(th)) * tw


def clean_requests(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows with finite coordinates, clamped to the globe."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    clamp = lambda c, m: F.least(F.lit(m), F.greatest(F.lit(-m), F.col(c)))
    return df.filter(finite(lat) & finite(lon)).withColumns({lat: clamp(lat, 90.0), lon: clamp(lon, 180.0)})


def hilbert_id(z: Column, x: Column, y: Column) -> Column:
    """Archive number of a tile: tiles of all lower zooms, then the place on the Hilbert curve. Null out of range."""
    z, x, y = z.cast("bigint"), x.cast("bigint"), y.cast("bigint")
    left = lambda c, n: F.call_function("shiftleft", c, n.cast("int"))
    one = F.lit(1).cast("bigint")
    side = left(one, z)
    start = F.struct(((left(one, 2 * z) - 1) / 3).cast("bigint").alias("acc"), x.alias("x"), y.alias("y"))

    def step(s: Column, a: Column) -> Column:
        side_a = left(one, a)
        rx, ry = side_a.bitwiseAND(s.x), side_a.bitwiseAND(s.y)
        turn = ry == 0
        flip = lambda v: F.when(rx != 0, side_a - 1 - v).otherwise(v)
        return F.struct((s.acc + left((3 * rx).bitwiseXOR(ry), a)).alias("acc"), F.when(turn, flip(s.y)).otherwise(s.x).alias("x"), F.when(turn, flip(s.x)).otherwise(s.y).alias("y"))

    steps = F.when(z > 0, F.sequence(z - 1, F.lit(0).cast("bigint"), F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    ok = z.between(0, 31) & x.between(0, side - 1) & y.between(0, side - 1)
    return F.when(ok, F.aggregate(steps, start, step, lambda s: s.acc))


def grid(spark: SparkSession, cx: int, cz: int, radius: int, n: int) -> DataFrame:
    """n x n regular sample positions around a centre, from one range."""
    i, j = F.col("id") % n, F.floor(F.col("id") / n)
    at = lambda k, c: F.lit(c - radius) + k * F.lit(2.0 * radius / (n - 1))
    return spark.range(n * n).select("id", at(i, cx).alias("x"), at(j, cz).alias("z"))
