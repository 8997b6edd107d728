"""Scalar functions on raster values and water columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.constants import CLIMATE_CODES, MANGROVE_COVER, NO_COVER, WATER_COVER
from geoloom.functions.hashing import seed_from_coords, signed, wrap32

WORLD_LOW, WORLD_HEIGHT, TOLERANCE, ALIGN = -2032, 4064, 50, 16
PEAK_M, TRENCH_M = 8848.0, -11034.0
#: Colours of the elevation ramp, 0xRRGGBB, own palette: value where a band ends, colour at that value.
LAND_RAMP = ((0.0, 0xD9CFA3), (120.0, 0x5E9A4B), (900.0, 0x8FA65A), (2200.0, 0xA8895A), (3800.0, 0x8A8178), (5200.0, 0xF2F4F5))
SEA_RAMP = ((0.0, 0x4FA3C7), (60.0, 0x2B6F9E), (2000.0, 0x123A63))
DEPTH_RAMP = ((0.0, 0xD9CFA3), (2.0, 0x4FA3C7), (12.0, 0x2B6F9E), (80.0, 0x123A63))
COVER_COLORS = {10: 0x2F6B34, 20: 0x9A9B4E, 30: 0x8DB360, 40: 0xC9B458, 50: 0x8C8C8C, 60: 0xCDB68A, 70: 0xF0F4F8, 80: 0x2B6F9E, 90: 0x5F8F78, 95: 0x3F7F5F, 100: 0xA7B08C}
ROCK = 0x7D7670
#: Climate tints by group 1 to 5, own palette.
CLIMATE_TINTS = {1: 0x3C9A5E, 2: 0xCBB07A, 3: 0x86AB6B, 4: 0x71848F, 5: 0xCDD8E0}
#: How far a cover takes its climate's tint, what polar climates add, and the most.
TINT_SHARES, POLAR, POLAR_MORE, TINT_MOST = {10: 0.35, 30: 0.35, 40: 0.35, 90: 0.35, 100: 0.35, 20: 0.25, 60: 0.15, 95: 0.2}, 5, 0.2, 0.65


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def terrarium_decode(r: Column, g: Column, b: Column) -> Column:
    return half_up(r * 256.0 + g + b / 256.0 - 32768.0)


def lerp(t: Column, a: Column, b: Column) -> Column:
    return a + t * (b - a)


def bilinear(u: Column, v: Column, v00: Column, v10: Column, v01: Column, v11: Column) -> Column:
    return lerp(v, lerp(u, v00, v10), lerp(u, v01, v11))


def surface_height(elev: Column, scale: float, land: float = 1.0, ocean: float = 1.0, offset: int = 0) -> Column:
    """Blocks above zero: away from zero on both sides of sea level, then moved by the offset."""
    scaled = F.when(elev >= 0, elev * land).otherwise(elev * ocean) / scale
    return F.when(elev >= 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("bigint") + offset


def height_limits(scale: Column, land: Column, ocean: Column, offset: Column, low: Column, high: Column) -> Column:
    """struct(min, height); null low or high means automatic. Overflow gives the full range."""
    top_y = WORLD_LOW + WORLD_HEIGHT - 1
    auto = lambda m, f, rnd, sign: F.when(scale <= 0, offset).otherwise(rnd(F.lit(m) * f / scale) + offset + sign * TOLERANCE).cast("bigint")
    auto_low, auto_high = auto(TRENCH_M, ocean, F.floor, -1), auto(PEAK_M, land, F.ceil, 1)
    a, b = F.coalesce(low.cast("bigint"), auto_low), F.coalesce(high.cast("bigint"), auto_high)
    clamp = lambda c: F.least(F.lit(top_y), F.greatest(F.lit(WORLD_LOW), c)).cast("bigint")
    first, last = clamp(F.least(a, b)), clamp(F.greatest(a, b))
    bottom = first - F.pmod(first, F.lit(ALIGN))
    top = last + 1 + F.pmod(-(last + 1), F.lit(ALIGN))
    whole = (low.isNull() & (auto_low < WORLD_LOW)) | (high.isNull() & (auto_high > top_y)) | (bottom < WORLD_LOW) | (top - 1 > top_y)
    return F.struct(F.when(whole, F.lit(WORLD_LOW)).otherwise(bottom).cast("bigint").alias("min"), F.when(whole, F.lit(WORLD_HEIGHT)).otherwise(top - bottom).cast("bigint").alias("height"))


def meters_to_cells(m: Column, scale: float) -> Column:
    return F.greatest(F.lit(1), half_up(m / max(1e-4, scale))).cast("bigint")


def inland_depth(dist: Column, x: Column, z: Column) -> Column:
    jitter = 3 + F.pmod(seed_from_coords(x, 5, z), F.lit(4)) + F.floor(F.greatest(F.lit(0.0), dist - 10) / 6)
    return F.when(dist <= 5, 1).when(dist <= 8, 3).when(dist <= 10, 4).otherwise(F.least(F.lit(30), jitter)).cast("bigint")


def quick_water(cover: Column, h: Column, sea: int = 0, depth: int = 25) -> Column:
    """struct(has_water, is_ocean, terrain, water): a one-pass estimate."""
    ocean = (cover == NO_COVER) & (h <= sea)
    wet = cover.isin(WATER_COVER, MANGROVE_COVER) | ocean
    level = F.greatest(h + 1, F.lit(sea))
    return F.struct(wet.alias("has_water"), ocean.alias("is_ocean"), F.when(wet & ~ocean, F.least(h, level - depth)).otherwise(h).cast("bigint").alias("terrain"), F.when(wet, level).otherwise(h).cast("bigint").alias("water"))


def climate_group(code: Column) -> Column:
    first = F.upper(F.substring(code, 1, 1))
    return F.coalesce(F.when(first.isin(*"ABCDE"), F.ascii(first) - 64), F.lit(0)).cast("bigint")


def climate_code(i: Column) -> Column:
    return F.when(i.between(1, len(CLIMATE_CODES)), F.try_element_at(F.array(*map(F.lit, CLIMATE_CODES)), F.greatest(i, F.lit(1)).cast("int")))


def lerp_color(t: Column, a: Column | int, b: Column | int) -> Column:
    a, b = (F.lit(c) if isinstance(c, int) else c for c in (a, b))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    part = lambda c, s: F.shiftright(c.cast("bigint"), s).bitwiseAND(F.lit(255))
    mixed = [F.shiftleft(half_up(part(a, s) + (part(b, s) - part(a, s)) * t).cast("bigint"), s) for s in (16, 8, 0)]
    return mixed[0].bitwiseOR(mixed[1]).bitwiseOR(mixed[2])


def ramp(v: Column, stops: tuple[tuple[float, int], ...]) -> Column:
    out = F
    for (a, ca), (b, cb) in zip(stops, stops[1:], strict=False):
        out = out.when(v < b, lerp_color((v - a) / (b - a), ca, cb))
    return out.otherwise(F.lit(stops[-1][1]).cast("bigint"))


def ramp_color(elev: Column) -> Column:
    return F.when(elev < 0, ramp(-elev, SEA_RAMP)).otherwise(ramp(elev, LAND_RAMP))


def depth_color(depth: Column) -> Column:
    return ramp(depth, DEPTH_RAMP)


def cover_color(cover: Column) -> Column:
    return reduce(lambda e, x: e.when(cover == x[0], F.lit(x[1])), COVER_COLORS.items(), F).otherwise(F.lit(ROCK)).cast("bigint")


def climate_tint(color: Column, group: Column, cover: Column) -> Column:
    """The colour moved towards its climate group's tint; unknown groups and covers without a share keep it."""
    share = reduce(lambda e, x: e.when(cover == x[0], F.lit(x[1])), TINT_SHARES.items(), F).otherwise(F.lit(0.0))
    tint = reduce(lambda e, x: e.when(group == x[0], F.lit(x[1])), CLIMATE_TINTS.items(), F)
    share = F.when((group == POLAR) & (share > 0), F.least(F.lit(TINT_MOST), share + POLAR_MORE)).otherwise(share)
    return F.when((share > 0) & tint.isNotNull(), lerp_color(share, color, tint)).otherwise(color).cast("bigint")


def rock_tint(color: Column, slope: Column) -> Column:
    return lerp_color((slope - 1.2) / 1.6, color, ROCK)


def hillshade(dx: Column, dz: Column) -> Column:
    """Brightness of a slope under a fixed light, quantised to eighths."""
    n = F.sqrt(dx * dx + dz * dz + 1.0)
    light = (0.16 + 0.64 + 0.16) ** 0.5
    dot = (dx * 0.4 + 0.8 + dz * 0.4) / n / light
    return half_up((0.45 + 0.55 * F.greatest(F.lit(0.0), dot)) * 8) / 8


#: Fixed value: the salt of the bands' seed.
BAND_SALT = 0x2E2B9E9B4A7C15


def strata_band(y: Column, x: Column, z: Column) -> Column:
    cell = lambda v: F.floor(v / 32)
    seed = seed_from_coords(cell(x), 2, cell(z)).bitwiseXOR(F.lit(signed(BAND_SALT, 64)))
    offset = F.pmod(wrap32(seed.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(21))
    return F.pmod(F.floor((y + offset) / 3), F.lit(7)).cast("bigint")


def water_table(surface: Column, water: Column, sea: int, low: int) -> Column:
    level = F.when(water > surface, F.greatest(F.lit(sea), water - 4)).otherwise(F.lit(sea))
    return F.greatest(F.lit(low + 8), F.when(surface > sea + 4, F.least(level, surface - 12)).otherwise(level)).cast("bigint")


def canyon_depth(v: Column) -> Column:
    return F.when(v > 0.72, half_up(lerp((v - 0.72) / 0.28, F.lit(28.0), F.lit(80.0)))).otherwise(0).cast("bigint")


def lod_stride(level: Column, start: int, points: int) -> Column:
    stride = F.when(level < start, 1).when(level == start, 2).otherwise(4)
    return F.least(stride, F.lit(points)).cast("bigint")


def namespaced_id(c: Column, namespace: str) -> Column:
    return F.when(F.contains(c, F.lit(":")), c).otherwise(F.concat(F.lit(namespace + ":"), c))


def upper_trim(c: Column) -> Column:
    return F.upper(F.trim(c))


def join_url(base: Column, path: Column) -> Column:
    return F.concat(F.when(F.endswith(base, F.lit("/")), base).otherwise(F.concat(base, F.lit("/"))), path)


def base_height(on_surface: Column, terrain: Column, water: Column) -> Column:
    return F.when(on_surface, F.greatest(terrain, water)).otherwise(terrain) + 1


def even_samples(low: Column, high: Column, k: Column) -> Column:
    """k evenly spaced whole positions from low to high, k held in 2 to 5."""
    k = F.least(F.lit(5), F.greatest(F.lit(2), k)).cast("bigint")
    return F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), lambda i: F.floor(low + (high - low) * i / (k - 1).cast("double") + 0.5))


def pack_flags(flags: list[Column]) -> Column:
    """Ten booleans as bits, the last two in swapped order."""
    places = [0, 1, 2, 3, 4, 5, 6, 7, 9, 8]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(f.cast("int"), p) for f, p in zip(flags, places, strict=True)]).cast("bigint")


def column_heights(cover: Column, terrain: Column, water: Column, draw: Column, sea: int, low: int, high: int) -> Column:
    """struct(terrain, water): clamped; wetland has its own level, dry cells take water = terrain."""
    clamp = lambda c: F.least(F.lit(high), F.greatest(F.lit(low), c)).cast("bigint")
    t, own = clamp(terrain), clamp(F.lit(sea) - (1 + draw))
    level = F.when(cover == MANGROVE_COVER, F.when(own > t, own).otherwise(t)).when(cover == WATER_COVER, F.greatest(clamp(water), t)).otherwise(t)
    return F.struct(t.alias("terrain"), level.cast("bigint").alias("water"))


def surface_class(cover: Column, slope: Column, wet: Column) -> Column:
    """Material of the top of a column; steep soil is rock unless under trees or water."""
    soil = F.when(cover == 60, "sand").when(cover == 70, "snow").when(cover.isin(90, 95), "mud").when(cover == 100, "moss").otherwise("soil")
    return F.when(wet, F.when(cover == NO_COVER, "gravel").otherwise("silt")).when((slope >= 3) & (cover != 10), "rock").otherwise(soil)


def water_flags(cover: Column, land: Column, surface: Column, sea: int = 0) -> Column:
    """struct(ocean, water): a known mask decides the ocean, else missing cover does."""
    ocean = F.when(land.isNotNull(), (land == 0) & cover.isin(NO_COVER, WATER_COVER)).otherwise(cover == NO_COVER)
    return F.struct(ocean.alias("ocean"), ((cover == WATER_COVER) | (ocean & (surface <= sea))).alias("water"))


def ocean_source_flag(land: Column, cover: Column) -> Column:
    """Whether a point takes its elevation from the ocean level: mask unknown or no land with no cover."""
    return F.when(land.isNull(), F.lit(True)).when(land == 1, F.lit(False)).otherwise(cover == NO_COVER)


def water_floor(h: Column, level: Column, ocean: Column, cliff: Column, depth: Column) -> Column:
    return F.when(ocean | cliff, F.least(h, level - 1)).otherwise(level - F.greatest(depth, F.lit(1))).cast("bigint")


def shore_blend(cost: Column, water: Column, base: Column, dist: int) -> Column:
    """Land near water lowered towards the water; never raised."""
    mixed = half_up(lerp(cost / 10.0 / dist, water.cast("double"), base.cast("double")))
    return F.when((cost <= dist * 10) & (mixed < base), mixed).otherwise(base).cast("bigint")


def river_surface(spill: Column, max_h: Column) -> Column:
    return F.least(spill, max_h)
