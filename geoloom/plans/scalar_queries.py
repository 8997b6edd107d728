"""Queries of projections, scalar functions and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import hashing as h
from geoloom.functions import project as p
from geoloom.functions import scalar as s
from geoloom.plans.fixtures import fixture, oracle
from geoloom.plans.registry import query

C = F.col
PER_DEGREE = "(40075017.0::double/360.0::double/35.0::double)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "cells")


def points(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "points")


def simple(name: str, source: str, columns, sql: str, where=None) -> None:
    """A query that selects ``columns()`` from one fixture, and its oracle select list."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = fixture(spark, d, source)
        return (df.filter(where()) if where else df).select(*columns())

    query(name, oracle(sql, source))(run)


def named(columns: tuple, *names: str) -> list:
    return [c.alias(n) for c, n in zip(columns, names, strict=True)]


def big(c, name: str):
    return c.cast("bigint").alias(name)


simple("block_to_lonlat", "cells", lambda: ["x", "y", *[F.round(c, 9).alias(n) for c, n in zip(p.block_to_lonlat(C("x"), C("y"), 35.0), ("lon", "lat"), strict=True)]],
       f"select x, y, round(x/{PER_DEGREE}, 9) as lon, round(-y/{PER_DEGREE}, 9) as lat from cells")
simple("lonlat_to_block", "points", lambda: ["point_id", *named(p.lonlat_to_block(C("lon"), C("lat"), 35.0), "bx", "bz")],
       f"select point_id, floor(lon*{PER_DEGREE})::bigint as bx, floor(-lat*{PER_DEGREE})::bigint as bz from points")
MERCATOR = "(lon+180)/360*4096 as fx, (1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*4096 as fy"
simple("mercator_tile", "points", lambda: ["point_id", *named(p.mercator_tile(C("lon"), C("lat"), 12), "tx", "ty")],
       f"""+ f as (select *, {MERCATOR} from points) select point_id, case when abs(lat) <= 85.05112878 and abs(lon) <= 180 and fx >= 0 and fx < 4096 and fy >= 0 and fy < 4096 then floor(fx)::bigint end as tx,
       case when abs(lat) <= 85.05112878 and abs(lon) <= 180 and fx >= 0 and fx < 4096 and fy >= 0 and fy < 4096 then floor(fy)::bigint end as ty from f""")  # fmt: skip
simple("mercator_unproject", "cells", lambda: ["x", "y", *[F.round(c, 6).alias(n) for c, n in zip(p.pixel_to_lonlat(C("x"), C("y"), 3), ("lon", "lat"), strict=True)]],
       "select x, y, round(x/2048.0::double*360-180, 6) as lon, round(degrees(atan(sinh(pi()-2*pi()*y/2048.0::double))), 6) as lat from cells")
simple("bbox_filter", "points", lambda: ["point_id", p.valid_lonlat(C("lon"), C("lat"), "climate").alias("in_climate"), p.valid_lonlat(C("lon"), C("lat"), "mercator").alias("in_mercator")],
       "select point_id, lat between -90 and 90 and lon between -180 and 180 as in_climate, lat between -85.05112878 and 85.05112878 and lon between -180 and 180 as in_mercator from points where lat between -60 and 84 and lon between -180 and 180",
       lambda: p.valid_lonlat(C("lon"), C("lat"), "cover"))
GEO = "cast(floor(lat/3)*3 as bigint) as tlat, cast(floor(lon/3)*3 as bigint) as tlon"
simple("geo_tile_key", "points", lambda: ["point_id", *named(p.geo_tile(C("lon"), C("lat")), "tlat", "tlon")], f"select point_id, {GEO} from points")
simple("tile_name", "points", lambda: ["point_id", p.tile_name(*p.geo_tile(C("lon"), C("lat"))).alias("name"), s.join_url(F.when(C("point_id") % 2 == 0, "tiles/").otherwise("tiles"), p.tile_name(*p.geo_tile(C("lon"), C("lat")))).alias("path")],
       f"+ g as (select point_id, {GEO} from points), n as (select point_id, (case when tlat >= 0 then 'N' else 'S' end) || lpad(abs(tlat)::varchar, 2, '0') || (case when tlon >= 0 then 'E' else 'W' end) || lpad(abs(tlon)::varchar, 3, '0') as name from g) select point_id, name, 'tiles/' || name as path from n")
PIX = "floor((lon+180)/0.25::double)::bigint as px, floor((84-lat)/0.25::double)::bigint as py"
simple("affine_pixel", "points", lambda: ["point_id", *(px := named(p.to_pixel(C("lon"), C("lat"), -180.0, 84.0, 0.25, 0.25, 1440, 576), "px", "py")), *[F.round(c, 6).alias(n) for c, n in zip(p.pixel_center(*p.to_pixel(C("lon"), C("lat"), -180.0, 84.0, 0.25, 0.25, 1440, 576), -180.0, 84.0, 0.25, 0.25), ("clon", "clat"), strict=True)]],
       f"+ q as (select point_id, {PIX} from points), o as (select point_id, case when px between 0 and 1439 and py between 0 and 575 then px end as px, case when px between 0 and 1439 and py between 0 and 575 then py end as py from q) select *, round(-180+(px+0.5)*0.25::double, 6) as clon, round(84-(py+0.5)*0.25::double, 6) as clat from o")
simple("snap_downsample", "cells", lambda: ["x", "y", p.snap(C("x"), 500.0, 30.0).alias("sx"), p.snap(C("y"), 500.0, 10.0).alias("sy"), p.snap(C("x"), 35.0, 30.0).alias("same")],
       "select x, y, floor(x/4)*4+2.0::double as sx, floor(y/12)*12+6.0::double as sy, x::double as same from cells")
simple("zoom_for_scale", "points", lambda: ["point_id", p.zoom_for_scale((C("point_id") + 1).cast("double"), 0, 15).alias("zoom")],
       "select point_id, least(15, greatest(0, floor(log2(40075017.0::double/(256*(point_id+1)::double))+0.5)))::bigint as zoom from points")
simple("grid_bucket", "cells", lambda: ["x", "y", p.bucket(C("x") - 64, 16).alias("chunk"), p.bucket(C("y") - 64, 64).alias("region"), p.pack_key(C("x") - 64, C("y") - 64).alias("key")],
       "select x, y, floor((x-64)/16.0::double)::bigint as chunk, floor((y-64)/64.0::double)::bigint as region, case when y-64 < 0 then (x-64)*4294967296 + (y-64) + 4294967296 else (x-64)*4294967296 + (y-64) end as key from cells")
simple("local_pixel", "cells", lambda: ["x", "y", *named(p.tile_local(C("x"), C("y"), 16, 8, 8), "tile", "local")],
       "select x, y, (y//8)*8 + x//16 as tile, x%16 + (y%8)*16 as local from cells")


@query("clean_requests", oracle("select event_id, user_id, least(90.0, greatest(-90.0, lat))::double as lat, least(180.0, greatest(-180.0, lon))::double as lon from reqs where not isnan(lat) and not isnan(lon) and not isinf(lat) and not isinf(lon)", "reqs"))
def clean_requests(spark: SparkSession, d: str) -> DataFrame:
    return p.clean_requests(fixture(spark, d, "reqs")).select("event_id", "user_id", "lat", "lon")


simple("water_predicate", "cells", lambda: ["x", "y", s.water_flags(C("cover"), C("land"), C("elev_m")).ocean.alias("ocean"), s.water_flags(C("cover"), C("land"), C("elev_m")).water.alias("water")],
       "+ o as (select *, case when land is not null then land = 0 and cover in (0, 80) else cover = 0 end as ocean from cells) select x, y, ocean, cover = 80 or (ocean and elev_m <= 0) as water from o")
simple("ocean_source_flag", "cells", lambda: ["x", "y", s.ocean_source_flag(C("land"), C("cover")).alias("flag")],
       "select x, y, case when land is null then true when land = 1 then false else cover = 0 end as flag from cells")
simple("hilbert_tile_id", "cells", lambda: ["x", "y", p.hilbert_id(F.lit(7), C("x"), C("y")).alias("id"), p.hilbert_id(F.lit(12), C("x") * 17, C("y")).alias("id12")],
       """+ w as (select x, y, 6 as a, 5461::bigint as acc, x as hx, y as hy from cells where y < 128 union all
       select x, y, a-1, acc + (xor(3*(hx & (1::bigint << a)), hy & (1::bigint << a)) << a), case when hy & (1::bigint << a) = 0 then case when hx & (1::bigint << a) <> 0 then (1::bigint << a)-1-hy else hy end else hx end,
        case when hy & (1::bigint << a) = 0 then case when hx & (1::bigint << a) <> 0 then (1::bigint << a)-1-hx else hx end else hy end from w where a >= 0),
       v as (select x, y, 11 as a, 5592405::bigint as acc, x*17 as hx, y as hy from cells where y < 4096 union all
       select x, y, a-1, acc + (xor(3*(hx & (1::bigint << a)), hy & (1::bigint << a)) << a), case when hy & (1::bigint << a) = 0 then case when hx & (1::bigint << a) <> 0 then (1::bigint << a)-1-hy else hy end else hx end,
        case when hy & (1::bigint << a) = 0 then case when hx & (1::bigint << a) <> 0 then (1::bigint << a)-1-hx else hx end else hy end from v where a >= 0)
       select c.x, c.y, w.acc as id, v.acc as id12 from cells c left join w on c.x = w.x and c.y = w.y and w.a = -1 left join v on c.x = v.x and c.y = v.y and v.a = -1""")  # fmt: skip


@query("make_grid", oracle("+ m as (select least(385, greatest(2, floor(sqrt(count(*)))))::bigint as k, (min(x) + max(x)) // 2 as cx, (min(y) + max(y)) // 2 as cz, greatest(max(x) - min(x), max(y) - min(y)) // 2 + 1 as r from cells), g as (select m.*, unnest(range(k*k)) as id from m) select id, round(cx-r + (id%k)*(2.0::double*r/(k-1)), 6) as x, round(cz-r + (id//k)*(2.0::double*r/(k-1)), 6) as z from g", "cells"))
def make_grid(spark: SparkSession, d: str) -> DataFrame:
    """A grid over the box of the cells."""
    n, x0, x1, y0, y1 = cells(spark, d).agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n = max(2, min(385, int(n**0.5)))
    return p.grid(spark, (x0 + x1) // 2, (y0 + y1) // 2, max(x1 - x0, y1 - y0) // 2 + 1, n).select("id", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


simple("terrarium_decode", "cells", lambda: ["x", "y", s.terrarium_decode(C("x") + 64, C("y") % 256, C("elev_m") + 100).alias("m")],
       "select x, y, floor((x+64)*256.0::double + y%256 + (elev_m+100)/256.0::double - 32768 + 0.5)::bigint as m from cells")
simple("bilinear", "cells", lambda: ["x", "y", F.round(s.bilinear(C("x") / 128.0, C("y") % 10 / 10.0, C("elev_m"), C("cover"), C("koppen"), C("x")), 12).alias("v")],
       "+ t as (select *, x/128.0::double as u, (y%10)/10.0::double as w from cells), l as (select *, elev_m+u*(cover-elev_m) as a, koppen+u*(x-koppen) as b from t) select x, y, round(a+w*(b-a), 12) as v from l")
simple("surface_height", "cells", lambda: ["x", "y", s.surface_height(C("elev_m").cast("double"), 7.0, 1.5, 2.0, 63).alias("h")],
       "select x, y, 63 + case when elev_m >= 0 then ceil(elev_m*1.5::double/7)::bigint else floor(elev_m*2.0::double/7)::bigint end as h from cells")
LIMIT_ARGS = "5.0::double + point_id % 60 as scale, (point_id % 7) * 10 as off, case when point_id % 3 = 0 then null else point_id % 900 - 450 end as lo, case when point_id % 4 = 0 then null else point_id % 1100 - 100 end as hi"
simple("height_limits", "points", lambda: ["point_id", big(s.height_limits(5.0 + C("point_id") % 60, F.lit(1.0), F.lit(1.0), C("point_id") % 7 * 10, F.when(C("point_id") % 3 != 0, C("point_id") % 900 - 450), F.when(C("point_id") % 4 != 0, C("point_id") % 1100 - 100))["min"], "low"), big(s.height_limits(5.0 + C("point_id") % 60, F.lit(1.0), F.lit(1.0), C("point_id") % 7 * 10, F.when(C("point_id") % 3 != 0, C("point_id") % 900 - 450), F.when(C("point_id") % 4 != 0, C("point_id") % 1100 - 100))["height"], "height")],
       f"""+ a as (select point_id, {LIMIT_ARGS} from points), b as (select *, floor(-11034/scale)::bigint + off - 50 as alo, ceil(8848/scale)::bigint + off + 50 as ahi from a),
       c as (select *, coalesce(lo, alo) as l0, coalesce(hi, ahi) as h0 from b), e as (select *, greatest(-2032, least(2031, least(l0, h0))) as l1, greatest(-2032, least(2031, greatest(l0, h0))) as h1 from c),
       f as (select *, floor(l1/16.0)::bigint*16 as bottom, ceil((h1+1)/16.0)::bigint*16 as top from e), g as (select *, (lo is null and alo < -2032) or (hi is null and ahi > 2031) or bottom < -2032 or top - 1 > 2031 as whole from f)
       select point_id, case when whole then -2032 else bottom end::bigint as low, case when whole then 4064 else top - bottom end::bigint as height from g""")  # fmt: skip
simple("meters_to_cells", "cells", lambda: ["x", "y", s.meters_to_cells(C("x").cast("double"), 7.0).alias("n")], "select x, y, greatest(1, floor(x::double/7+0.5))::bigint as n from cells")


def wrap(v: str) -> str:
    """DuckDB text for the low 64 bits, signed, of a hugeint."""
    return f"(((({v}) % 18446744073709551616 + 18446744073709551616 + 9223372036854775808) % 18446744073709551616) - 9223372036854775808)::bigint"


def seed_sql(source: str, y: int, keep: str) -> str:
    """CTE body: ``keep`` and seed, from columns sx and sz of ``source``."""
    a = f"(select *, xor(xor(((sx*3129871 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, sz*116129781), {y}) as s0 from {source})"
    b = f"(select *, {wrap('s0::hugeint*s0::hugeint')} as s1 from {a})"
    return f"select {keep}, ({wrap('(' + wrap('s1::hugeint*42317861') + ')::hugeint + (' + wrap('s0::hugeint*11') + ')::hugeint')}) >> 16 as seed from {b}"


simple("seed_from_coords", "cells", lambda: ["x", "y", h.seed_from_coords(C("x") * 999 - 60000, 5, C("y") * 77 - 5000).alias("seed")],
       f"+ q as (select x, y, x*999-60000 as sx, y*77-5000 as sz from cells) {seed_sql('q', 5, 'x, y')}")
simple("inland_depth", "cells", lambda: ["x", "y", s.inland_depth(C("x") / 2.0, C("x"), C("y")).alias("depth")],
       f"+ q as (select x, y, x as sx, y as sz from cells), s as ({seed_sql('q', 5, 'x, y')}) select x, y, case when x/2.0 <= 5 then 1 when x/2.0 <= 8 then 3 when x/2.0 <= 10 then 4 else least(30, 3 + (seed%4+4)%4 + floor(greatest(0, x/2.0-10)/6)) end::bigint as depth from s")
simple("quick_water", "cells", lambda: ["x", "y", *[s.quick_water(C("cover"), C("elev_m"))[n].alias(n) for n in ("has_water", "is_ocean", "terrain", "water")]],
       "+ q as (select *, cover = 0 and elev_m <= 0 as is_ocean, greatest(elev_m+1, 0) as lv from cells), r as (select *, cover in (80, 95) or is_ocean as has_water from q) select x, y, has_water, is_ocean, case when has_water and not is_ocean then least(elev_m, lv-25) else elev_m end::bigint as terrain, case when has_water then lv else elev_m end::bigint as water from r")
CODES = "['Af','Am','Aw','BWh','BWk','BSh','BSk','Csa','Csb','Csc','Cwa','Cwb','Cwc','Cfa','Cfb','Cfc','Dsa','Dsb','Dsc','Dsd','Dwa','Dwb','Dwc','Dwd','Dfa','Dfb','Dfc','Dfd','ET','EF']"
simple("climate_code", "cells", lambda: ["x", "y", s.climate_code(C("koppen")).alias("code"), s.climate_group(s.climate_code(C("koppen"))).alias("grp")],
       f"+ k as (select x, y, case when koppen between 1 and 30 then {CODES}[koppen] end as code from cells) select x, y, code, coalesce(ascii(code) - 64, 0)::bigint as grp from k")
simple("namespaced_id", "points", lambda: ["point_id", s.namespaced_id(F.when(C("point_id") % 2 == 0, F.concat(F.lit("own:"), C("segment"))).otherwise(C("segment")), "base").alias("id"), s.upper_trim(F.concat(F.lit("  "), F.lower("segment"), F.lit(" "))).alias("key")],
       "select point_id, case when point_id % 2 = 0 then 'own:' else 'base:' end || segment as id, upper(segment) as key from points")


def ramp_sql(v: str, stops) -> str:
    part = lambda c, k: (c >> k) & 255
    one = lambda a, ca, b, cb: " + ".join(f"floor({part(ca, k)} + ({part(cb, k) - part(ca, k)})*(({v})-({a})::double)/({b - a})::double + 0.5)::bigint*{1 << k}" for k in (16, 8, 0))
    return "case " + " ".join(f"when {v} < {b} then {one(a, ca, b, cb)}" for (a, ca), (b, cb) in zip(stops, stops[1:], strict=False)) + f" else {stops[-1][1]} end"


simple("ramp_color", "cells", lambda: ["x", "y", s.ramp_color(C("elev_m") * 40.0).alias("color"), s.depth_color(C("x") * 1.0).alias("depth_color")],
       f"+ e as (select x, y, elev_m*40.0::double as v, -elev_m*40.0::double as m, x*1.0::double as w from cells) select x, y, (case when v < 0 then {ramp_sql('m', s.SEA_RAMP)} else {ramp_sql('v', s.LAND_RAMP)} end)::bigint as color, ({ramp_sql('w', s.DEPTH_RAMP)})::bigint as depth_color from e")
simple("cover_color", "cells", lambda: ["x", "y", s.cover_color(C("cover")).alias("color"), s.rock_tint(s.cover_color(C("cover")), C("x") / 40.0).alias("tinted")],
       "+ c as (select x, y, x/40.0::double as slope, case cover " + " ".join(f"when {k} then {v}" for k, v in s.COVER_COLORS.items()) + f" else {s.ROCK} end as color from cells), t as (select *, least(1, greatest(0, (slope-1.2)/1.6)) as t from c) select x, y, color::bigint as color, (" + " + ".join(f"floor(((color >> {k}) & 255) + ({(s.ROCK >> k) & 255} - ((color >> {k}) & 255))*t + 0.5)::bigint*{1 << k}" for k in (16, 8, 0)) + ")::bigint as tinted from t")
TINT_SQL = " ".join(f"when {k} then {v}" for k, v in s.CLIMATE_TINTS.items())
SHARE_SQL = "case cover " + " ".join(f"when {k} then {v}::double" for k, v in s.TINT_SHARES.items()) + " else 0.0::double end"
simple("climate_tint", "cells", lambda: ["x", "y", s.climate_tint(s.cover_color(C("cover")), C("x") % 7, C("cover")).alias("color")],
       "+ c as (select x, y, case cover " + " ".join(f"when {k} then {v}" for k, v in s.COVER_COLORS.items()) + f" else {s.ROCK} end as base, case x % 7 {TINT_SQL} end as tint, {SHARE_SQL} as share, x % 7 = {s.POLAR} as polar from cells), t as (select *, case when polar and share > 0 then least({s.TINT_MOST}::double, share + {s.POLAR_MORE}::double) else share end as t from c) select x, y, (case when t > 0 and tint is not null then " + " + ".join(f"floor(((base >> {k}) & 255) + (((tint >> {k}) & 255) - ((base >> {k}) & 255))*t + 0.5)::bigint*{1 << k}" for k in (16, 8, 0)) + " else base end)::bigint as color from t")
simple("cache_name", "points", lambda: ["point_id", p.cache_name(C("point_id") % 12, C("x"), C("y")).alias("path")],
       "select point_id, (point_id % 12)::varchar || '/' || x::varchar || '/' || y::varchar || '.png' as path from points")
simple("hillshade", "cells", lambda: ["x", "y", s.hillshade(C("elev_m") / 11.0, C("x") / 50.0).alias("shade")],
       "+ d as (select x, y, elev_m/11.0::double as dx, x/50.0::double as dz from cells) select x, y, floor((0.45+0.55*greatest(0, (dx*0.4+0.8+dz*0.4)/sqrt(dx*dx+dz*dz+1)/sqrt(0.96)))*8+0.5)/8 as shade from d")
simple("surface_class", "cells", lambda: ["x", "y", s.surface_class(C("cover"), C("elev_m") % 6, C("cover").isin(0, 80)).alias("material")],
       "select x, y, case when cover in (0, 80) then case when cover = 0 then 'gravel' else 'silt' end when elev_m % 6 >= 3 and cover <> 10 then 'rock' when cover = 60 then 'sand' when cover = 70 then 'snow' when cover in (90, 95) then 'mud' when cover = 100 then 'moss' else 'soil' end as material from cells")
simple("strata_band", "cells", lambda: ["x", "y", s.strata_band(C("elev_m"), C("x") * 9, C("y") * 9).alias("band")],
       f"+ q as (select x, y, elev_m, (x*9)//32 as sx, (y*9)//32 as sz from cells), s as ({seed_sql('q', 2, 'x, y, elev_m')}), o as (select x, y, elev_m, ((xor(seed, {0x2E2B9E9B4A7C15}) & 4294967295) + 2147483648) % 4294967296 - 2147483648 as i from s), p as (select x, y, elev_m + (i % 21 + 21) % 21 as v from o) select x, y, ((floor(v/3.0)::bigint) % 7 + 7) % 7 as band from p")
simple("water_table", "cells", lambda: ["x", "y", s.water_table(C("elev_m"), F.when(C("cover") == 80, C("elev_m") + 3).otherwise(C("elev_m")), 0, -64).alias("level"), s.canyon_depth(C("x") / 128.0).alias("canyon")],
       "+ t as (select *, case when cover = 80 then greatest(0, elev_m+3-4) else 0 end as lv from cells) select x, y, greatest(-56, case when elev_m > 4 then least(lv, elev_m-12) else lv end)::bigint as level, case when x/128.0::double > 0.72 then floor(28+(x/128.0::double-0.72)/0.28*52+0.5)::bigint else 0 end as canyon from t")
simple("lod_stride", "points", lambda: ["point_id", s.lod_stride(C("point_id") % 8, 3, 64).alias("stride"), s.lod_stride(C("point_id") % 8, 3, 3).alias("capped")],
       "+ t as (select point_id, case when point_id % 8 < 3 then 1 when point_id % 8 = 3 then 2 else 4 end as v from points) select point_id, v::bigint as stride, least(v, 3)::bigint as capped from t")
simple("column_heights", "cells", lambda: ["x", "y", *[s.column_heights(C("cover"), C("elev_m"), C("elev_m") + 2, C("x") % 3, 0, -20, 40)[n].alias(n) for n in ("terrain", "water")], s.base_height(C("cover") == 80, C("elev_m"), C("elev_m") + 2).alias("base")],
       "+ t as (select *, least(40, greatest(-20, elev_m)) as t, -(1 + x%3) as own, least(40, greatest(-20, elev_m+2)) as w from cells) select x, y, t as terrain, case when cover = 95 then greatest(own, t) when cover = 80 then greatest(w, t) else t end as water, case when cover = 80 then elev_m + 3 else elev_m + 1 end as base from t")
simple("even_samples", "points", lambda: ["point_id", F.array_join(s.even_samples(C("point_id") % 50, C("point_id") % 50 + 63, C("point_id") % 9), ",").alias("at")],
       "+ k as (select point_id, point_id % 50 as lo, least(5, greatest(2, point_id % 9)) as k from points) select point_id, array_to_string(list_transform(range(k), lambda i: floor(lo + 63.0::double*i/(k-1) + 0.5)::bigint), ',') as at from k")
simple("pack_flags", "points", lambda: ["point_id", s.pack_flags([F.pmod(F.floor(C("point_id") / 2**i), F.lit(2)) == 1 for i in range(10)]).alias("flags")],
       "select point_id, (point_id & 255) + ((point_id >> 8) & 1) * 512 + ((point_id >> 9) & 1) * 256 as flags from points")
simple("river_surface", "cells", lambda: ["x", "y", s.river_surface(C("elev_m"), C("x") % 9).alias("level"), s.water_floor(C("elev_m"), C("elev_m") + C("x") % 5, C("cover") == 0, C("y") % 7 == 0, C("x") % 4).alias("floor"), s.shore_blend(C("x") * 3, C("elev_m") - 10, C("elev_m"), 20).alias("blend")],
       "+ b as (select *, floor((elev_m-10) + x*3/10.0::double/20*10 + 0.5)::bigint as m from cells) select x, y, least(elev_m, x%9) as level, case when cover = 0 or y%7 = 0 then least(elev_m, elev_m + x%5 - 1) else elev_m + x%5 - greatest(x%4, 1) end as floor, case when x*3 <= 200 and m < elev_m then m else elev_m end as blend from b")


def mulu(a: str, b: int) -> str:
    return f"((({a})::uhugeint * {b}::uhugeint) % 18446744073709551616::uhugeint)::ubigint"


def u64(v: str) -> str:
    """DuckDB text: a signed 64-bit value as ubigint."""
    return f"((({v})::hugeint + 18446744073709551616) % 18446744073709551616)::ubigint"


def mix_sql(source: str, keep: str) -> str:
    """CTE body: ``keep`` and m (ubigint), from column v (ubigint)."""
    a = f"(select *, {mulu('xor(v, v >> 33)', h.MIX64_1)} as m1 from {source})"
    b = f"(select *, {mulu('xor(m1, m1 >> 33)', h.MIX64_2)} as m2 from {a})"
    return f"select {keep}, xor(m2, m2 >> 33) as m from {b}"


def unit_sql(x: str, z: str, seed: int, source: str, keep: str) -> str:
    v = f"xor(xor({seed}::ubigint, {mulu(u64(x), h.UNIT_X)}), {mulu(u64(z), h.UNIT_Z)})"
    return mix_sql(f"(select *, {v} as v from {source})", keep)


simple("mix64", "cells", lambda: ["x", "y", h.mix64(C("x") * 1000003 + C("y")).alias("m"), F.round(h.hash_unit(C("x") - 64, C("y") - 9, h.WARP_SEED_X), 12).alias("unit")],
       f"+ q as (select x, y, (x*1000003 + y)::ubigint as v from cells), a as ({mix_sql('q', 'x, y')}), r as (select x, y from cells), b as ({unit_sql('(x-64)', '(y-9)', h.WARP_SEED_X, 'r', 'x, y')}) select a.x, a.y, {wrap('a.m::hugeint')} as m, round((b.m >> 11)::double / 9007199254740992.0::double, 12) as unit from a join b on a.x = b.x and a.y = b.y")


def noise_sql(seed: int, fx: str, fz: str, tag: str = "") -> str:
    """CTEs from cells to n{tag}: x, y and the noise at (fx, fz)."""
    corner = lambda i, j: f"(select x, y, (m >> 11)::double / 9007199254740992.0::double as u from ({unit_sql(f'(x0+{i})', f'(z0+{j})', seed, f'q{tag}', 'x, y')}))"
    return f"""q{tag} as (select x, y, floor({fx})::bigint as x0, floor({fz})::bigint as z0, {fx} as fx, {fz} as fz from cells),
    t{tag} as (select *, fx-x0 as a, fz-z0 as b from q{tag}), f{tag} as (select x, y, a*a*a*(a*(a*6-15)+10) as u, b*b*b*(b*(b*6-15)+10) as v from t{tag}),
    n{tag} as (select f.x, f.y, ((c00.u + f.u*(c10.u-c00.u)) + f.v*((c01.u + f.u*(c11.u-c01.u)) - (c00.u + f.u*(c10.u-c00.u))))*2-1 as noise from f{tag} f
    join {corner(0, 0)} c00 on f.x = c00.x and f.y = c00.y join {corner(1, 0)} c10 on f.x = c10.x and f.y = c10.y join {corner(0, 1)} c01 on f.x = c01.x and f.y = c01.y join {corner(1, 1)} c11 on f.x = c11.x and f.y = c11.y)"""


simple("value_noise", "cells", lambda: ["x", "y", F.round(h.value_noise(C("x") / 7.0 - 5, C("y") / 9.0 - 3, h.WARP_SEED_X), 9).alias("noise")],
       f"+ {noise_sql(h.WARP_SEED_X, 'x/7.0::double - 5', 'y/9.0::double - 3')} select x, y, round(noise, 9) as noise from n")
# at scale 500 the warp's wave is 24 blocks and its reach 1.6
simple("domain_warp", "cells", lambda: ["x", "y", *[F.round(c, 9).alias(n) for c, n in zip(h.domain_warp(C("x") * 5 - 300, C("y") * 7 - 99, 500.0), ("wx", "wz"), strict=True)]],
       f"+ {noise_sql(h.WARP_SEED_X, '(x*5-300)/24.0::double', '(y*7-99)/24.0::double', '1')}, {noise_sql(h.WARP_SEED_Z, '(x*5-300)/24.0::double + 37', '(y*7-99)/24.0::double - 59', '2')} select n1.x, n1.y, round(n1.x*5-300 + n1.noise*1.6::double, 9) as wx, round(n1.y*7-99 + n2.noise*1.6::double, 9) as wz from n1 join n2 on n1.x = n2.x and n1.y = n2.y")


def w32(v: str) -> str:
    return f"((({v}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"


def hash32_sql(x: str, z: str, seed: int, source: str, keep: str) -> str:
    """CTE body: ``keep`` and h32, a signed 32-bit hash."""
    lo = lambda v, n: f"((({v}) & 4294967295) >> {n})"
    a = f"(select *, xor(xor({w32(f'({x})*{h.signed(h.HASH32_X, 32)}')}, {w32(f'({z})*({h.signed(h.HASH32_Z, 32)})')}), {h.signed(seed * h.HASH32_SEED, 32)}) as h0 from {source})"
    b = f"(select *, {w32(f'xor(h0, {lo('h0', 15)})*({h.signed(h.HASH32_1, 32)})')} as h1 from {a})"
    c = f"(select *, {w32(f'xor(h1, {lo('h1', 13)})*({h.signed(h.HASH32_2, 32)})')} as h2 from {b})"
    return f"select {keep}, xor(h2, {lo('h2', 16)}) as h32 from {c}"


#: Fixed value: the salt of the rolls' hash.
SALT = 0x6D2B79F5
simple("mix_hash32", "cells", lambda: ["x", "y", h.mix_hash32(C("x") - 64, C("y") - 9, SALT).alias("h"), h.percent_roll(h.mix_hash32(C("x") - 64, C("y") - 9, SALT), 30).alias("kept")],
       f"+ q as ({hash32_sql('x-64', 'y-9', SALT, 'cells', 'x, y')}) select x, y, h32 as h, ((h32 & 4294967295) >> 24) < 76 as kept from q")
LCG = "+ a as (select x, y, xor((x*7919 - y*31 + 281474976710656) % 281474976710656, 25214903917) as s from cells), b as (select x, y, ((s::hugeint*25214903917 + 11) % 281474976710656)::bigint >> 17 as bits from a)"
simple("lcg_next_int", "cells", lambda: ["x", "y", *[h.lcg_next_int(C("x") * 7919 - C("y") * 31, n).alias(f"n{n}") for n in (3, 100, 64)]],
       f"{LCG} select x, y, bits % 3 as n3, bits % 100 as n100, (bits * 64) >> 31 as n64 from b")
simple("seeded_choice", "cells", lambda: ["x", "y", h.seeded_choice(C("x") * 7919 - C("y") * 31, ((10, "a"), (15, "b"), (100, "c")), 100).alias("kind")],
       f"{LCG} select x, y, case when bits % 100 < 10 then 'a' when bits % 100 < 15 then 'b' else 'c' end as kind from b")
