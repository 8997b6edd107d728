"""Queries of sources, sampling and range joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import hashing as h
from geoloom.functions import project as p
from geoloom.operators import ranges as r
from geoloom.operators import sampling as m
from geoloom.operators.storage import by_shuffle
from geoloom.plans.fixtures import fixture, oracle, rules
from geoloom.plans.registry import query
from geoloom.plans.scalar_queries import CODES, hash32_sql
from geoloom.functions.scalar import climate_code
from geoloom.sources import tables, tiles

C = F.col
SIZE = 16


def layer(spark: SparkSession, d: str, value: str, where: str | None = None) -> DataFrame:
    cells = fixture(spark, d, "cells")
    return tiles.pack_tiles(cells.filter(where) if where else cells, SIZE, value)


@query("blocks_to_cells", oracle("select 0::bigint as z, x, y, elev_m as v from cells", "cells"))
def blocks_to_cells(spark: SparkSession, d: str) -> DataFrame:
    return tiles.explode_tiles(layer(spark, d, "elev_m"), SIZE).withColumn("z", C("z").cast("bigint"))


@query("cells_to_blocks", oracle("select x//16 as tx, y//16 as ty, count(*) as n, sum(elev_m)::bigint as total, max(case when x%16 = 0 and y%16 = 0 then elev_m end) as corner from cells group by all", "cells"))
def cells_to_blocks(spark: SparkSession, d: str) -> DataFrame:
    held = F.filter("values", lambda v: v.isNotNull())
    return layer(spark, d, "elev_m").select("tx", "ty", F.size(held).cast("bigint").alias("n"), F.aggregate(held, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"), C("values")[0].alias("corner"))


WANTED = "select distinct (x//16 + point_id % 3) as tx, (y//16 + point_id % 2) as ty from points"


def wanted(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "points").select(F.lit(0).alias("z"), (F.floor(C("x") / SIZE) + C("point_id") % 3).alias("tx"), (F.floor(C("y") / SIZE) + C("point_id") % 2).alias("ty"))


@query("scan_tiles", oracle(f"+ w as ({WANTED}), t as (select x//16 as tx, y//16 as ty, count(*) as n from cells group by all) select t.* from t join w using (tx, ty)", "cells", "points"))
def scan_tiles(spark: SparkSession, d: str) -> DataFrame:
    found = layer(spark, d, "elev_m").join(wanted(spark, d).distinct(), tiles.TILE_KEY, "left_semi")
    return found.select("tx", "ty", F.size(F.filter("values", lambda v: v.isNotNull())).cast("bigint").alias("n"))


@query("missing_tiles", oracle(f"+ w as ({WANTED}) select tx, ty from w where (tx, ty) not in (select x//16, y//16 from cells)", "cells", "points"))
def missing_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiles.missing_keys(wanted(spark, d), layer(spark, d, "elev_m")).select("tx", "ty")


@query("crop_blocks", oracle("select x-20 as x, y-2 as y, elev_m from cells where x between 20 and 75 and y between 2 and 57", "cells"))
def crop_blocks(spark: SparkSession, d: str) -> DataFrame:
    return tiles.crop(fixture(spark, d, "cells"), 16, -2, 64, 4).select("x", "y", "elev_m")


RAW = "select c_custkey as line, case when c_custkey % 11 = 0 then 'x' else ' ' || cast(c_custkey % 7 * 10 as varchar(9)) end as code, case c_custkey % 5 when 0 then 'NONE' when 1 then ' af' when 2 then 'Cfb ' else c_mktsegment end as climate, case when c_custkey % 13 = 0 then ' ' when c_custkey % 2 = 0 then 'own:c' || cast(c_custkey % 3 as varchar(9)) else 'c' || cast(c_custkey % 4 as varchar(9)) end as class from customer"


@query("scan_rules_csv", f"with r as ({RAW}), s as (select line, try_cast(trim(code) as int) as cover, nullif(upper(trim(climate)), 'NONE') as climate, trim(class) as class from r), t as (select *, row_number() over (partition by cover, climate order by line desc) as n from s where cover is not null and class <> '') select cover::bigint as cover, climate, case when contains(class, ':') then class else 'base:' || class end as class from t where n = 1")
def scan_rules_csv(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.sql(RAW.replace("from customer", "from {customer}"), customer=spark.read.parquet(f"{d}/customer.parquet"))
    return tables.clean_rules(raw, "base").withColumn("cover", C("cover").cast("bigint"))


@query("parse_places_json", oracle("select point_id, segment as display_name, lat, lon from points where point_id % 5 <> 0 and point_id % 7 <> 0 union all select point_id, 'second', 1.5::double, 2.5::double from points", "points"))
def parse_places_json(spark: SparkSession, d: str) -> DataFrame:
    doc = F.format_string('[{"display_name": %s, "lat": "%s", "lon": "%s"}, {"display_name": "second", "lat": "1.5", "lon": "2.5"}, {"lat": "1", "lon": "2"}]', F.when(C("point_id") % 5 == 0, "null").otherwise(F.concat(F.lit('"'), C("segment"), F.lit('"'))), F.when(C("point_id") % 7 == 0, "far").otherwise(C("lat").cast("string")), C("lon").cast("string"))
    return tables.parse_places(fixture(spark, d, "points").withColumn("doc", doc), "doc", "point_id")


@query("parse_settings_json", oracle("select point_id, case when point_id % 2 = 0 then 35.0 else point_id end::double as world_scale, case when point_id % 3 = 0 then point_id else 64 end::bigint as height_offset, case when point_id % 5 = 0 then 7 when point_id % 3 = 0 then point_id else 64 end::bigint as sea_level, 5::bigint as ocean_shoreline_blend from points", "points"))
def parse_settings_json(spark: SparkSession, d: str) -> DataFrame:
    i = C("point_id").cast("string")
    field = lambda name, cond, v: F.when(cond, F.concat(F.lit(f'"{name}": '), v))
    doc = F.concat(F.lit("{"), F.concat_ws(", ", field("world_scale", C("point_id") % 2 != 0, i), field("height_offset", C("point_id") % 3 == 0, i), field("sea_level", C("point_id") % 5 == 0, F.lit("7"))), F.lit("}"))
    out = fixture(spark, d, "points").withColumn("doc", doc).select("point_id", *tables.parse_settings(C("doc")))
    return out.select("point_id", "world_scale", C("height_offset").cast("bigint").alias("height_offset"), C("sea_level").cast("bigint").alias("sea_level"), C("ocean_shoreline_blend").cast("bigint").alias("ocean_shoreline_blend"))


GAP = "(x//16 + y//16) % 5 <> 0"
SPARK_GAP = "(x div 16 + y div 16) % 5 <> 0"


@query("sample_nearest", oracle(f"select p.point_id, c.cover::bigint as cover from points p left join (select * from cells where {GAP}) c on c.x = p.x and c.y = p.y", "points", "cells"))
def sample_nearest(spark: SparkSession, d: str) -> DataFrame:
    return m.sample_nearest(fixture(spark, d, "points"), layer(spark, d, "cover", SPARK_GAP), SIZE, "cover").select("point_id", C("cover").cast("bigint").alias("cover"))


FRACTION = "select point_id, x + (point_id % 8) / 8.0::double as px, y + (point_id % 4) / 4.0::double as py from points"


@query("sample_bilinear", oracle(f"""+ f as ({FRACTION}), h as (select (max(y)+1) as hh from cells), c as (select * from cells where {GAP}),
 b as (select point_id, floor(px)::bigint as x0, floor(py)::bigint as y0, px-floor(px) as u, py-floor(py) as v from f), o as (select * from b, (values (0,0),(0,1),(1,0),(1,1)) as o(dx, dy)),
 w as (select o.point_id, (case dx when 1 then u else 1-u end)*(case dy when 1 then v else 1-v end) as wt, least(x0+dx, 127) as wx, least(y0+dy, hh-1) as wy, least(x0+dx, x0//16*16+15, 127) as lx, least(y0+dy, y0//16*16+15, hh-1) as ly from o, h),
 s as (select point_id, sum(wt*a.elev_m) as s1, count(a.elev_m) as n1, sum(wt*b.elev_m) as s2, count(b.elev_m) as n2 from w left join c a on a.x = wx and a.y = wy left join c b on b.x = lx and b.y = ly group by point_id)
 select point_id, round(case when n1 = 4 then s1 when n2 = 4 then s2 end, 6) as value from s""", "points", "cells"))
def sample_bilinear(spark: SparkSession, d: str) -> DataFrame:
    cells = fixture(spark, d, "cells")
    height = cells.agg(F.max("y") + 1).first()[0]
    pts = fixture(spark, d, "points").select("point_id", (C("x") + C("point_id") % 8 / 8.0).alias("px"), (C("y") + C("point_id") % 4 / 4.0).alias("py"))
    return m.sample_bilinear(pts, cells.filter(SPARK_GAP), SIZE, 128, height, value="elev_m").select("point_id", F.round("value", 6).alias("value"))


@query("sample_pyramid", oracle(f"""+ co as (select x//8 as cx, y//8 as cy, min(elev_m) as e from cells group by all having min(elev_m) % 4 <> 0), f as (select * from cells where {GAP}),
 j as (select p.point_id, f.elev_m as fine, co.e as coarse, p.point_id % 3 = 0 as sea from points p left join f on f.x = p.x and f.y = p.y left join co on co.cx = p.x//8 and co.cy = p.y//8)
 select point_id, coalesce(case when sea and coalesce(fine, 0) <= 0 then coalesce(coarse, fine) else coalesce(fine, coarse) end, 0)::double as elevation from j""", "points", "cells"))
def sample_pyramid(spark: SparkSession, d: str) -> DataFrame:
    cells = fixture(spark, d, "cells")
    coarse = cells.groupBy(F.floor(C("x") / 8).alias("x"), F.floor(C("y") / 8).alias("y")).agg(F.min("elev_m").alias("v")).filter("v % 4 <> 0")
    out = m.sample_pyramid(fixture(spark, d, "points"), layer(spark, d, "elev_m", SPARK_GAP), tiles.pack_tiles(coarse, SIZE), SIZE, 8, C("point_id") % 3 == 0)
    return out.select("point_id", "elevation")


@query("sample_tristate", oracle(f"+ t as (select distinct x//16 as tx, y//16 as ty from cells where {GAP}) select p.point_id, case when p.y > 100 then null when t.tx is null then false else coalesce(c.land > 0, false) end as is_land from points p left join t on t.tx = p.x//16 and t.ty = p.y//16 left join cells c on c.x = p.x and c.y = p.y", "points", "cells"))
def sample_tristate(spark: SparkSession, d: str) -> DataFrame:
    return m.sample_tristate(fixture(spark, d, "points"), layer(spark, d, "land", SPARK_GAP), SIZE, C("y") <= 100).select("point_id", "is_land")


CLASS = """case when {o} then 'ocean' when {w} or cover = 80 then 'river' when cover = 70 then 'ice' when cover = 95 then 'mangrove' else
 coalesce((select class from rules r where r.cover = q.cover and r.climate = upper(q.code)), (select class from rules r where r.cover = q.cover and r.climate is null), 'plains') end"""


@query("classify_rules", oracle(f"+ q as (select x, y, cover, cover = 0 as oc, case when koppen between 1 and 30 then {CODES}[koppen] end as code from cells) select x, y, {CLASS.format(o='oc', w='false')} as class from q", "cells", "rules"))
def classify_rules(spark: SparkSession, d: str) -> DataFrame:
    df = fixture(spark, d, "cells").select("x", "y", "cover", climate_code(C("koppen")).alias("climate"), (C("cover") == 0).alias("is_ocean"))
    return m.classify(df, rules(spark)).select("x", "y", "class")


NEAREST = """select p.point_id, c.koppen as v, (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y) as d, (c.y-p.y)*100+(c.x-p.x) as k from points p join cells c on c.x between p.x-{r} and p.x+{r} and c.y between p.y-{r} and p.y+{r} where c.koppen <> 0 and (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y) <= {r}*{r}"""


@query("nearest_valid", oracle(f"+ n as ({NEAREST.format(r=6)}), b as (select point_id, arg_min(v, d*100000+k) as value from n group by point_id) select p.point_id, b.value from points p left join b using (point_id)", "points", "cells"))
def nearest_valid(spark: SparkSession, d: str) -> DataFrame:
    return m.nearest_valid(fixture(spark, d, "points"), fixture(spark, d, "cells"), 6, "koppen")


@query("archive_lookup", oracle("+ e as (select seq*7 as tile_id, run_length from dir where seq % 4 <> 1) select l.q_id, l.q_line, e.tile_id as entry_id, coalesce(l.tile_id = e.tile_id or e.run_length = 0 or l.tile_id - e.tile_id < e.run_length, false) as hit from lookups l asof left join e on l.tile_id >= e.tile_id", "dir", "lookups"))
def archive_lookup(spark: SparkSession, d: str) -> DataFrame:
    entries = fixture(spark, d, "dir").filter("seq % 4 <> 1").select((C("seq") * 7).alias("tile_id"), "run_length")
    return r.asof_lookup(fixture(spark, d, "lookups"), entries).select("q_id", "q_line", "entry_id", "hit")


def found_sql(level: int, source: str) -> str:
    return f"m{level} as (select l.q_id, l.q_line, l.tile_id, e.t, e.run_length as rl, e.leaf, coalesce(l.tile_id = e.t or e.run_length = 0 or l.tile_id - e.t < e.run_length, false) as hit from ({source}) l asof left join ee e on l.dd = e.dd and l.tile_id >= e.t)"


def deeper(level: int) -> str:
    return f"select q_id, q_line, tile_id, leaf as dd from m{level} where hit and rl = 0"


@query("archive_levels", oracle(f"""+ e as (select seq, seq*7 as t, run_length from dir where seq % 4 <> 1), ee as (select 0::bigint as dd, t, run_length, case when run_length = 0 then seq+1 else 0 end as leaf from e
 union all select seq+1, t+1, 2, 0 from e where run_length = 0 union all select seq+1, t+4, 0, seq+1000001 from e where run_length = 0 union all select seq+1000001, t+5, 1, 0 from e where run_length = 0),
 {found_sql(0, 'select *, 0::bigint as dd from lookups')}, {found_sql(1, deeper(0))}, {found_sql(2, deeper(1))} {" union all ".join(f"select q_id, q_line, tile_id, case when hit then {k} end::bigint as depth, case when hit then t end as entry_id from m{k} where not (hit and rl = 0)" for k in range(3))}""", "dir", "lookups"))
def archive_levels(spark: SparkSession, d: str) -> DataFrame:
    """Look-ups through a root directory and two levels of leaves."""
    root = fixture(spark, d, "dir").filter("seq % 4 <> 1").select("seq", (C("seq") * 7).alias("t"), C("run_length").cast("bigint").alias("run_length"))
    leaves = root.filter("run_length = 0")
    entry = lambda df, directory, at, run, leaf: df.select(directory.alias("directory"), (C("t") + at).alias("tile_id"), run.cast("bigint").alias("run_length"), leaf.cast("bigint").alias("leaf"))
    zero, below = F.lit(0), C("seq") + 1
    entries = entry(root, F.lit(0).cast("bigint"), 0, C("run_length"), F.when(C("run_length") == 0, below).otherwise(0))
    entries = entries.union(entry(leaves, below, 1, F.lit(2), zero)).union(entry(leaves, below, 4, zero, C("seq") + 1_000_001)).union(entry(leaves, C("seq") + 1_000_001, 5, F.lit(1), zero))
    return r.archive_lookup(fixture(spark, d, "lookups"), entries)


@query("box_cap_cells", oracle("+ k as (select c.x, c.y, min(greatest(-30, b.base-1)) as cap from cells c join boxes b on c.x between b.min_x and b.max_x and c.y between b.min_y and b.max_y where b.kind <> 0 group by all) select c.x, c.y, least(elev_m, coalesce(cap, elev_m)) as elev_m, coalesce(cap < elev_m, false) as lowered from cells c left join k on c.x = k.x and c.y = k.y", "cells", "boxes"))
def box_cap_cells(spark: SparkSession, d: str) -> DataFrame:
    return r.apply_box_caps(fixture(spark, d, "cells"), fixture(spark, d, "boxes").filter("kind <> 0"), -30).select("x", "y", "elev_m", "lowered")


@query("tiles_near_water", oracle("+ t as (select distinct x//16 as tx, y//16 as ty from cells), w as (select x, y from cells where cover = 80) select tx, ty from t where exists (select 1 from w where x between tx*16-5 and tx*16+20 and y between ty*16-5 and ty*16+20)", "cells"))
def tiles_near_water(spark: SparkSession, d: str) -> DataFrame:
    cells = fixture(spark, d, "cells")
    all_tiles = cells.select(F.floor(C("x") / SIZE).alias("tx"), F.floor(C("y") / SIZE).alias("ty")).distinct()
    return r.tiles_near(all_tiles, cells.filter("cover = 80"), SIZE, 5)


@query("exclude_near_water", oracle("+ s as (select distinct x, y from points), w as (select x, y from cells where cover = 80) select s.x, s.y from s where not exists (select 1 from w where abs(w.x-s.x) <= 4 and abs(w.y-s.y) <= 4)", "points", "cells"))
def exclude_near_water(spark: SparkSession, d: str) -> DataFrame:
    return r.exclude_near(fixture(spark, d, "points").select("x", "y").distinct(), fixture(spark, d, "cells").filter("cover = 80"), 4)


#: Fixed value: the salt of the sites' hash.
SALT = 0x7F4A7C15


def sites(df: DataFrame, size: int, percent: int, salt: int) -> DataFrame:
    """One jittered site for each bin of the cells, kept by a roll."""
    binned = df.select(F.floor(C("x") / size).alias("bx"), F.floor(C("y") / size).alias("bz")).distinct().withColumn("h", h.mix_hash32(C("bx"), C("bz"), salt))
    jitter = lambda c: F.pmod(c, F.lit(size))
    kept = binned.filter(h.percent_roll(C("h"), percent))
    return kept.select("bx", "bz", C("h").alias("site_id"), (C("bx") * size + jitter(C("h"))).alias("sx"), (C("bz") * size + jitter(F.shiftrightunsigned(C("h").cast("int"), 8))).alias("sz"), (2 + F.shiftrightunsigned(C("h").cast("int"), 29)).cast("bigint").alias("radius"))


SITES = f"b as (select distinct x//8 as bx, y//8 as bz from cells), hh as ({hash32_sql('bx', 'bz', SALT, 'b', 'bx, bz')}), s as (select bx, bz, h32 as site_id, bx*8 + (h32%8+8)%8 as sx, bz*8 + ((h32 & 4294967295) >> 8) % 8 as sz, 2 + ((h32 & 4294967295) >> 29) as radius from hh where ((h32 & 4294967295) >> 24) < 153)"


@query("stratified_sites", oracle(f"+ {SITES} select * from s", "cells"))
def stratified_sites(spark: SparkSession, d: str) -> DataFrame:
    return sites(fixture(spark, d, "cells"), 8, 60, SALT)


@query("site_radius_height", oracle(f"+ {SITES}, c as (select s.*, cells.cover from s join cells on cells.x = s.sx and cells.y = s.sz), p as (select * from (values (10, 6, 3), (20, 2, 2), (30, 1, 4)) as p(cover, tall, wide)) select site_id, c.cover::bigint as cover, (coalesce(tall, 1) + ((site_id & 4294967295) >> 16) % 4)::bigint as height, coalesce(wide, 1)::bigint as width from c left join p on c.cover = p.cover", "cells"))
def site_radius_height(spark: SparkSession, d: str) -> DataFrame:
    cells = fixture(spark, d, "cells")
    params = F.broadcast(spark.createDataFrame([(10, 6, 3), (20, 2, 2), (30, 1, 4)], "cover int, tall int, wide int"))  # one row for each kind
    placed = sites(cells, 8, 60, SALT).join(by_shuffle(cells.select(C("x").alias("sx"), C("y").alias("sz"), "cover")), ["sx", "sz"]).join(params, "cover", "left")
    return placed.select("site_id", C("cover").cast("bigint").alias("cover"), (F.coalesce("tall", F.lit(1)) + F.shiftrightunsigned(C("site_id").cast("int"), 16) % 4).cast("bigint").alias("height"), F.coalesce("wide", F.lit(1)).cast("bigint").alias("width"))


@query("nearest_site", oracle(f"+ {SITES}, j as (select p.point_id, s.site_id, abs(p.x-s.sx)+abs(p.y-s.sz) as d, (s.bz - p.y//8)*3 + (s.bx - p.x//8) as k from points p join s on abs(s.bx - p.x//8) <= 1 and abs(s.bz - p.y//8) <= 1 where abs(p.x-s.sx)+abs(p.y-s.sz) <= s.radius), best as (select point_id, arg_min(site_id, d*100+k) as site_id, min(d) as dist from j group by point_id) select p.point_id, best.site_id, best.dist from points p left join best using (point_id)", "points", "cells"))
def nearest_site(spark: SparkSession, d: str) -> DataFrame:
    return r.nearest_site(fixture(spark, d, "points"), sites(fixture(spark, d, "cells"), 8, 60, SALT), 8)


@query("tile_k_ring", oracle("+ k as (select distinct x, y from points), o as (select unnest(range(-2, 3)) as dx), q as (select unnest(range(-2, 3)) as dy) select distinct 7::bigint as z, x+dx as x, y+dy as y from k, o, q where x+dx between 0 and 127 and y+dy between 0 and 127", "points"))
def tile_k_ring(spark: SparkSession, d: str) -> DataFrame:
    return r.k_ring(fixture(spark, d, "points").select(F.lit(7).cast("bigint").alias("z"), "x", "y").distinct(), 2)


@query("geo_tile_k_ring", oracle("+ k as (select distinct floor(lat/3)::bigint*3 as a, floor(lon/3)::bigint*3 as b from points), o as (select unnest(range(-1, 2)) as i), q as (select unnest(range(-1, 2)) as j) select distinct a+i*3 as tlat, b+j*3 as tlon from k, o, q where a+i*3 between -60 and 81 and b+j*3 between -180 and 177", "points"))
def geo_tile_k_ring(spark: SparkSession, d: str) -> DataFrame:
    keys = fixture(spark, d, "points").select(*[c.alias(n) for c, n in zip(p.geo_tile(C("lon"), C("lat")), ("tlat", "tlon"), strict=True)]).distinct()
    return r.geo_k_ring(keys, 1)


@query("tile_ancestor", oracle("""+ have as (select distinct 9 - point_id % 6 as z, x*4 >> point_id % 6 as x, y*4 >> point_id % 6 as y from points where point_id % 3 = 0), k as (select distinct x*4 as x, y*4 as y from points),
 u as (select k.x, k.y, 9 - i as az, k.x >> i as ax, k.y >> i as ay from k, (select unnest(range(8)) as i) where k.x < 512 and k.y < 512) select 9::bigint as z, x, y, max(az) as az, arg_max(ax, az) as ax, arg_max(ay, az) as ay from u where (az, ax, ay) in (select z, x, y from have) group by x, y""", "points"))
def tile_ancestor(spark: SparkSession, d: str) -> DataFrame:
    pts = fixture(spark, d, "points")
    shift = lambda c: F.call_function("shiftright", C(c) * 4, (C("point_id") % 6).cast("int")).alias(c)
    have = pts.filter("point_id % 3 = 0").select((9 - C("point_id") % 6).alias("z"), shift("x"), shift("y")).distinct()
    return r.ancestor_fallback(pts.select(F.lit(9).cast("bigint").alias("z"), (C("x") * 4).alias("x"), (C("y") * 4).alias("y")).distinct(), have)


@query("neighbors", oracle("select a.x, a.y, b.x as nx, b.y as ny, case when a.x = b.x or a.y = b.y then 10 else 14 end::bigint as cost from cells a, (select unnest(range(-1, 2)) as dx) o, (select unnest(range(-1, 2)) as dy) q, cells b where b.x = a.x+dx and b.y = a.y+dy and not (dx = 0 and dy = 0) and a.cover = 80 and b.cover = 80", "cells"))
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return r.neighbors(fixture(spark, d, "cells").filter("cover = 80")).withColumn("cost", C("cost").cast("bigint"))


@query("viewport_tiles", oracle("select point_id, unnest(range(floor((x*90-1000)/256.0)::bigint, ceil((x*90-1000+640)/256.0)::bigint)) as x, y from (select point_id, x, unnest(range(floor(y*70/256.0)::bigint, ceil((y*70+480)/256.0)::bigint)) as y from points)", "points"))
def viewport_tiles(spark: SparkSession, d: str) -> DataFrame:
    return r.viewport_tiles(fixture(spark, d, "points"), "point_id", C("x") * 90 - 1000, C("y") * 70, F.lit(640), F.lit(480))


@query("overlay_layers", oracle(f"select p.point_id, c.elev_m as elev, c2.cover::bigint as cover, c.koppen as koppen from points p left join cells c on c.x = p.x and c.y = p.y left join (select * from cells where {GAP}) c2 on c2.x = p.x and c2.y = p.y", "points", "cells"))
def overlay_layers(spark: SparkSession, d: str) -> DataFrame:
    layers = {"elev": layer(spark, d, "elev_m"), "cover": layer(spark, d, "cover", SPARK_GAP), "koppen": layer(spark, d, "koppen")}
    return m.overlay(fixture(spark, d, "points"), layers, SIZE).select("point_id", "elev", C("cover").cast("bigint").alias("cover"), "koppen")


@query("rule_filter_ids", "with i as (select p_partkey as k, p_type as id from part) select k, id from i where id <> 'nothing' and not starts_with(id, 'PROMO') and not contains(id, 'STEEL')")
def rule_filter_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.read.parquet(f"{d}/part.parquet").select(C("p_partkey").alias("k"), C("p_type").alias("id"))
    off = spark.createDataFrame([("equals", "nothing"), ("prefix", "PROMO"), ("contains", "STEEL")], "kind string, pattern string")
    return r.filter_by_rules(ids, off)


@query("rule_filter_sets", "with m as (select l_orderkey as k, p_type as id from lineitem join part on p_partkey = l_partkey), g as (select distinct k from m where id = 'nothing' or starts_with(id, 'PROMO BRUSHED') or contains(id, 'NICKEL')) select k, count(*) as members from m where k not in (select k from g) group by k")
def rule_filter_sets(spark: SparkSession, d: str) -> DataFrame:
    """Orders none of whose parts is switched off, with their lines."""
    part = spark.read.parquet(f"{d}/part.parquet").select(C("p_partkey").alias("l_partkey"), C("p_type").alias("id"))
    members = spark.read.parquet(f"{d}/lineitem.parquet").select(C("l_orderkey").alias("k"), "l_partkey").join(part, "l_partkey").select("k", "id")
    off = spark.createDataFrame([("equals", "nothing"), ("prefix", "PROMO BRUSHED"), ("contains", "NICKEL")], "kind string, pattern string")
    return r.filter_sets_by_rules(members, off, "k").groupBy("k").agg(F.count("*").alias("members"))


@query("sink_tiles", oracle("select 0::bigint as z, x//16 as tx, y//16 as ty, count(*) as n from cells group by all", "cells"))
def sink_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Writes the tiles of the elevation layer, and returns what a reader finds."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="spark-tiles-")
    path = f"{root}/tiles-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    tiles.write_tiles(layer(spark, d, "elev_m"), path)
    tiles.write_tiles(layer(spark, d, "elev_m"), path)  # a second time replaces the first
    return tiles.read_tiles(spark, path).select(C("z").cast("bigint").alias("z"), "tx", "ty", F.size(F.filter("values", lambda v: v.isNotNull())).cast("bigint").alias("n"))


CODE = f"case when koppen between 1 and 30 then {CODES}[koppen] end"


@query("class_at_points", oracle(f"""+ n as ({NEAREST.format(r=6)}), b as (select point_id, arg_min(v, d*100000+k) as near from n group by point_id),
 j as (select p.point_id, c.cover, case when coalesce(c.koppen, 0) = 0 then b.near else c.koppen end as koppen, c.cover = 0 and c.elev_m <= 0 as oc from points p join cells c on c.x = p.x and c.y = p.y left join b using (point_id)),
 q as (select *, {CODE} as code from j) select {CLASS.format(o='oc', w='false')} as class, count(*) as n from q group by 1""", "points", "cells", "rules"))
def class_at_points(spark: SparkSession, d: str) -> DataFrame:
    """The class at each point, counted: sample cover and climate, fill climate gaps nearby, apply the rules."""
    cells = fixture(spark, d, "cells")
    layers = tiles.pack_tiles(cells, SIZE, F.struct("cover", "koppen", C("elev_m").alias("elev")))
    pts = m.sample_nearest(fixture(spark, d, "points"), layers, SIZE, "_v").select("point_id", "x", "y", "_v.*")
    filled = m.climate_or_nearest(pts.filter("cover is not null"), cells, 6)
    ready = filled.withColumns({"climate": climate_code(C("koppen")), "is_ocean": (C("cover") == 0) & (C("elev") <= 0)})
    return m.classify(ready, rules(spark)).groupBy("class").agg(F.count("*").alias("n"))
