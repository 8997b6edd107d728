"""Queries of focal, graph, window and set operators, request flows and composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import scalar as s
from geoloom.functions.scalar import climate_code
from geoloom.operators import focal as f
from geoloom.operators import graph as g
from geoloom.operators import levels as lv
from geoloom.operators import ranges as r
from geoloom.operators import sampling as m
from geoloom.operators import water as wt
from geoloom.operators import windows as w
from geoloom.operators.storage import by_shuffle
from geoloom.plans.fixtures import fixture, oracle, rules
from geoloom.plans.join_queries import CLASS, CODE, SALT, SITES, layer, sites
from geoloom.plans.registry import query
from geoloom.plans.scalar_queries import SHARE_SQL, TINT_SQL, ramp_sql, seed_sql
from geoloom.sources.tiles import pack_tiles
from geoloom.streaming import requests

C = F.col
WATER = "cover = 80 or (cover = 0 and elev_m <= 0)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "cells")


def water(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).filter(WATER)


@query("focal_majority", oracle("+ o as (select unnest(range(-1, 2)) as dx), q as (select unnest(range(-1, 2)) as dy), n as (select a.x, a.y, a.cover as own, b.cover as v, count(*) as n, min(dy*3+dx) as k, bool_or(dx = 0 and dy = 0) as here from cells a, o, q, cells b where b.x = a.x+dx and b.y = a.y+dy group by all), t as (select *, row_number() over (partition by x, y order by case when v in (0, 80) then 0 else n end desc, here desc, k) as i from n) select x, y, case when own in (0, 80) then own else v end::bigint as cover from t where i = 1", "cells"))
def focal_majority(spark: SparkSession, d: str) -> DataFrame:
    return f.focal_majority(cells(spark, d)).withColumn("cover", C("cover").cast("bigint"))


@query("focal_mode_disk", oracle("+ o as (select unnest(range(-2, 3)) as dx), q as (select unnest(range(-2, 3)) as dy), n as (select a.x, a.y, b.koppen as v, count(*) as n, bool_or(dx = 0 and dy = 0) as here from cells a, o, q, cells b where b.x = a.x+dx and b.y = a.y+dy and dx*dx+dy*dy <= 4 and b.koppen <> 0 group by all), t as (select *, row_number() over (partition by x, y order by n desc, here desc, v) as i from n) select c.x, c.y, t.v as koppen from cells c left join t on t.x = c.x and t.y = c.y and i = 1", "cells"))
def focal_mode_disk(spark: SparkSession, d: str) -> DataFrame:
    return f.focal_mode(cells(spark, d))


@query("focal_histogram", oracle("+ o as (select unnest(range(-1, 2)) as dx), q as (select unnest(range(-1, 2)) as dy) select a.x, a.y, b.cover::bigint as v, count(*) as n from cells a, o, q, cells b where b.x = a.x+dx and b.y = a.y+dy group by all", "cells"))
def focal_histogram(spark: SparkSession, d: str) -> DataFrame:
    return f.focal_histogram(cells(spark, d)).withColumn("v", C("v").cast("bigint"))


@query("focal_slope", oracle("select a.x, a.y, max(abs(b.elev_m - a.elev_m)) as slope from cells a join cells b on (b.x = a.x and abs(b.y - a.y) in (0, 4)) or (b.y = a.y and abs(b.x - a.x) = 4) group by all", "cells"))
def focal_slope(spark: SparkSession, d: str) -> DataFrame:
    return f.focal_slope(cells(spark, d))


@query("coarse_any", oracle("select x//8 as cx, y//8 as cy, bool_or(cover = 80) as any_set from cells group by all", "cells"))
def coarse_any(spark: SparkSession, d: str) -> DataFrame:
    return f.coarsen_any(cells(spark, d), 8, C("cover") == 80)


@query("minmax_center", oracle("select x, y, elev_m - (select (min(elev_m) + max(elev_m)) / 2.0::double from cells) as centred from cells", "cells"))
def minmax_center(spark: SparkSession, d: str) -> DataFrame:
    return f.normalize(cells(spark, d), "elev_m").select("x", "y", "centred")


@query("zonal_summary", oracle("+ k as (select x//16 as cx, y//16 as cy, cover, count(*) as n from cells group by all), b as (select cx, cy, cover, row_number() over (partition by cx, cy order by n desc, cover) as i from k) select x//16 as cx, y//16 as cy, count(*) as cells, count(*) filter (cells.cover = 80) as water, any_value(b.cover)::bigint as dominant, min(elev_m) as low, max(elev_m) as high, round(avg(elev_m), 6) as mean from cells join b on b.cx = x//16 and b.cy = y//16 and i = 1 group by x//16, y//16", "cells"))
def zonal_summary(spark: SparkSession, d: str) -> DataFrame:
    return f.zonal(cells(spark, d), 16).withColumns({"dominant": C("dominant").cast("bigint"), "mean": F.round("mean", 6)})


@query("gate_tiles", oracle("select distinct x//16 as tx, y//16 as ty from cells where cover = 80", "cells"))
def gate_tiles(spark: SparkSession, d: str) -> DataFrame:
    return f.gate_tiles(cells(spark, d), 16, C("cover") == 80)


@query("resample_stride", oracle("select x, y, first_value(cover) over (partition by x//4, y//4 order by cover <> 80, y, x)::bigint as cover, first_value(elev_m) over (partition by x//4, y//4 order by y, x) as elev_m from cells", "cells"))
def resample_stride(spark: SparkSession, d: str) -> DataFrame:
    base = cells(spark, d)
    cover = f.resample_stride(base, 4, "cover", C("cover") == 80).withColumn("cover", C("cover").cast("bigint"))
    return cover.join(by_shuffle(f.resample_stride(base, 4, "elev_m")), ["x", "y"])


@query("forward_diff", oracle("select x, y, coalesce(lead(elev_m) over (partition by y order by x) - elev_m, 0) as dx, coalesce(lead(elev_m) over (partition by x order by y) - elev_m, 0) as dy from cells", "cells"))
def forward_diff(spark: SparkSession, d: str) -> DataFrame:
    return f.forward_diff(cells(spark, d)).select("x", "y", "dx", "dy")


KINDS = f"+ q as (select x, y, cover, cover = 0 and elev_m <= 0 as oc, {CODE} as code from cells), k as (select distinct {CLASS.format(o='oc', w='false')} as class from q), po as (select distinct class from rules union select unnest(['ocean', 'river', 'ice', 'mangrove', 'plains']))"


@query("possible_classes", oracle(f"{KINDS} select po.class, k.class is not null as seen from po left join k using (class)", "cells", "rules"))
def possible_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every class that rules and constants can give, and whether a cell has it."""
    constants = spark.createDataFrame([(c,) for c in ("ocean", "river", "ice", "mangrove", "plains")], "class string")
    kinds = cells(spark, d).select("cover", climate_code(C("koppen")).alias("climate"), ((C("cover") == 0) & (C("elev_m") <= 0)).alias("is_ocean")).distinct()
    seen = m.classify(kinds, rules(spark)).select("class", F.lit(True).alias("_seen")).distinct()
    return rules(spark).select("class").union(constants).distinct().join(seen, "class", "left").select("class", F.coalesce("_seen", F.lit(False)).alias("seen"))


# components: label propagation over cells, row-major first cell
COMP = f"""wc as (select x, y, elev_m, cover, land, y*128 + x as id from cells where {WATER}),
 ru as (select *, id - row_number() over (partition by y order by x) as gp from wc), rn as (select *, min(id) over (partition by y, gp) as run from ru),
 ed as (select distinct a.run as a, b.run as b from rn a join rn b on b.x = a.x and b.y = a.y + 1), sy as (select a, b from ed union select b, a from ed),
 rc as (select run as node, run as label from rn union select sy.b, rc.label from rc join sy on sy.a = rc.node and rc.label < sy.b), cl as (select node, min(label) as comp from rc group by node),
 lab as (select rn.x, rn.y, rn.elev_m, rn.cover, rn.land, rn.id, cl.comp from rn join cl on cl.node = rn.run)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return g.components(water(spark, d), 128)


@query("connected_components", oracle(f"+ {COMP} select x, y, comp from lab", "cells"))
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("x", "y", "comp")


@query("number_components", oracle(f"+ {COMP} select comp, row_number() over (order by comp) as number from (select distinct comp from lab)", "cells"))
def number_components(spark: SparkSession, d: str) -> DataFrame:
    return g.number_components(labelled(spark, d))


STATS = "st as (select comp, count(*) as cells, sum(elev_m)::bigint as total, count(*) filter (elev_m < 0) as below, count(*) filter (land = 1) as on_land, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(elev_m) as low, max(elev_m) as high, bool_or(cover = 0) as no_data, floor(sum(elev_m)/count(*)+0.5)::bigint as average, arg_min(id, elev_m*1000000000 + id) as low_at, arg_max(id, elev_m*1000000000 - id) as high_at from lab group by comp)"


@query("component_stats", oracle(f"+ {COMP}, {STATS} select * from st", "cells"))
def component_stats(spark: SparkSession, d: str) -> DataFrame:
    return g.component_stats(labelled(spark, d), 128)


SPILL = "bo as (select lab.comp, l.elev_m as h from lab, (values (1,0),(-1,0),(0,1),(0,-1)) as o(dx, dy), cells l where l.x = lab.x+dx and l.y = lab.y+dy and not (l.cover = 80 or (l.cover = 0 and l.elev_m <= 0))), bl as (select comp, list_sort(list(h)) as hs from bo group by comp), sp as (select st.comp, coalesce(hs[floor(0.1::double*(len(hs)-1))::bigint + 1], average) as spill from st left join bl using (comp))"


@query("border_percentile", oracle(f"+ {COMP}, {STATS}, {SPILL} select * from sp", "cells"))
def border_percentile(spark: SparkSession, d: str) -> DataFrame:
    return g.border_percentile(labelled(spark, d), cells(spark, d))


FLAGS = "fl as (select *, below/cells >= 0.9 as below_sea, on_land/cells >= 0.6 as land_inland from st)"


@query("ratio_flags", oracle(f"+ {COMP}, {STATS}, {FLAGS} select comp, below_sea, land_inland from fl", "cells"))
def ratio_flags(spark: SparkSession, d: str) -> DataFrame:
    return g.ratio_flags(g.component_stats(labelled(spark, d), 128)).select("comp", "below_sea", "land_inland")


SEEDS = "se as (select distinct lab.x, lab.y, comp from lab, (values (1,0),(-1,0),(0,1),(0,-1)) as o(dx, dy), cells l where l.x = lab.x+dx and l.y = lab.y+dy and not (l.cover = 80 or (l.cover = 0 and l.elev_m <= 0)) and l.elev_m <= 2 and lab.elev_m <= 2 and lab.cover <> 0)"


def seeds(spark: SparkSession, d: str, lab: DataFrame) -> DataFrame:
    """Low inland water beside low land."""
    land = cells(spark, d).filter(f"not ({WATER}) and elev_m <= 2").select("x", "y")
    sides = m.offsets([(1, 0), (-1, 0), (0, 1), (0, -1)], "dx", "dy")
    low = lab.filter("elev_m <= 2 and cover <> 0").select("comp", C("x").alias("sx"), C("y").alias("sy"), sides.alias("o"))
    near = low.select("comp", "sx", "sy", (C("sx") + C("o.dx")).alias("x"), (C("sy") + C("o.dy")).alias("y")).join(by_shuffle(land), ["x", "y"], "left_semi")
    return near.select(C("sx").alias("x"), C("sy").alias("y"), "comp").distinct()


@query("flood_from_seeds", oracle(f"+ {COMP}, {SEEDS} select x, y, comp from lab where comp in (select comp from se)", "cells"))
def flood_from_seeds(spark: SparkSession, d: str) -> DataFrame:
    lab = labelled(spark, d)
    return g.flood(lab, seeds(spark, d, lab)).select("x", "y", "comp")


@query("touches_any", oracle(f"+ {COMP}, co as (select x//8 as cx, y//8 as cy from cells group by all having bool_or(cover = 10)) select comp, bool_or(co.cx is not null) as touches from lab left join co on co.cx = x//8 and co.cy = y//8 group by comp", "cells"))
def touches_any(spark: SparkSession, d: str) -> DataFrame:
    coarse = f.coarsen_any(cells(spark, d), 8, C("cover") == 10).filter("any_set")
    placed = labelled(spark, d).select("comp", F.floor(C("x") / 8).alias("cx"), F.floor(C("y") / 8).alias("cy"))
    return placed.join(coarse, ["cx", "cy"], "left").groupBy("comp").agg(F.bool_or(C("any_set").isNotNull()).alias("touches"))


OCEAN = "oc as (select fl.*, sp.spill, not land_inland and (no_data or (below_sea and fl.comp not in (select comp from se))) as is_ocean from fl join sp using (comp))"


def judge(spark: SparkSession, d: str, lab: DataFrame) -> DataFrame:
    """The components of labelled water, judged; the land beside them is all cells that aren't water."""
    land = cells(spark, d).filter(f"not ({WATER})")
    return g.classify_components(g.component_stats(lab, 128), g.border_percentile(lab, land), seeds(spark, d, lab).select("comp").distinct())


def judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labelled water, stored, and its judged components."""
    lab = g.stored(labelled(spark, d))
    return lab, judge(spark, d, lab)


@query("ocean_or_inland", oracle(f"+ {COMP}, {STATS}, {SPILL}, {SEEDS}, {FLAGS}, {OCEAN} select comp, is_ocean, case when is_ocean then 0 else spill end::bigint as surface from oc", "cells"))
def ocean_or_inland(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d)[1].select("comp", "is_ocean", "surface")


@query("is_river", oracle(f"+ {COMP}, {STATS}, di as (select comp, cells, greatest(max_x-min_x+1, max_y-min_y+1) as lo, least(max_x-min_x+1, max_y-min_y+1) as th from st) select comp, lo >= 20 and th <= 16 and lo/th >= 3 and not (lo/th < 4.5 and th >= 12 and cells/(lo*th) >= 0.6) as river from di", "cells"))
def is_river(spark: SparkSession, d: str) -> DataFrame:
    return g.is_river(g.component_stats(labelled(spark, d), 128), 20, 16).select("comp", "river")


SHORE = f"wa as (select x, y from cells where {WATER}), sh as (select x, y from wa where (select count(*) from wa b where (b.x = wa.x and abs(b.y-wa.y) = 1) or (b.y = wa.y and abs(b.x-wa.x) = 1)) < 4)"


@query("shore_cells", oracle(f"+ {SHORE} select * from sh", "cells"))
def shore_cells(spark: SparkSession, d: str) -> DataFrame:
    return g.shore_cells(water(spark, d)).select("x", "y")


@query("cliff_edges", oracle(f"+ k as (select a.x, a.y, b.x as lx, b.y as ly from cells a, (values (1,0),(-1,0),(0,1),(0,-1)) as o(dx, dy), cells b where b.x = a.x+dx and b.y = a.y+dy and ({WATER.replace('cover', 'a.cover').replace('elev_m', 'a.elev_m')}) and not ({WATER.replace('cover', 'b.cover').replace('elev_m', 'b.elev_m')}) and b.elev_m - a.elev_m >= 5) select x, y, true as is_water from k union select lx, ly, false from k", "cells"))
def cliff_edges(spark: SparkSession, d: str) -> DataFrame:
    base = cells(spark, d)
    return g.cliff_edges(base.filter(WATER).withColumn("level", C("elev_m")), base.filter(f"not ({WATER})").withColumn("h", C("elev_m")), 5)


DIST = "ds as (select x, y, 10 as cost, y*128 + x as source from sh union select wa.x, wa.y, ds.cost + case when dx <> 0 and dy <> 0 then 14 else 10 end, ds.source from ds, (values (1,0),(-1,0),(0,1),(0,-1),(1,1),(1,-1),(-1,1),(-1,-1)) as o(dx, dy), wa where wa.x = ds.x+dx and wa.y = ds.y+dy and ds.cost + 10 <= 50)"


def distances(spark: SparkSession, d: str, limit: int = 5) -> DataFrame:
    """Cost over water from the shore cells, which themselves cost 10."""
    base = water(spark, d).select("x", "y")
    shore = g.shore_cells(base).select("x", "y", (C("y") * 128 + C("x")).alias("source"))
    return g.allocate(base, shore, limit)


@query("geodesic_distance", oracle("+ " + SHORE + ", dm as (select x, y, 10 as cost from sh union select wa.x, wa.y, dm.cost + case when dx <> 0 and dy <> 0 then 14 else 10 end from dm, (values (1,0),(-1,0),(0,1),(0,-1),(1,1),(1,-1),(-1,1),(-1,-1)) as o(dx, dy), wa where wa.x = dm.x+dx and wa.y = dm.y+dy and dm.cost + case when dx <> 0 and dy <> 0 then 14 else 10 end <= 50) select x, y, min(cost)::bigint as cost from dm group by x, y", "cells"))
def geodesic_distance(spark: SparkSession, d: str) -> DataFrame:
    return distances(spark, d).select("x", "y", "cost")


LAND_DIST = """so as (select x, y, y*128 + x as source from wa), la as (select x, y from cells where not (cover = 80 or (cover = 0 and elev_m <= 0))),
 al as (select x, y, 10 as cost, source from so union select la.x, la.y, al.cost + case when dx <> 0 and dy <> 0 then 14 else 10 end, al.source from al, (values (1,0),(-1,0),(0,1),(0,-1),(1,1),(1,-1),(-1,1),(-1,-1)) as o(dx, dy), la where la.x = al.x+dx and la.y = al.y+dy and al.cost + case when dx <> 0 and dy <> 0 then 14 else 10 end <= 30),
 ac as (select la.x, la.y, min(al.cost)::bigint as cost, arg_min(al.source, al.cost::bigint*100000000 + al.source) as source from al join la on la.x = al.x and la.y = al.y group by la.x, la.y)"""


def land_near_water(spark: SparkSession, d: str) -> DataFrame:
    base = cells(spark, d)
    sources = base.filter(WATER).select("x", "y", (C("y") * 128 + C("x")).alias("source"))
    return g.allocate(base.filter(f"not ({WATER})").select("x", "y"), sources, 3)


@query("cost_allocation", oracle(f"+ wa as (select x, y from cells where {WATER}), {LAND_DIST} select * from ac", "cells"))
def cost_allocation(spark: SparkSession, d: str) -> DataFrame:
    return land_near_water(spark, d)


@query("shore_blend", oracle(f"+ wa as (select x, y from cells where {WATER}), {LAND_DIST}, bl as (select ac.x, ac.y, c.elev_m, floor(wc.elev_m + ac.cost/10.0::double/3*(c.elev_m - wc.elev_m) + 0.5)::bigint as mix from ac join cells c on c.x = ac.x and c.y = ac.y join cells wc on wc.y*128 + wc.x = ac.source) select x, y, least(mix, elev_m) as h from bl", "cells"))
def shore_blend(spark: SparkSession, d: str) -> DataFrame:
    base = cells(spark, d)
    level = base.select((C("y") * 128 + C("x")).alias("source"), C("elev_m").alias("level"))
    near = land_near_water(spark, d).join(by_shuffle(base.select("x", "y", "elev_m")), ["x", "y"]).join(by_shuffle(level), "source")
    return near.select("x", "y", s.shore_blend(C("cost"), C("level"), C("elev_m"), 3).alias("h"))


@query("focal_mean_masked", oracle(f"+ {COMP}, nn as (select a.x, a.y, a.comp, a.elev_m, floor(avg(b.elev_m)+0.5)::bigint as mean from lab a join lab b on b.comp = a.comp and abs(b.x-a.x) <= 1 and abs(b.y-a.y) <= 1 group by all), mx as (select comp from lab group by comp having max(x%40*10) > 110) select x, y, case when x%40*10 > 100 and y%5 <> 0 and comp in (select comp from mx) then least(mean, 0) else elev_m end as bed from nn", "cells"))
def focal_mean_masked(spark: SparkSession, d: str) -> DataFrame:
    lab = labelled(spark, d).select("x", "y", "comp", (C("x") % 40 * 10).alias("cost"), (C("y") % 5 == 0).alias("cliff"), C("elev_m").alias("floor"), F.lit(1).alias("water"))
    return f.smooth_bed(lab)


@query("runs_along_axis", oracle("+ t as (select x, y, y - row_number() over (partition by x order by y) as gp from cells where cover = 80) select x, min(y) as start, max(y) as \"end\", count(*) as length from t group by x, gp having count(*) >= 5", "cells"))
def runs_along_axis(spark: SparkSession, d: str) -> DataFrame:
    return w.runs_along_axis(cells(spark, d), ["x"], "y", C("cover") == 80)


@query("undo_row_filter", oracle("+ t as (select x, y, sum(elev_m*97) over (partition by y order by x) as r, sum(elev_m*97) over (partition by x order by y) as c from cells) select x, y, ((r + 32768) % 65536 + 65536) % 65536 - 32768 as by_row, ((c + 32768) % 65536 + 65536) % 65536 - 32768 as by_column from t", "cells"))
def undo_row_filter(spark: SparkSession, d: str) -> DataFrame:
    base = cells(spark, d).select("x", "y", (C("elev_m") * 97).alias("v"))
    return w.undo_left(base, ["y"], "x", "v").withColumnRenamed("v", "by_row").join(w.undo_left(base, ["x"], "y", "v").withColumnRenamed("v", "by_column"), ["x", "y"])


@query("undo_chunk_filter", oracle("select x, y, elev_m*97 as average, elev_m*97 as paeth from cells where y < (select max(y) from cells)", "cells"))
def undo_chunk_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of eight whole rows, filtered against their neighbours and undone again."""
    base = cells(spark, d)
    last = base.agg(F.max("y")).first()[0]
    rows = base.filter(C("y") < last).select("x", "y", F.floor(C("y") / 8).alias("chunk"), (C("elev_m") * 97).alias("v"))
    before = lambda c, part, order: F.coalesce(F.lag(c).over(Window.partitionBy("chunk", part).orderBy(order)), F.lit(0))
    near = rows.withColumns({"left": before("v", "y", "x"), "up": before("v", "x", "y")}).withColumn("corner", before("up", "y", "x"))
    half = (C("left") + C("up")) / 2
    distance = lambda c: F.abs(C("left") + C("up") - C("corner") - C(c))
    nearest = F.when((distance("left") <= distance("up")) & (distance("left") <= distance("corner")), C("left")).when(distance("up") <= distance("corner"), C("up")).otherwise(C("corner"))
    at = C("x") + C("y") % 8 * 128
    out = None
    for kind, base_value in (("average", F.when(half < 0, F.ceil(half)).otherwise(F.floor(half))), ("paeth", nearest)):
        stored = near.select("chunk", at.alias("i"), w.wrap16(C("v") - base_value).alias("v"))
        undone = w.undo_chunk_filter(stored, kind, "chunk", 128).select((C("i") % 128).alias("x"), (C("chunk") * 8 + F.floor(C("i") / 128)).alias("y"), C("v").alias(kind))
        out = undone if out is None else out.join(undone, ["x", "y"])
    return out


@query("decode_directory", oracle("+ t as (select *, seq // 64 as part from dir), i as (select *, sum(delta) over (partition by part order by seq) as tile_id, count(*) filter (stored_offset <> 0) over (partition by part order by seq) as isl from t), o as (select seq, tile_id, first_value(stored_offset) over (partition by part, isl order by seq) - 1 + coalesce(sum(length) over (partition by part, isl order by seq rows between unbounded preceding and 1 preceding), 0) as \"offset\" from i) select seq, tile_id::bigint as tile_id, \"offset\"::bigint as \"offset\" from o", "dir"))
def decode_directory(spark: SparkSession, d: str) -> DataFrame:
    return w.decode_directory(fixture(spark, d, "dir").withColumn("part", F.floor(C("seq") / 64)), ["part"], "seq").select("seq", "tile_id", "offset")


@query("first_source", oracle("+ t as (select l.x, l.y, a.elev_m as level, row_number() over (partition by l.x, l.y order by a.y, a.x) as i from cells l, (values (1,0),(-1,0),(0,1),(0,-1)) as o(dx, dy), cells a where a.x = l.x+dx and a.y = l.y+dy and a.cover = 80 and l.cover <> 80) select x, y, level from t where i = 1", "cells"))
def first_source(spark: SparkSession, d: str) -> DataFrame:
    base = cells(spark, d)
    sides = m.offsets([(1, 0), (-1, 0), (0, 1), (0, -1)], "dx", "dy")
    sent = base.filter("cover = 80").select(C("x").alias("wx"), C("y").alias("wy"), C("elev_m").alias("level"), sides.alias("o"))
    met = sent.select((C("wx") + C("o.dx")).alias("x"), (C("wy") + C("o.dy")).alias("y"), "wx", "wy", "level").join(by_shuffle(base.filter("cover <> 80").select("x", "y")), ["x", "y"], "left_semi")
    return m.first_source(met, ["x", "y"], ["wy", "wx"]).select("x", "y", "level")


@query("stack_layers", oracle("+ l as (select x, y, k, case k when 0 then greatest(elev_m, 0) when 1 then x % 3 else y % 4 end as h from cells, (values (0),(1),(2)) as v(k)), t as (select *, sum(h) over (partition by x, y order by k) as u from l) select x, y, k::bigint as k, least(30, u-h)::bigint as lo, least(30, u)::bigint as hi from t where least(30, u) > least(30, u-h)", "cells"))
def stack_layers(spark: SparkSession, d: str) -> DataFrame:
    layers = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), h.alias("h")) for k, h in enumerate((F.greatest(C("elev_m"), F.lit(0)), C("x") % 3, C("y") % 4))])
    return w.stack_layers(cells(spark, d).select("x", "y", F.explode(layers).alias("l")).select("x", "y", "l.*"), ["x", "y"], "k", "h", 30).select("x", "y", "k", "lo", "hi")


@query("nth_smallest", oracle("+ t as (select koppen, elev_m, row_number() over (partition by koppen order by elev_m) as i from cells) select koppen, elev_m from t where i = 20", "cells"))
def nth_smallest(spark: SparkSession, d: str) -> DataFrame:
    return w.nth_smallest(cells(spark, d), ["koppen"], "elev_m", 20)


@query("top_places", "with q as (select p_partkey as q_id, lower(left(p_type, 5)) as text from part where p_partkey % 10 = 0), t as (select q_id, p.p_partkey as place_id, p.p_type as name, row_number() over (partition by q_id order by length(p.p_type), p.p_type, p.p_partkey) as rank from q join part p on starts_with(lower(p.p_type), q.text)) select q_id, rank, place_id, name from t where rank <= 5")
def top_places(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    places = part.select(C("p_partkey").alias("place_id"), C("p_type").alias("name"))
    asked = part.filter("p_partkey % 10 = 0").select(C("p_partkey").alias("q_id"), F.lower(F.substring("p_type", 1, 5)).alias("text"))
    return w.top_places(places, asked).withColumn("rank", C("rank").cast("bigint"))


@query("order_by_zoom", oracle("select point_id % 5 as z, x, y from points order by 1, 2, 3", "points"))
def order_by_zoom(spark: SparkSession, d: str) -> DataFrame:
    return w.order_tiles(fixture(spark, d, "points").select((C("point_id") % 5).alias("z"), "x", "y"))


@query("mask_union", oracle("select x, y from cells where cover = 0 union select x, y from cells where cover = 80", "cells"))
def mask_union(spark: SparkSession, d: str) -> DataFrame:
    return w.mask_union(cells(spark, d).filter("cover = 0"), cells(spark, d).filter("cover = 80"))


@query("mask_complement", oracle("select x, y from cells where cover <> 80", "cells"))
def mask_complement(spark: SparkSession, d: str) -> DataFrame:
    return w.mask_except(cells(spark, d), cells(spark, d).filter("cover = 80"))


@query("mask_intersect", oracle("select x, y from cells where cover <> 80 and elev_m % 3 <> 0", "cells"))
def mask_intersect(spark: SparkSession, d: str) -> DataFrame:
    return w.mask_intersect(cells(spark, d).filter("cover <> 80"), cells(spark, d).filter("elev_m % 3 <> 0"))


REQ = "+ q as (select event_id, user_id, least(90.0, greatest(-90.0, lat))::double as lat, least(180.0, greatest(-180.0, lon))::double as lon from reqs where not isnan(lat)), b as (select *, floor(lon*(40075017.0::double/360/50000))::bigint as x, floor(-lat*(40075017.0::double/360/50000))::bigint as y from q)"


@query("enrich_requests", oracle(f"{REQ} select event_id, user_id, case when c.x is not null then least(60, greatest(-20, greatest(c.elev_m, c.elev_m + c.x % 3) + 1)) end as target from b left join cells c on c.x = b.x and c.y = b.y", "reqs", "cells"))
def enrich_requests(spark: SparkSession, d: str) -> DataFrame:
    level = cells(spark, d).withColumn("v", C("elev_m") + C("x") % 3)
    return requests.enrich(fixture(spark, d, "reqs"), layer(spark, d, "elev_m"), pack_tiles(level, 16), 16, 50_000.0, -20, 60).select("event_id", "user_id", "target")


@query("debounce", oracle("+ t as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hours then 0 else 1 end as new from reqs), s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as sess from t) select user_id, max(ts) + interval 6 hours as fired_at, arg_max(text, (ts, event_id)) as text from s group by user_id, sess", "reqs"))
def debounce(spark: SparkSession, d: str) -> DataFrame:
    return requests.debounce(fixture(spark, d, "reqs"), "6 hours")


@query("latest_wins", oracle("select user_id, max(event_id) as event_id, arg_max(text, event_id) as text from reqs group by user_id", "reqs"))
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return requests.latest_wins(fixture(spark, d, "reqs").select("user_id", "event_id", "text"))


@query("tile_demand", oracle("+ t as (select event_id % 64 as x, (event_id * 7) % 64 as y from reqs) select distinct 6::bigint as z, x+dx as x, y+dy as y from t, (select unnest(range(-1, 2)) as dx), (select unnest(range(-1, 2)) as dy) where x+dx between 0 and 63 and y+dy between 0 and 63", "reqs"))
def tile_demand(spark: SparkSession, d: str) -> DataFrame:
    asked = fixture(spark, d, "reqs").select(F.lit(6).cast("bigint").alias("z"), (C("event_id") % 64).alias("x"), (C("event_id") * 7 % 64).alias("y"))
    return requests.tile_demand(asked, 1)


@query("surface_at_points", oracle(f"+ {COMP}, {STATS}, {SPILL}, {SEEDS}, {FLAGS}, {OCEAN}, wl as (select lab.x, lab.y, is_ocean, case when is_ocean then 0 else spill end as surface from lab join oc using (comp)) select p.point_id, c.elev_m as terrain, coalesce(case when wl.is_ocean then least(c.elev_m, wl.surface-1) else wl.surface-1 end, c.elev_m) as floor, wl.surface::bigint as water, greatest(c.elev_m, coalesce(wl.surface, c.elev_m)) + 1 as target from points p join cells c on c.x = p.x and c.y = p.y left join wl on wl.x = p.x and wl.y = p.y", "points", "cells"))
def surface_at_points(spark: SparkSession, d: str) -> DataFrame:
    """Ground, water floor, water level and target height at each point."""
    pts = fixture(spark, d, "points").select("point_id", "x", "y")
    lab = g.stored(labelled(spark, d))
    wet = g.stored(pts.join(by_shuffle(lab.select("x", "y", "comp")), ["x", "y"]).select("point_id", "comp"))
    asked = lab.join(wet.select("comp").distinct(), "comp", "left_semi")
    comps = judge(spark, d, asked)
    level = wet.join(by_shuffle(comps.select("comp", "is_ocean", "surface")), "comp").drop("comp")
    at = pts.join(by_shuffle(cells(spark, d).select("x", "y", "elev_m")), ["x", "y"]).join(by_shuffle(level), "point_id", "left")
    floor = F.coalesce(F.when(C("surface").isNotNull(), s.water_floor(C("elev_m"), C("surface"), C("is_ocean"), F.lit(False), F.lit(1))), C("elev_m"))
    return at.select("point_id", C("elev_m").alias("terrain"), floor.alias("floor"), C("surface").alias("water"), (F.greatest(C("elev_m"), F.coalesce("surface", "elev_m")) + 1).alias("target"))


@query("water_surface", oracle(f"+ {COMP}, {STATS}, {SPILL}, {SEEDS}, {FLAGS}, {OCEAN}, {SHORE}, dm as (select x, y, 10 as cost from sh union select wa.x, wa.y, dm.cost + case when dx <> 0 and dy <> 0 then 14 else 10 end from dm, (values (1,0),(-1,0),(0,1),(0,-1),(1,1),(1,-1),(-1,1),(-1,-1)) as o(dx, dy), wa where wa.x = dm.x+dx and wa.y = dm.y+dy and dm.cost + case when dx <> 0 and dy <> 0 then 14 else 10 end <= 50), cs as (select x, y, min(cost) as cost from dm group by x, y), j as (select lab.x, lab.y, lab.elev_m, is_ocean, case when is_ocean then 0 else spill end as surface, coalesce(cost, 60) as cost from lab join oc using (comp) left join cs on cs.x = lab.x and cs.y = lab.y) select x, y, is_ocean, surface::bigint as surface, case when is_ocean then least(elev_m, surface-1) else surface - case when cost <= 50 then 1 else 3 end end::bigint as floor from j", "cells"))
def water_surface(spark: SparkSession, d: str) -> DataFrame:
    """Every water cell with its kind, level and floor."""
    lab, comps = judged(spark, d)
    cost = distances(spark, d).select("x", "y", "cost")
    both = lab.join(by_shuffle(comps.select("comp", "is_ocean", "surface")), "comp").join(by_shuffle(cost), ["x", "y"], "left")
    depth = s.inland_depth(F.coalesce("cost", F.lit(60)) / 10.0, C("x"), C("y"))
    return both.select("x", "y", "is_ocean", "surface", s.water_floor(C("elev_m"), C("surface"), C("is_ocean"), F.lit(False), depth).alias("floor"))


def _blend_sql(kind: str, ocean: str, distance: int) -> str:
    """CTEs: land lowered towards one kind of water, as b{kind} (x, y, h)."""
    near = "(values (1,0),(-1,0),(0,1),(0,-1)) as o(dx, dy)"
    return f"""s{kind} as materialized (select so.x, so.y, min(wa.id) as src from wlv wa, {near}, soft so where wa.is_ocean = {ocean} and so.x = wa.x+dx and so.y = wa.y+dy group by so.x, so.y),
 r{kind} as (select x, y, 10 as cost, src from s{kind} union select so.x, so.y, r.cost + case when dx <> 0 and dy <> 0 then 14 else 10 end, r.src from r{kind} r, (values (1,0),(-1,0),(0,1),(0,-1),(1,1),(1,-1),(-1,1),(-1,-1)) as o(dx, dy), soft so where so.x = r.x+dx and so.y = r.y+dy and r.cost + case when dx <> 0 and dy <> 0 then 14 else 10 end <= {distance * 10}),
 n{kind} as (select x, y, min(cost)::bigint as cost, arg_min(src, cost::bigint*100000000 + src) as src from r{kind} group by x, y),
 b{kind} as (select n.x, n.y, floor(wa.level + n.cost/10.0::double/{distance}*(so.elev_m - wa.level) + 0.5)::bigint as h, so.elev_m from n{kind} n join soft so on so.x = n.x and so.y = n.y join wlv wa on wa.id = n.src)"""


EIGHT_SQL = "(values (1,0),(-1,0),(0,1),(0,-1),(1,1),(1,-1),(-1,1),(-1,-1)) as o(dx, dy)"
REGION = f"""rvd as (select comp, cells, greatest(max_x-min_x+1, max_y-min_y+1) as lo, least(max_x-min_x+1, max_y-min_y+1) as th, high from st),
 rvf as (select comp, high, lo >= 20 and th <= 16 and lo/th >= 3 and not (lo/th < 4.5 and th >= 12 and cells/(lo*th) >= 0.6) as river from rvd),
 wlv as materialized (select lab.x, lab.y, lab.elev_m, lab.id, lab.comp, is_ocean, case when is_ocean then 0 when river then least(spill, rvf.high) else spill end::bigint as level from lab join oc using (comp) join rvf using (comp)),
 dry as materialized (select x, y, elev_m from cells where not ({WATER})),
 ce as materialized (select a.x as wx, a.y as wy, d.x, d.y from wlv a, (values (1,0),(-1,0),(0,1),(0,-1)) as o(dx, dy), dry d where d.x = a.x+dx and d.y = a.y+dy and d.elev_m - a.level >= 5),
 soft as materialized (select * from dry where not exists (select 1 from ce where ce.x = dry.x and ce.y = dry.y)),
 inl as materialized (select * from wlv where not is_ocean), sho as (select a.x, a.y from inl a where (select count(*) from inl b where (b.x = a.x and abs(b.y-a.y) = 1) or (b.y = a.y and abs(b.x-a.x) = 1)) < 4),
 de as (select x, y, 10 as cost from sho union select a.x, a.y, de.cost + case when dx <> 0 and dy <> 0 then 14 else 10 end from de, {EIGHT_SQL}, inl a where a.x = de.x+dx and a.y = de.y+dy and de.cost + case when dx <> 0 and dy <> 0 then 14 else 10 end <= 150),
 dc as (select x, y, min(cost)::bigint as cost from de group by x, y), qs as (select x as sx, y as sz, x, y from inl), sd as ({seed_sql("qs", 5, "x, y")}),
 fb as materialized (select a.*, dc.cost, coalesce(dc.cost, 150)/10.0 as d, sd.seed, exists (select 1 from ce where ce.wx = a.x and ce.wy = a.y) as cliff from inl a left join dc on dc.x = a.x and dc.y = a.y join sd on sd.x = a.x and sd.y = a.y),
 bed as materialized (select *, case when cliff then least(elev_m, level-1) else level - case when d <= 5 then 1 when d <= 8 then 3 when d <= 10 then 4 else least(30, 3 + (seed%4+4)%4 + floor((d-10)/6)::bigint) end end::bigint as floor from fb),
 wide as (select comp from bed where not cliff group by comp having max(coalesce(cost, 150)) > 110),
 mb as (select a.x, a.y, floor(sum(b.floor)/count(*) + 0.5)::bigint as mean from bed a join bed b on b.comp = a.comp and abs(b.x-a.x) <= 1 and abs(b.y-a.y) <= 1 group by a.x, a.y),
 {_blend_sql("1", "false", 3)}, {_blend_sql("2", "true", 2)}"""


@query("water_region", oracle(f"+ {COMP}, {STATS}, {SPILL}, {SEEDS}, {FLAGS}, {OCEAN}, {REGION} select bed.x, bed.y, 1::bigint as kind, level as water, case when cost > 100 and not cliff and comp in (select comp from wide) then least(mean, level-1) else floor end::bigint as terrain from bed join mb on mb.x = bed.x and mb.y = bed.y union all select x, y, 2, level, least(elev_m, level-1) from wlv where is_ocean union all select x, y, 0, h, h from (select d.x, d.y, case when b2.h < d.elev_m then b2.h when b1.h < d.elev_m then b1.h else d.elev_m end as h from dry d left join b1 on b1.x = d.x and b1.y = d.y left join b2 on b2.x = d.x and b2.y = d.y)", "cells"))
def water_region(spark: SparkSession, d: str) -> DataFrame:
    """Kind, water level and ground of every cell, with rivers, cliffs, beds and lowered shores."""
    lab, comps = judged(spark, d)
    return wt.water_region(cells(spark, d), lab, comps, 128)


COLUMN = f"q as (select x, y, cover, elev_m, cover = 0 and elev_m <= 0 as oc, {CODE} as code from cells), sl as (select a.x, a.y, max(abs(b.elev_m - a.elev_m)) as slope from cells a join cells b on (b.x = a.x and abs(b.y - a.y) in (0, 4)) or (b.y = a.y and abs(b.x - a.x) = 4) group by all), kp as (select c.x, c.y, min(greatest(-30, b.base-1)) as cap from cells c join boxes b on c.x between b.min_x and b.max_x and c.y between b.min_y and b.max_y where b.kind <> 0 group by all)"


@query("column_table", oracle(f"+ {COLUMN} select q.x, q.y, least(elev_m, coalesce(cap, elev_m)) as height, case when coalesce(cap < elev_m, false) then 0 else slope end as slope, {CLASS.format(o='oc', w='false')} as class from q join sl on sl.x = q.x and sl.y = q.y left join kp on kp.x = q.x and kp.y = q.y", "cells", "boxes", "rules"))
def column_table(spark: SparkSession, d: str) -> DataFrame:
    """Height under box caps, slope and class of every column."""
    base = cells(spark, d)
    capped = r.apply_box_caps(base, fixture(spark, d, "boxes").filter("kind <> 0"), -30)
    kinds = base.select("x", "y", "cover", climate_code(C("koppen")).alias("climate"), ((C("cover") == 0) & (C("elev_m") <= 0)).alias("is_ocean"))
    named = capped.select("x", "y", "elev_m", "lowered").join(by_shuffle(m.classify(kinds, rules(spark)).select("x", "y", "class")), ["x", "y"])
    return named.join(by_shuffle(f.focal_slope(base)), ["x", "y"]).select("x", "y", C("elev_m").alias("height"), F.when(C("lowered"), 0).otherwise(C("slope")).cast("bigint").alias("slope"), "class")


PREVIEW = f"pv as (select x, y, elev_m, coalesce(lead(elev_m) over (partition by y order by x) - elev_m, 0) as dx, coalesce(lead(elev_m) over (partition by x order by y) - elev_m, 0) as dy from cells), pz as (select *, elev_m*1.0::double as v, -elev_m*1.0::double as m from pv)"


@query("preview_table", oracle(f"+ {PREVIEW} select x, y, elev_m - (select (min(elev_m) + max(elev_m)) / 2.0::double from cells) as centred, (case when v < 0 then {ramp_sql('m', s.SEA_RAMP)} else {ramp_sql('v', s.LAND_RAMP)} end)::bigint as color, floor((0.45+0.55*greatest(0, (dx/10.0::double*0.4+0.8+dy/10.0::double*0.4)/sqrt(dx/10.0::double*(dx/10.0::double)+dy/10.0::double*(dy/10.0::double)+1)/sqrt(0.96)))*8+0.5)/8 as shade from pz", "cells"))
def preview_table(spark: SparkSession, d: str) -> DataFrame:
    """Centred height, ramp colour and shade of every cell."""
    base = f.normalize(f.forward_diff(cells(spark, d)), "elev_m")
    return base.select("x", "y", "centred", s.ramp_color(C("elev_m") * 1.0).alias("color"), s.hillshade(C("dx") / 10.0, C("dy") / 10.0).alias("shade"))


@query("lod_table", oracle("+ rs as (select x, y, elev_m, first_value(cover) over (partition by x//4, y//4 order by cover <> 80, y, x) as cover from cells), qw as (select *, cover in (80, 95) or (cover = 0 and elev_m <= 0) as wet, cover = 0 and elev_m <= 0 as oc, greatest(elev_m+1, 0) as lv from rs), t as (select x, y, case when wet and not oc then least(elev_m, lv-25) else elev_m end as ground, case when wet then lv else elev_m end as level from qw) select x, y, 0::bigint as k, 0::bigint as lo, least(200, ground+64)::bigint as hi from t where ground+64 > 0 union all select x, y, 1, least(200, ground+64), least(200, greatest(ground, level)+64) from t where level > ground", "cells"))
def lod_table(spark: SparkSession, d: str) -> DataFrame:
    """Ground and water layers of every cell at a coarse cover."""
    cover = f.resample_stride(cells(spark, d), 4, "cover", C("cover") == 80)
    quick = cover.join(by_shuffle(cells(spark, d).select("x", "y", "elev_m")), ["x", "y"]).select("x", "y", s.quick_water(C("cover"), C("elev_m")).alias("q"))
    layers = F.array(F.struct(F.lit(0).cast("bigint").alias("k"), (C("q.terrain") + 64).alias("h")), F.struct(F.lit(1).cast("bigint").alias("k"), (C("q.water") - C("q.terrain")).alias("h")))
    return w.stack_layers(quick.select("x", "y", F.explode(layers).alias("l")).select("x", "y", "l.*"), ["x", "y"], "k", "h", 200).select("x", "y", "k", "lo", "hi")


SQUARES = f"{SITES}, pw as (select level, 1::bigint << level as side from (select unnest(range(1, 5)) as level)), cl as (select c.*, s.site_id from cells c left join s on s.sx = c.x and s.sz = c.y), gr as (select level, x//side as x0, y//side as y0, count(*) as cells, floor(sum(elev_m)/count(*))::bigint as elev_m, first(cover order by cover <> 80, y, x) as cover, first(koppen order by cover <> 80, y, x) as koppen, count(site_id) as n_sites, min(site_id) as site_id from cl, pw group by level, x0, y0), q as (select *, {CODE} as code, cover = 0 and elev_m <= 0 as oc, cover in (80, 95) or (cover = 0 and elev_m <= 0) as wet, greatest(elev_m+1, 0) as lv from gr)"


def squares(spark: SparkSession, d: str) -> DataFrame:
    """Four coarse levels of the cells, with the sites in their squares."""
    base = cells(spark, d)
    return lv.pyramid(base, 4, C("cover") == 80, ["cover", "koppen"], sites=sites(base, 8, 60, SALT))


@query("lod_levels", oracle(f"+ {SQUARES} select level, x0 as x, y0 as y, cells, elev_m, {CLASS.format(o='oc', w='false')} as class, n_sites, site_id::bigint as site_id from q", "cells", "rules"))
def lod_levels(spark: SparkSession, d: str) -> DataFrame:
    """Height, class and sites of the squares of every level."""
    kinds = squares(spark, d).withColumns({"climate": climate_code(C("koppen")), "is_ocean": (C("cover") == 0) & (C("elev_m") <= 0)})
    return m.classify(kinds, rules(spark)).select("level", "x", "y", "cells", "elev_m", "class", "n_sites", C("site_id").cast("bigint").alias("site_id"))


@query("lod_layers", oracle(f"+ {SQUARES}, t as (select level, x0 as x, y0 as y, case when wet and not oc then least(elev_m, lv-25) else elev_m end as ground, case when wet then lv else elev_m end as water from q) select level, x, y, 0::bigint as k, 0::bigint as lo, least(200, ground+64)::bigint as hi from t where ground+64 > 0 union all select level, x, y, 1, greatest(0, least(200, ground+64)), least(200, greatest(0, ground+64) + water - ground) from t where water > ground and least(200, greatest(0, ground+64) + water - ground) > least(200, greatest(0, ground+64))", "cells"))
def lod_layers(spark: SparkSession, d: str) -> DataFrame:
    """Ground and water layers of the squares of every level."""
    return lv.level_layers(squares(spark, d), 64, 200)


def _mix_sql(color: str, to: str, t: str) -> str:
    return "(" + " + ".join(f"floor((({color} >> {k}) & 255) + ((({to} >> {k}) & 255) - (({color} >> {k}) & 255))*({t}) + 0.5)::bigint*{1 << k}" for k in (16, 8, 0)) + ")"


COLORED = f"""nx as (select c.x, c.y, c.elev_m, coalesce(a.elev_m - c.elev_m, 0)/50.0::double as dx, coalesce(b.elev_m - c.elev_m, 0)/50.0::double as dy, first_value(c.cover) over (partition by c.x//4, c.y//4 order by c.y, c.x) as cover, first_value(c.koppen) over (partition by c.x//8, c.y//8 order by c.y, c.x) as koppen from cells c left join cells a on a.x = c.x+1 and a.y = c.y left join cells b on b.x = c.x and b.y = c.y+1),
 cc as (select *, {CODE} as code from nx), gp as (select *, case when left(code, 1) in ('A', 'B', 'C', 'D', 'E') then ascii(code) - 64 else 0 end as grp from cc),
 sh as (select *, case cover {" ".join(f"when {k} then {v}" for k, v in s.COVER_COLORS.items())} else {s.ROCK} end::bigint as base, case grp {TINT_SQL} end::bigint as tint, {SHARE_SQL} as share, greatest(abs(dx), abs(dy)) as slope, greatest(case when cover = 80 then 2 else 0 end, -elev_m)*1.0::double as deep from gp),
 ts as (select *, case when grp = {s.POLAR} and share > 0 then least({s.TINT_MOST}::double, share + {s.POLAR_MORE}::double) else share end as t, least(1.0::double, greatest(0.0::double, (slope-1.2)/1.6)) as steep from sh),
 td as (select *, case when t > 0 and tint is not null then {_mix_sql("base", "tint", "t")} else base end as tinted from ts)"""


@query("preview_colors", oracle(f"+ {COLORED} select x, y, (case when cover in (0, 80) then {ramp_sql('deep', s.DEPTH_RAMP)} when cover = 70 then base else {_mix_sql('tinted', str(s.ROCK), 'steep')} end)::bigint as color, floor((0.45+0.55*greatest(0, (dx*0.4+0.8+dy*0.4)/sqrt(dx*dx+dy*dy+1)/sqrt(0.96)))*8+0.5)/8 as shade from td", "cells"))
def preview_colors(spark: SparkSession, d: str) -> DataFrame:
    """Colour and shade of every cell: water by depth, land by cover, climate and slope."""
    return lv.preview(cells(spark, d), 50.0)
