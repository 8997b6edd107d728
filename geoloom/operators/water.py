"""Levels, beds and shores of all water, from labelled and judged components."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import scalar as s
from geoloom.operators.focal import smooth_bed
from geoloom.operators.graph import allocate, cliff_edges, is_river, shore_cells
from geoloom.operators.sampling import offsets
from geoloom.operators.storage import by_shuffle, drop_stored, stored

C = F.col
DRY, INLAND, OCEAN = 0, 1, 2
SIDES = [(1, 0), (-1, 0), (0, 1), (0, -1)]
#: A source carries its level below its number: levels lie within so many bits.
LEVEL_BITS = 20


@dataclass(frozen=True)
class WaterRules:
    """Lengths and distances are in cells."""

    sea: int = 0
    river_length: int = 20
    river_width: int = 16
    cliff: int = 5
    shore_limit: int = 15
    inland_blend: int = 3
    ocean_blend: int = 2
    blend_cliffs: bool = False


def water_cells(labelled: DataFrame, judged: DataFrame, rules: WaterRules) -> DataFrame:
    """(x, y, elev_m, comp, ocean, level) of labelled water. A river lies no higher than its highest cell; other water lies at its component's surface."""
    rivers = is_river(judged, rules.river_length, rules.river_width)
    level = F.when(C("is_ocean"), F.lit(rules.sea)).when(C("river"), s.river_surface(C("surface"), C("high"))).otherwise(C("surface")).cast("bigint")
    return labelled.select("x", "y", "elev_m", "comp").join(by_shuffle(rivers.select("comp", C("is_ocean").alias("ocean"), level.alias("level"))), "comp")


def blended(water: DataFrame, land: DataFrame, distance: int, width: int) -> DataFrame:
    """(x, y, h) of ``land`` (x, y, elev_m) that ``water`` (x, y, level) within ``distance`` lowers; of equally near water, the first in row-major order counts."""
    half = 1 << (LEVEL_BITS - 1)
    source = F.shiftleft(C("y") * width + C("x"), LEVEL_BITS) + C("level") + half
    beside = water.select(source.alias("source"), "x", "y", offsets(SIDES, "dx", "dy").alias("o")).select((C("x") + C("o.dx")).alias("x"), (C("y") + C("o.dy")).alias("y"), "source")
    shore = land.select("x", "y").join(by_shuffle(beside.groupBy("x", "y").agg(F.min("source").alias("source"))), ["x", "y"])
    level = F.pmod(C("source"), F.lit(1 << LEVEL_BITS)) - half
    near = allocate(land.select("x", "y"), shore, distance).join(by_shuffle(land), ["x", "y"])
    return near.select("x", "y", s.shore_blend(C("cost"), level, C("elev_m"), distance).alias("h"), "elev_m").filter("h < elev_m").drop("elev_m")


def water_region(cells: DataFrame, labelled: DataFrame, judged: DataFrame, width: int, rules: WaterRules | None = None, depth: Column | None = None) -> DataFrame:
    """(x, y, kind, water, terrain) of every cell: dry (0), inland (1) or ocean (2), its water level, and the ground or bed.

    ``cells`` (x, y, elev_m), ``labelled`` its water with comp, ``judged`` a row for each comp with is_ocean, surface and the component's statistics; ``width`` makes
    row-major numbers. Inland beds fall with the distance from inland shores; beds at cliffs and in the sea keep their
    height below the level; wide lakes are smoothed. Land near water is lowered towards inland water, then towards the sea, whose result counts where both do; land under a
    cliff is left alone unless ``blend_cliffs``. Each intermediate table that two steps read is stored once.
    """
    rules = rules or WaterRules()
    wet = stored(water_cells(labelled, judged, rules))
    dry = cells.select("x", "y", "elev_m").join(by_shuffle(wet.select("x", "y")), ["x", "y"], "left_anti")
    cliffs = stored(cliff_edges(wet, dry.withColumnRenamed("elev_m", "h"), rules.cliff))
    inland = wet.filter(~C("ocean"))
    shore = shore_cells(inland.select("x", "y")).select("x", "y", F.lit(0).cast("bigint").alias("source"))
    cost = allocate(inland.select("x", "y"), shore, rules.shore_limit).select("x", "y", "cost")
    edge = cliffs.filter("is_water").select("x", "y", F.lit(True).alias("_cliff"))
    placed = wet.join(by_shuffle(edge), ["x", "y"], "left").join(by_shuffle(cost), ["x", "y"], "left").withColumn("cliff", F.coalesce("_cliff", F.lit(False)))
    reached = F.coalesce("cost", F.lit(rules.shore_limit * 10))
    floor = s.water_floor(C("elev_m"), C("level"), C("ocean"), C("cliff"), s.inland_depth(reached / 10.0, C("x"), C("y")))
    beds = stored(placed.select("x", "y", "comp", "ocean", "level", "cliff", "cost", floor.alias("floor"), F.when(~C("cliff"), reached).alias("width")))
    smooth = smooth_bed(beds.filter(~C("ocean")).withColumnRenamed("level", "water"), width="width")
    lake = beds.filter(~C("ocean")).join(by_shuffle(smooth), ["x", "y"]).select("x", "y", F.lit(INLAND).alias("kind"), C("level").alias("water"), C("bed").alias("terrain"))
    sea = beds.filter("ocean").select("x", "y", F.lit(OCEAN).alias("kind"), C("level").alias("water"), C("floor").alias("terrain"))
    soft = dry if rules.blend_cliffs else dry.join(by_shuffle(cliffs.filter(~C("is_water")).select("x", "y")), ["x", "y"], "left_anti")
    soft = stored(soft)
    low = blended(inland, soft, rules.inland_blend, width).withColumnRenamed("h", "_inland") if rules.inland_blend > 0 else None
    lower = blended(wet.filter("ocean"), soft, rules.ocean_blend, width).withColumnRenamed("h", "_ocean") if rules.ocean_blend > 0 else None
    ground, heights = dry, [C("elev_m")]
    for name, table in (("_inland", low), ("_ocean", lower)):
        if table is not None:
            ground, heights = ground.join(by_shuffle(table), ["x", "y"], "left"), [C(name), *heights]
    height = F.coalesce(*heights).cast("bigint")
    shores = ground.select("x", "y", F.lit(DRY).alias("kind"), height.alias("water"), height.alias("terrain"))
    out = stored(lake.union(sea).union(shores).withColumn("kind", C("kind").cast("bigint")))
    for table in (wet, cliffs, beds, soft):
        drop_stored(table)
    return out
