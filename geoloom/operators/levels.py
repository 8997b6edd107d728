"""Coarse levels of a raster, and its preview in colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import scalar as s
from geoloom.functions.constants import NO_COVER, SNOW_COVER, WATER_COVER
from geoloom.operators.focal import spread
from geoloom.operators.windows import stack_layers

C = F.col


def pyramid(cells: DataFrame, levels: int, prefer: Column, keep: list[str], height: str = "elev_m", sites: DataFrame | None = None) -> DataFrame:
    """(level, x, y, cells, height, *keep, n_sites, site_id): a row for each square of 2^level cells a side that holds any, levels 1 and up.

    A square takes ``keep`` from its first cell that ``prefer`` picks, in scan order, else from its first; the floor of its mean height; and how
    many ``sites`` (sx, sz, site_id) stand in it, with the least id. Each level is made from the one below, so all of them shuffle little
    more than the first, and a plan with all levels makes each of them once.
    """
    first = F.struct((~F.coalesce(prefer, F.lit(False))).alias("p"), C("y").alias("y"), C("x").alias("x"), *keep)
    base = cells.select("x", "y", first.alias("f"), F.lit(1).cast("bigint").alias("cells"), C(height).cast("bigint").alias("total"))
    if sites is None:
        base = base.withColumns({"n_sites": F.lit(0).cast("bigint"), "site_id": F.lit(None).cast("bigint")})
    else:
        here = sites.groupBy(C("sx").alias("x"), C("sz").alias("y")).agg(F.count("*").alias("n_sites"), F.min("site_id").alias("site_id"))
        base = base.join(here, ["x", "y"], "left").withColumn("n_sites", F.coalesce("n_sites", F.lit(0)).cast("bigint"))
    up = lambda below: below.groupBy(F.floor(C("x") / 2).alias("x"), F.floor(C("y") / 2).alias("y")).agg(F.min("f").alias("f"), F.sum("cells").alias("cells"), F.sum("total").alias("total"), F.sum("n_sites").alias("n_sites"), F.min("site_id").alias("site_id"))
    made = []
    for level in range(1, levels + 1):
        base = up(base)
        made.append(base.select(F.lit(level).cast("bigint").alias("level"), "x", "y", "cells", F.floor(C("total") / C("cells")).alias(height), *[C(f"f.{k}").alias(k) for k in keep], "n_sites", "site_id"))
    return reduce(DataFrame.unionAll, made)


def level_layers(squares: DataFrame, low: int, top: int, sea: int = 0, key: tuple[str, ...] = ("level", "x", "y")) -> DataFrame:
    """(key, k, lo, hi): layer 0 is the ground and 1 the water over it, by the one-pass estimate, from ``low`` below zero up to ``top``."""
    quick = squares.select(*key, s.quick_water(C("cover"), C("elev_m"), sea).alias("q"))
    layer = lambda k, h: F.struct(F.lit(k).cast("bigint").alias("k"), h.alias("h"))
    layers = F.array(layer(0, C("q.terrain") + low), layer(1, C("q.water") - C("q.terrain")))
    return stack_layers(quick.select(*key, F.explode(layers).alias("l")).select(*key, "l.*"), list(key), "k", "h", top).select(*key, "k", "lo", "hi")


#: Cells a side that share one cover and one climate in a preview, and the least depth of inland water.
COVER_STRIDE, CLIMATE_STRIDE, INLAND_DEPTH = 4, 8, 2


def preview(cells: DataFrame, step: float, sea: int = 0) -> DataFrame:
    """(x, y, color, shade): water by its depth, ice as it is, other covers tinted by climate, then towards rock where steep; a fixed light over all.

    ``cells`` (x, y, cover, koppen, elev_m) is a grid of samples ``step`` apart. Cover and climate are those of a square's first cell; a missing next cell counts as level.
    """
    sent = spread(cells.withColumn("_s", F.struct("elev_m", "cover", "koppen")), [(0, 0, 0), (1, 0, 1), (0, 1, 2)], "_s")
    at = lambda k: F.max(F.when(C("k") == k, C("v")))
    near = sent.groupBy("x", "y").agg(at(0).alias("s"), at(1).alias("right"), at(2).alias("down")).filter("s is not null")
    squares = lambda n: Window.partitionBy(F.floor(C("x") / n), F.floor(C("y") / n)).orderBy("y", "x").rowsBetween(Window.unboundedPreceding, 0)
    rise = lambda c: F.coalesce(C(f"{c}.elev_m") - C("s.elev_m"), F.lit(0)) / float(step)
    seen = near.select("x", "y", C("s.elev_m").alias("elev_m"), F.first("s.cover").over(squares(COVER_STRIDE)).alias("cover"), F.first("s.koppen").over(squares(CLIMATE_STRIDE)).alias("koppen"), rise("right").alias("dx"), rise("down").alias("dy"))
    # a column for each step, since every step reads the colour before it several times
    group = seen.withColumns({"_group": s.climate_group(s.climate_code(C("koppen"))), "_base": s.cover_color(C("cover")), "_slope": F.greatest(F.abs("dx"), F.abs("dy"))})
    tinted = group.withColumns({"_tinted": s.climate_tint(C("_base"), C("_group"), C("cover")), "_deep": F.greatest(F.when(C("cover") == WATER_COVER, INLAND_DEPTH).otherwise(0), sea - C("elev_m")) * 1.0})
    color = F.when(C("cover").isin(NO_COVER, WATER_COVER), s.depth_color(C("_deep"))).when(C("cover") == SNOW_COVER, C("_base")).otherwise(s.rock_tint(C("_tinted"), C("_slope")))
    return tinted.select("x", "y", color.cast("bigint").alias("color"), s.hillshade(C("dx"), C("dy")).alias("shade"))
