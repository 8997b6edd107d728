"""Joins of points with rasters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.constants import MANGROVE_COVER, NO_COVER, SNOW_COVER, WATER_COVER
from geoloom.functions.scalar import upper_trim
from geoloom.operators.storage import by_shuffle

C = F.col


def sample_nearest(points: DataFrame, tiles: DataFrame, size: int, out: str = "v", px: str = "x", py: str = "y") -> DataFrame:
    """Points with the value of their pixel; null outside and where a tile is missing."""
    keyed = points.withColumns({"_tx": F.floor(C(px) / size), "_ty": F.floor(C(py) / size), "_i": (F.pmod(F.floor(px), F.lit(size)) + F.pmod(F.floor(py), F.lit(size)) * size + 1).cast("int")})
    found = keyed.join(by_shuffle(tiles.select(C("tx").alias("_tx"), C("ty").alias("_ty"), C("values").alias("_values"))), ["_tx", "_ty"], "left")
    return found.withColumn(out, F.try_element_at("_values", "_i")).drop("_tx", "_ty", "_i", "_values")


def sample_bilinear(points: DataFrame, cells: DataFrame, size: int, width: int, height: int, key: str = "point_id", px: str = "px", py: str = "py", value: str = "v") -> DataFrame:
    """(key, value): four corner pixels weighed; if a corner is missing, corners inside the base tile.

    One join fetches the corners of both forms; points without a base pixel have null. Rows that
    repeat a key have a row each.
    """
    x0, y0 = F.floor(px), F.floor(py)
    each = points.groupBy(key, px, py).agg(F.count("*").alias("_n"))
    base = each.select(key, C(px).alias("_px"), C(py).alias("_py"), "_n", x0.alias("_x0"), y0.alias("_y0"), (C(px) - x0).alias("_u"), (C(py) - y0).alias("_v"))
    own = [key, "_px", "_py", "_n"]
    corners = []
    for dx in (0, 1):
        for dy in (0, 1):
            w = (C("_u") if dx else 1 - C("_u")) * (C("_v") if dy else 1 - C("_v"))
            edge = lambda c, n, d: F.least(c + d, F.lit(n - 1))
            tile = lambda c, d: F.least(c + d, F.floor(c / size) * size + size - 1)
            corners.append(F.struct(F.lit(True).alias("wide"), edge(C("_x0"), width, dx).alias("x"), edge(C("_y0"), height, dy).alias("y"), w.alias("w")))
            corners.append(F.struct(F.lit(False).alias("wide"), F.least(tile(C("_x0"), dx), F.lit(width - 1)).alias("x"), F.least(tile(C("_y0"), dy), F.lit(height - 1)).alias("y"), w.alias("w")))
    wanted = base.select(*own, F.explode(F.array(*corners)).alias("c")).select(*own, "c.*")
    got = wanted.join(by_shuffle(cells.select("x", "y", C(value).alias("_value"))), ["x", "y"], "left")
    sums = got.groupBy(*own).agg(*[f for wide in (True, False) for f in (F.sum(F.when(C("wide") == wide, C("w") * C("_value"))).alias(f"s{wide}"), F.count(F.when(C("wide") == wide, C("_value"))).alias(f"n{wide}"))])
    value = F.when(C("nTrue") == 4, C("sTrue")).when(C("nFalse") == 4, C("sFalse")).alias("value")
    return sums.select(key, value, F.explode(F.sequence(F.lit(1).cast("bigint"), "_n"))).select(key, "value")


def sample_pyramid(points: DataFrame, fine: DataFrame, coarse: DataFrame, size: int, factor: int, ocean: Column) -> DataFrame:
    """Elevation from the fine tiles, the coarse tiles (``factor`` pixels to one) where those have none or the sea lies, else 0."""
    both = sample_nearest(points, fine, size, "_fine")
    both = sample_nearest(both.withColumns({"_cx": F.floor(C("x") / factor), "_cy": F.floor(C("y") / factor)}), coarse, size, "_coarse", "_cx", "_cy")
    value = F.when(ocean & (F.coalesce("_fine", F.lit(0)) <= 0), F.coalesce("_coarse", "_fine")).otherwise(F.coalesce("_fine", "_coarse"))
    return both.withColumn("elevation", F.coalesce(value.cast("double"), F.lit(0.0))).drop("_fine", "_coarse", "_cx", "_cy")


def sample_tristate(points: DataFrame, tiles: DataFrame, size: int, in_range: Column) -> DataFrame:
    """Land flag: null out of range, false where no tile is listed, else whether the pixel is positive."""
    keyed = points.withColumns({"_tx": F.floor(C("x") / size), "_ty": F.floor(C("y") / size), "_i": (F.pmod("x", F.lit(size)) + F.pmod("y", F.lit(size)) * size + 1).cast("int")})
    found = keyed.join(by_shuffle(tiles.select(C("tx").alias("_tx"), C("ty").alias("_ty"), C("values").alias("_values"), F.lit(True).alias("_listed"))), ["_tx", "_ty"], "left")
    land = F.when(~in_range, F.lit(None).cast("boolean")).when(C("_listed").isNull(), F.lit(False)).otherwise(F.coalesce(F.try_element_at("_values", "_i") > 0, F.lit(False)))
    return found.withColumn("is_land", land).drop("_tx", "_ty", "_i", "_values", "_listed")


def classify(df: DataFrame, rules: DataFrame, default: str = "plains", snow: str = "ice", mangrove: str = "mangrove", ocean: str = "ocean", river: str = "river") -> DataFrame:
    """Adds class: water first, then constants, the exact rule, the cover's fallback, the default.

    ``df`` has cover, climate and, if wanted, is_ocean and is_water. The rule table is a short list
    for people to write; Spark broadcasts it while it is under its own threshold.
    """
    exact = rules.filter("climate is not null").select(C("cover").cast("int").alias("_c"), upper_trim(C("climate")).alias("_k"), C("class").alias("_exact"))
    fallback = rules.filter("climate is null").select(C("cover").cast("int").alias("_c2"), C("class").alias("_fallback"))
    out = df.withColumn("_up", upper_trim(C("climate"))).join(exact, (C("cover") == C("_c")) & (C("_up") == C("_k")), "left").join(fallback, C("cover") == C("_c2"), "left")
    flag = lambda c: C(c) if c in df.columns else F.lit(False)
    name = F.when(flag("is_ocean"), ocean).when(flag("is_water") | (C("cover") == WATER_COVER), river).when(C("cover") == SNOW_COVER, snow).when(C("cover") == MANGROVE_COVER, mangrove)
    return out.withColumn("class", name.otherwise(F.coalesce("_exact", "_fallback", F.lit(default)))).drop("_up", "_c", "_k", "_exact", "_c2", "_fallback")


def disk(r: int) -> list[tuple[int, int, int, int]]:
    """(dx, dy, squared distance, scan order) of the pixels within r."""
    all_ = [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    return [(dx, dy, dx * dx + dy * dy, k) for k, (dx, dy) in enumerate(all_) if dx * dx + dy * dy <= r * r]


def radius_px(meters: float, px_m: float) -> int:
    return max(1, math.ceil(meters / px_m))


def offsets(table: list[tuple[int, ...]], *names: str) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in table]))


#: Least side of the blocks in which nearest pixels are searched.
SEARCH_BLOCK = 256


def nearest_in_rows(px: np.ndarray, py: np.ndarray, cx: np.ndarray, cy: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each point, the place of its nearest cell within r (-1: none), the squared distance, and the scan order in the disk.

    Cells are sorted by row and column. A row's nearest cells on either side of a point are found by one search, so a point takes time in
    proportion to r, not to the disk. Rows come in scan order and the left side first, so the first of equally near cells stays.
    """
    side = int(max(px.max(), cx.max()) - min(px.min(), cx.min())) + 2 * r + 2
    left, top = min(px.min(), cx.min()) - r, min(py.min() - r, cy.min())
    keys = (cy - top) * side + (cx - left)
    best, at, k = np.full(len(px), r * r + 1), np.full(len(px), -1), np.zeros(len(px), np.int64)
    for dy in range(-r, r + 1):
        aim = (py + dy - top) * side + (px - left)
        here = np.searchsorted(keys, aim)  # the first cell at or after the point
        for found in (here - 1, here):
            ok = (found >= 0) & (found < len(keys))
            cell = np.where(ok, found, 0)
            dx = cx[cell] - px
            d = dx * dx + dy * dy
            nearer = ok & (cy[cell] == py + dy) & (d < best)
            best, at = np.where(nearer, d, best), np.where(nearer, cell, at)
            k = np.where(nearer, (dy + r) * (2 * r + 1) + dx + r, k)
    return at, best, k


def nearest_valid(points: DataFrame, cells: DataFrame, r: int, value: str = "v", key: str = "point_id") -> DataFrame:
    """(key, value): the nearest pixel within r that isn't 0; the first in scan order of those as near.

    A task gets the different places asked for in a block and the valid pixels of the block and r around it; blocks without points get none.
    """
    block = max(SEARCH_BLOCK, 2 * r)
    places = points.select(C("x").cast("bigint").alias("x"), C("y").cast("bigint").alias("y")).filter("x is not null and y is not null").distinct()
    own = places.withColumns({"bx": F.floor(C("x") / block), "by": F.floor(C("y") / block)})
    span = lambda c: F.explode(F.sequence(F.floor((C(c) - r) / block), F.floor((C(c) + r) / block)))
    valid = cells.filter(C(value) != 0).select(C("x").cast("bigint").alias("x"), C("y").cast("bigint").alias("y"), C(value).alias("_v"))
    around = valid.select("*", span("x").alias("bx")).select("*", span("y").alias("by")).join(own.select("bx", "by").distinct(), ["bx", "by"], "left_semi")

    def search(asked: pa.Table, there: pa.Table) -> pa.Table:
        there = there.sort_by([("y", "ascending"), ("x", "ascending")])
        px, py = (asked[c].to_numpy() for c in "xy")
        if len(there) and len(asked):
            at, d, k = nearest_in_rows(px, py, *(there[c].to_numpy() for c in "xy"), r)
        else:
            at, d, k = (np.full(len(px), -1) for _ in range(3))
        hit = at >= 0
        return pa.table({"x": px[hit], "y": py[hit], "_v": there["_v"].take(pa.array(at[hit], pa.int64())), "_d": d[hit], "_k": k[hit]})

    kind = valid.schema["_v"].dataType.simpleString()
    near = own.groupBy("bx", "by").cogroup(around.groupBy("bx", "by")).applyInArrow(search, f"x long, y long, _v {kind}, _d long, _k long")
    best = points.select(key, "x", "y").join(by_shuffle(near), ["x", "y"]).groupBy(key).agg(F.min_by("_v", F.struct("_d", "_k")).alias("value"))
    return points.select(key).distinct().join(best, key, "left")


def overlay(points: DataFrame, layers: dict[str, DataFrame], size: int) -> DataFrame:
    """Points with one column per raster layer."""
    for name, tiles in layers.items():
        points = sample_nearest(points, tiles, size, name)
    return points


def climate_or_nearest(points: DataFrame, cells: DataFrame, r: int, code: str = "koppen", key: str = "point_id") -> DataFrame:
    """Points whose code is 0 or missing take the nearest code within r; the others aren't searched for."""
    gaps = nearest_valid(points.filter(F.coalesce(C(code), F.lit(NO_COVER)) == 0), cells, r, code, key)
    return points.join(gaps.withColumnRenamed("value", "_near"), key, "left").withColumn(code, F.when(F.coalesce(C(code), F.lit(0)) == 0, C("_near")).otherwise(C(code))).drop("_near")


def first_source(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
