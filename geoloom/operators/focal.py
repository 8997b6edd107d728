"""Neighbourhood and zonal aggregates over cell tables (x, y, value)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.constants import NO_COVER, WATER_COVER
from geoloom.operators.sampling import offsets
from geoloom.operators.storage import by_shuffle

C = F.col
SQUARE = [(dx, dy, k) for k, (dy, dx) in enumerate((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1))]


def spread(cells: DataFrame, table: list[tuple[int, ...]], value: str) -> DataFrame:
    """(x, y, v, k, here): each value sent to the cells that see it; k is its place in their scan order.

    Sending values needs one shuffle, by the cell that receives, and no second copy of the cells.
    """
    sent = cells.select("x", "y", C(value).alias("v"), offsets([t[:2] + (t[-1],) for t in table], "dx", "dy", "k").alias("o"))
    return sent.select((C("x") - C("o.dx")).alias("x"), (C("y") - C("o.dy")).alias("y"), "v", "o.k", ((C("o.dx") == 0) & (C("o.dy") == 0)).alias("here"))


def focal_majority(cells: DataFrame, value: str = "cover") -> DataFrame:
    """Most frequent class of the 3x3 square; water and no data keep themselves and don't vote.

    Of equally frequent classes the centre's wins, else the one met first in rows, then columns.
    """
    seen = spread(cells, SQUARE, value)
    votes = seen.groupBy("x", "y", "v").agg(F.count("*").alias("n"), F.min("k").alias("k"), F.bool_or("here").alias("here"))
    dull = C("v").isin(NO_COVER, WATER_COVER)
    rank = F.struct(F.when(dull, 0).otherwise(C("n")).alias("n"), C("here").alias("here"), (-C("k")).alias("k"))
    out = votes.groupBy("x", "y").agg(F.max_by("v", rank).alias("best"), F.max(F.when(C("here"), C("v"))).alias("own"))
    return out.filter("own is not null").select("x", "y", F.when(C("own").isin(NO_COVER, WATER_COVER), C("own")).otherwise(C("best")).alias(value))


#: Least side of the blocks whose neighbourhoods one task counts.
COUNT_BLOCK = 256


def class_counts(x: np.ndarray, y: np.ndarray, codes: np.ndarray, k: int, r: int, round_: bool):
    """For each class 0 to k - 1: how often it stands around every place of the cells' box, and how often at the place itself.

    Running counts along a row give any stretch of it by one difference, so a square costs each cell the same for any radius
    (its rows are summed the same way), and a disk one difference for each of its rows.
    """
    x, y = x - x.min() + r, y - y.min() + r
    high, wide = int(y.max()) + r + 1, int(x.max()) + r + 1
    for code in range(k):
        here = np.zeros((high, wide), np.int32)
        mine = codes == code
        np.add.at(here, (y[mine], x[mine]), 1)
        run = np.zeros((high, wide + 1), np.int32)
        np.cumsum(here, axis=1, out=run[:, 1:])
        if round_:
            around = np.zeros((high - 2 * r, wide - 2 * r), np.int32)
            for dy in range(-r, r + 1):
                half = math.isqrt(r * r - dy * dy)
                rows = run[r + dy : high - r + dy]
                around += rows[:, r + half + 1 : wide - r + half + 1] - rows[:, r - half : wide - r - half]
        else:
            rows = run[:, 2 * r + 1 :] - run[:, : wide - 2 * r]
            down = np.vstack([np.zeros((1, rows.shape[1]), np.int32), np.cumsum(rows, axis=0, dtype=np.int32)])
            around = down[2 * r + 1 :] - down[: high - 2 * r]
        yield around, here[r : high - r, r : wide - r]


def in_blocks(cells: DataFrame, r: int, value: str, block: int):
    """The cells (x, y, v) of each block and of r around it, grouped by block."""
    span = lambda c: F.explode(F.sequence(F.floor((C(c) - r) / block), F.floor((C(c) + r) / block)))
    at = cells.select(C("x").cast("bigint").alias("x"), C("y").cast("bigint").alias("y"), C(value).alias("v")).filter("x is not null and y is not null")
    return at.select("*", span("x").alias("bx")).select("*", span("y").alias("by")).groupBy("bx", "by")


def own_places(table: pa.Table, block: int) -> tuple[np.ndarray, ...]:
    """x and y of a group's rows, and the places in their box (row, column) of the different cells of the block itself."""
    x, y = table["x"].to_numpy(), table["y"].to_numpy()
    bx, by = table["bx"][0].as_py(), table["by"][0].as_py()
    own = (x // block == bx) & (y // block == by)
    at = np.unique(np.stack([y[own] - y.min(), x[own] - x.min()]), axis=1)
    return x, y, at[0], at[1]


def focal_mode(cells: DataFrame, r: int = 2, value: str = "koppen", legacy: bool = False, block: int = COUNT_BLOCK) -> DataFrame:
    """Most frequent non-zero code of the disk; of equals the centre's, else the lowest. None: null (``legacy``: 1).

    A task counts a block with r around it; nulls count as no code, repeated cells as often as they stand there.
    """
    block = max(block, 2 * r)
    kind = cells.schema[value].dataType.simpleString()

    def count(table: pa.Table) -> pa.Table:
        x, y, i, j = own_places(table, block)
        v = table["v"].combine_chunks()
        kinds = np.unique(v.drop_null().to_numpy(zero_copy_only=False))
        kinds = kinds[kinds != 0]
        filled = v.fill_null(0).to_numpy(zero_copy_only=False)
        codes = np.where(filled == 0, -1, np.searchsorted(kinds, filled))
        best, at_centre, which = np.zeros(len(i), np.int64), np.zeros(len(i), bool), np.full(len(i), -1)
        for code, (around, here) in enumerate(class_counts(x, y, codes, len(kinds), r, True)):
            n, centre = around[i, j], here[i, j] > 0
            more = (n > best) | ((n == best) & (n > 0) & centre & ~at_centre)  # codes rise, so the lowest of equals stays
            best, at_centre, which = np.where(more, n, best), np.where(more, centre, at_centre), np.where(more, code, which)
        mode = pa.array(kinds, v.type).take(pa.array(which, pa.int64(), mask=which < 0))
        return pa.table({"x": j + x.min(), "y": i + y.min(), value: mode})

    out = in_blocks(cells, r, value, block).applyInArrow(count, f"x long, y long, {value} {kind}")
    return out.withColumn(value, F.coalesce(value, F.lit(1)).cast(kind)) if legacy else out


def focal_histogram(cells: DataFrame, value: str = "cover", r: int = 1, block: int = COUNT_BLOCK) -> DataFrame:
    """(x, y, v, n): class counts of the square of each cell, r to every side; null is a class of its own."""
    block = max(block, 2 * r)
    kind = cells.schema[value].dataType.simpleString()

    def count(table: pa.Table) -> pa.Table:
        x, y, i, j = own_places(table, block)
        named = table["v"].combine_chunks().dictionary_encode("encode")
        codes = named.indices.to_numpy(zero_copy_only=False)
        parts = []
        for code, (around, _) in enumerate(class_counts(x, y, codes, len(named.dictionary), r, False)):
            n = around[i, j].astype(np.int64)
            some = n > 0
            which = np.full(int(some.sum()), code)
            parts.append(pa.table({"x": j[some] + x.min(), "y": i[some] + y.min(), "v": named.dictionary.take(pa.array(which)), "n": n[some]}))
        return pa.concat_tables(parts)

    return in_blocks(cells, r, value, block).applyInArrow(count, f"x long, y long, v {kind}, n long")


def focal_slope(cells: DataFrame, step: int = 4, value: str = "elev_m") -> DataFrame:
    """Greatest height difference to the four cells ``step`` away; a missing one counts as level."""
    four = [(step, 0, 0), (-step, 0, 0), (0, step, 0), (0, -step, 0), (0, 0, 1)]
    seen = spread(cells, four, value).groupBy("x", "y").agg(F.max(F.when(C("here"), C("v"))).alias("h"), F.max("v").alias("top"), F.min("v").alias("low"))
    return seen.filter("h is not null").select("x", "y", F.greatest(C("top") - C("h"), C("h") - C("low")).alias("slope"))


def coarsen_any(cells: DataFrame, size: int, flag: Column) -> DataFrame:
    return cells.groupBy(F.floor(C("x") / size).alias("cx"), F.floor(C("y") / size).alias("cy")).agg(F.bool_or(flag).alias("any_set"))


def normalize(df: DataFrame, col: str) -> DataFrame:
    """Adds centred: the value less the middle of its least and greatest value."""
    middle = df.agg(((F.min(col) + F.max(col)) / 2.0).alias("_mid"))
    return df.crossJoin(F.broadcast(middle)).withColumn("centred", C(col) - C("_mid")).drop("_mid")  # one row


def zonal(cells: DataFrame, size: int) -> DataFrame:
    """Per square of ``size``: cells, water cells, the dominant cover (of equals the lowest), heights."""
    at = [F.floor(C("x") / size).alias("cx"), F.floor(C("y") / size).alias("cy")]
    counts = cells.groupBy(*at, "cover").agg(F.count("*").alias("n"), F.min("elev_m").alias("low"), F.max("elev_m").alias("high"), F.sum("elev_m").alias("total"))
    return counts.groupBy("cx", "cy").agg(
        F.sum("n").alias("cells"), F.sum(F.when(C("cover") == WATER_COVER, C("n")).otherwise(0)).alias("water"),
        F.max_by("cover", F.struct("n", (-C("cover")).alias("c"))).alias("dominant"), F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("total") / F.sum("n")).alias("mean"),
    )


def gate_tiles(cells: DataFrame, size: int, flag: Column) -> DataFrame:
    """Tiles with any flagged cell."""
    return cells.filter(flag).select(F.floor(C("x") / size).alias("tx"), F.floor(C("y") / size).alias("ty")).distinct()


def resample_stride(cells: DataFrame, stride: int, value: str, prefer: Column | None = None) -> DataFrame:
    """Every cell takes the value of its block's first cell, or of the first that ``prefer`` picks."""
    at = {"_bx": F.floor(C("x") / stride), "_by": F.floor(C("y") / stride)}
    order = F.struct((~prefer if prefer is not None else F.lit(False)).alias("p"), C("y").alias("y"), C("x").alias("x"))
    placed = cells.withColumns(at)
    first = placed.groupBy("_bx", "_by").agg(F.min_by(value, order).alias("_v"))
    return placed.join(by_shuffle(first), ["_bx", "_by"]).select("x", "y", C("_v").alias(value))


def smooth_bed(cells: DataFrame, min_cost: int = 100, min_max_cost: int = 110, width: str = "cost") -> DataFrame:
    """(x, y, bed): deep cells of wide components take the rounded mean of themselves and their 8 neighbours in the component, held below the water.

    ``cells``: x, y, comp, cost, cliff, floor, water. A component is wide by its greatest ``width``; a cell without a cost isn't deep.
    """
    by_comp = cells.select("x", "y", C("comp"), C("floor"), offsets(SQUARE, "dx", "dy", "k").alias("o")).select((C("x") - C("o.dx")).alias("x"), (C("y") - C("o.dy")).alias("y"), "comp", "floor")
    means = by_comp.groupBy("x", "y", "comp").agg((F.sum("floor") / F.count("*")).alias("mean"))
    wide = cells.groupBy("comp").agg(F.max(width).alias("_most")).filter(C("_most") > min_max_cost).select("comp", F.lit(True).alias("_wide"))
    out = cells.join(by_shuffle(means), ["x", "y", "comp"]).join(wide, "comp", "left")
    deep = F.coalesce(C("cost") > min_cost, F.lit(False)) & ~C("cliff") & F.coalesce("_wide", F.lit(False))
    return out.select("x", "y", F.when(deep, F.least(F.floor(C("mean") + 0.5), C("water") - 1)).otherwise(C("floor")).cast("bigint").alias("bed"))


def forward_diff(cells: DataFrame, value: str = "elev_m") -> DataFrame:
    """Adds dx, dy: the next value along the row and the column less the own; 0 at the end."""
    along = lambda part, order: F.lead(value, 1).over(Window.partitionBy(part).orderBy(order))
    return cells.withColumns({"dx": F.coalesce(along("y", "x") - C(value), F.lit(0)), "dy": F.coalesce(along("x", "y") - C(value), F.lit(0))})
