"""Ordered operators: runs, decoding of deltas and row filters, stacking, ranks and set algebra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def runs_along_axis(df: DataFrame, part: list[str], order: str, flag: Column, least: int = 5) -> DataFrame:
    """(part, start, end, length) of the longest stretches of flagged consecutive rows, from ``least`` rows on."""
    on = df.filter(flag)
    grouped = on.withColumn("_g", C(order) - F.row_number().over(Window.partitionBy(*part).orderBy(order)))
    out = grouped.groupBy(*part, "_g").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length"))
    return out.filter(C("length") >= least).drop("_g")


def wrap16(c: Column) -> Column:
    return F.pmod(c + 32768, F.lit(65536)) - 32768


def undo_left(df: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    """Running sums of deltas, wrapped to 16 bits; the same for columns undoes the upward filter."""
    total = F.sum(value).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(value, wrap16(total))


def undo_chunk_filter(df: DataFrame, kind: str, key: str, width: int) -> DataFrame:
    """Undo the average or paeth filter of whole chunks (key, i row-major, v); each value needs its neighbours' results.

    Values of a diagonal depend on earlier diagonals only, so each is undone at once.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        stored = rows["v"].to_numpy(np.int64).reshape(-1, width)
        grid = np.zeros((stored.shape[0] + 1, width + 1), np.int64)  # a row and a column of zeros before the first ones
        for d in range(stored.shape[0] + width - 1):
            y = np.arange(max(0, d - width + 1), min(d + 1, stored.shape[0]))
            x = d - y
            left, up, corner = grid[y + 1, x], grid[y, x + 1], grid[y, x]
            if kind == "average":
                base = np.fix((left + up) / 2).astype(np.int64)
            else:
                near = np.stack([left, up, corner])
                base = near[np.abs(left + up - corner - near).argmin(axis=0), np.arange(len(y))]
            grid[y + 1, x + 1] = (stored[y, x] + base + 32768) % 65536 - 32768
        return rows.assign(v=grid[1:, 1:].ravel())

    return df.groupBy(key).applyInPandas(run, df.schema)


def decode_directory(df: DataFrame, part: list[str], order: str) -> DataFrame:
    """(tile_id, offset) from deltas and stored offsets, where a stored 0 goes on after the entry before.

    Each part is one archive directory, which a reader holds whole.
    """
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"tile_id": F.sum("delta").over(upto), "_island": F.sum((C("stored_offset") != 0).cast("long")).over(upto)})
    inside = Window.partitionBy(*part, "_island").orderBy(order)
    before = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.first("stored_offset").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return out.withColumn("offset", start + before).drop("_island")


def stack_layers(df: DataFrame, key: list[str], order: str, height: str, top: int) -> DataFrame:
    """(key, order, lo, hi) of ordered layers, each on the one below, none of no height, held under ``top``."""
    upto = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.greatest(C(height), F.lit(0))).over(upto)
    out = df.withColumns({"hi": F.least(F.lit(top), total), "lo": F.least(F.lit(top), total - F.greatest(C(height), F.lit(0)))})
    return out.filter("hi > lo")


def nth_smallest(df: DataFrame, key: list[str], value: str, k: int) -> DataFrame:
    """(key, value): the k-th smallest, from counts of equal values."""
    counts = df.groupBy(*key, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*key).orderBy(value))
    return counts.withColumn("_u", upto).filter(C("_u") >= k).groupBy(*key).agg(F.min(value).alias(value))


def top_places(places: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best places of each query (q_id, text): names that start with it, then shorter, then by name and id.

    Each different text is answered once, lower-cased, from a table of k places for each prefix; queries then look their text up. Every
    task keeps k places of a prefix before they meet (Spark's window group limit), so a prefix of half of all names isn't one task.
    An empty text finds nothing.
    """
    wanted = queries.select(F.lower("text").alias("_p")).filter("_p <> ''").distinct()
    longest = wanted.agg(F.max(F.length("_p"))).first()[0] or 0
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(longest))), lambda n: F.substring(F.lower("name"), F.lit(1), n)))
    named = places.filter(F.length("name") > 0).select("place_id", "name", prefixes.alias("_p")).join(wanted, "_p", "left_semi")
    order = Window.partitionBy("_p").orderBy(F.length("name"), "name", "place_id")
    table = named.withColumn("rank", F.row_number().over(order)).filter(C("rank") <= k)
    return queries.select("q_id", F.lower("text").alias("_p")).join(table, "_p").select("q_id", "rank", "place_id", "name")


def order_tiles(df: DataFrame) -> DataFrame:
    return df.orderBy("z", "x", "y")


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x", "y").union(b.select("x", "y")).distinct()


def mask_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x", "y").join(b.select("x", "y"), ["x", "y"], "left_anti")


def mask_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x", "y").intersect(b.select("x", "y"))
