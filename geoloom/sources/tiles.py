"""Tiled rasters as tables: a row per cell (x, y, v) or a row per tile (z, x, y, values, row-major)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE_KEY = ["z", "tx", "ty"]


def pack_tiles(cells: DataFrame, size: int, value: str | Column = "v", z: int = 0) -> DataFrame:
    """Tiles of size x size from cells; places without a cell are null, of repeated cells the greatest value stays.

    ``value`` may be a struct of several layers. Each tile is laid out in one pass over its sorted cells.
    """
    value = F.col(value) if isinstance(value, str) else value
    at = cells.select(F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty"), (F.pmod("x", F.lit(size)) + F.pmod("y", F.lit(size)) * size).cast("int").alias("i"), value.alias("v"))
    none = F.lit(None).cast(at.schema["v"].dataType)
    held = at.groupBy("tx", "ty").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m"))
    following = F.concat(F.slice(F.col("m.i"), 2, size * size * 2), F.array(F.lit(size * size)))
    place = lambda e, after: F.when(after == e["i"], F.slice(F.array(none), 1, 0)).otherwise(F.concat(F.array(e["v"]), F.array_repeat(none, after - e["i"] - 1)))
    values = F.flatten(F.concat(F.array(F.array_repeat(none, F.col("m")[0]["i"])), F.zip_with("m", following, place)))
    return held.select(F.lit(z).alias("z"), "tx", "ty", values.alias("values"))


def explode_tiles(tiles: DataFrame, size: int) -> DataFrame:
    """Cells that have a value, with their world positions."""
    cells = tiles.select("z", "tx", "ty", F.posexplode("values").alias("i", "v")).filter("v is not null")
    return cells.select("z", (F.col("tx") * size + F.col("i") % size).alias("x"), (F.col("ty") * size + F.floor(F.col("i") / size)).alias("y"), "v")


def read_tiles(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Tiles of a stored table, only those of ``keys`` if given; partitions of other zooms aren't read."""
    tiles = spark.read.parquet(path)
    return tiles if keys is None else tiles.join(keys.select(*TILE_KEY).distinct(), TILE_KEY, "left_semi")


def write_tiles(tiles: DataFrame, path: str, parts_per_zoom: int = 8) -> None:
    """Replace the zooms that ``tiles`` holds; each zoom's tiles are dealt over several files by key."""
    dealt = tiles.repartition("z", F.pmod(F.hash("tx", "ty"), F.lit(parts_per_zoom)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("z").parquet(path)


def missing_keys(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Requested keys that aren't stored, each once."""
    return wanted.select(*TILE_KEY).distinct().join(have.select(*TILE_KEY), TILE_KEY, "left_anti")


def crop(cells: DataFrame, x0: int, y0: int, size: int, margin: int = 0) -> DataFrame:
    """Cells inside a padded block's interior, at positions relative to it."""
    rel = cells.withColumns({"x": F.col("x") - (x0 + margin), "y": F.col("y") - (y0 + margin)})
    inner = size - 2 * margin
    return rel.filter(F.col("x").between(0, inner - 1) & F.col("y").between(0, inner - 1))
