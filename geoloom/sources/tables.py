"""Rule tables, place lists and settings documents from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions.scalar import namespaced_id, upper_trim

#: Fields of a settings document and their defaults; sea_level has none and follows height_offset.
SETTINGS = (
    ("world_scale", "double", 35.0), ("terrestrial_height_scale", "double", 1.0), ("oceanic_height_scale", "double", 1.0), ("height_offset", "int", 64),
    ("spawn_latitude", "double", 27.9881), ("spawn_longitude", "double", 86.925), ("river_lake_shoreline_blend", "int", 5), ("ocean_shoreline_blend", "int", 5), ("shoreline_blend_cliff_limit", "boolean", True),
)


def clean_rules(raw: DataFrame, namespace: str) -> DataFrame:
    """cover, climate (null: fallback), class from text columns code, climate, class and a line number.

    Rows without a whole-number code or without a class go; NONE means fallback; of rows with one
    cover and climate the last wins.
    """
    rows = raw.select("line", F.trim("code").try_cast("int").alias("cover"), upper_trim(F.col("climate")).alias("climate"), F.trim("class").alias("class"))
    rows = rows.filter("cover is not null and class <> ''").withColumns({"climate": F.when(~F.col("climate").isin("NONE", ""), F.col("climate")), "class": namespaced_id(F.col("class"), namespace)})
    last = Window.partitionBy("cover", "climate").orderBy(F.desc("line"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("cover", "climate", "class")


def read_rules(spark: SparkSession, path: str, namespace: str = "base") -> DataFrame:
    """Rules of a CSV file: code, name, climate, quoted climate name, class; short rows go. Later rows of the file override earlier ones."""
    schema = "code string, name string, climate string, climate_name string, class string, _corrupt string"
    raw = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True)
    # splits are read in any order: a line's place is its file, its split's start and its order in the split
    lines = raw.withColumn("line", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()))
    return clean_rules(lines.filter("class is not null"), namespace)


def parse_places(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """Places of a JSON array column that have a name and whole coordinates."""
    one = F.explode(F.from_json(col, "array<struct<display_name string, lat string, lon string>>"))
    places = df.select(*keep, one.alias("p")).select(*keep, F.col("p.display_name").alias("display_name"), F.col("p.lat").try_cast("double").alias("lat"), F.col("p.lon").try_cast("double").alias("lon"))
    return places.filter("display_name is not null and lat is not null and lon is not null")


def parse_settings(col: Column) -> list[Column]:
    """Columns of a settings document, each with its default where the field is missing."""
    doc = F.from_json(col, ", ".join(f"{n} {t}" for n, t, _ in SETTINGS) + ", sea_level int")
    out = [F.coalesce(doc[n], F.lit(v)).alias(n) for n, _, v in SETTINGS]
    return [*out, F.coalesce(doc["sea_level"], doc["height_offset"], F.lit(64)).alias("sea_level")]
