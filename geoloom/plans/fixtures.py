"""Rasters, points, boxes and requests derived from the driver tables, in Spark and in DuckDB.

Each fixture is one SQL text for both engines; ``{D}`` stands for the integer division of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXTS: dict[str, tuple[str, str]] = {
    "cells": (
        "orders",
        """with b as (select o_orderkey % 128 as x, (o_orderkey {D} 128) as y from {T}),
e as (select x, y, case when x >= 120 and y % 64 < 60 then -40 + (x*7+y*13) % 5 when x in (60,61) and y % 97 < 80 then 12 + (y % 97) % 3
  else 4*abs(x%34-17) + 3*abs(y%22-11) - 24 + (x*7+y*13) % 5 end as elev_m from b)
select x, y, elev_m, case when x >= 120 and y % 64 < 60 then case when x >= 124 then 0 else 80 end when x in (60,61) and y % 97 < 80 then 80
 when elev_m <= 0 then 80 when ((x {D} 8)*7+(y {D} 8)*13)%11 = 0 then 70 when ((x {D} 8)*7+(y {D} 8)*13)%11 in (1,2,3) then 10
 when ((x {D} 8)*7+(y {D} 8)*13)%11 in (4,5) then 30 when ((x {D} 8)*7+(y {D} 8)*13)%11 = 6 then 40 when ((x {D} 8)*7+(y {D} 8)*13)%11 = 7 then 60
 when ((x {D} 8)*7+(y {D} 8)*13)%11 = 8 then 95 else 20 end as cover,
 case when ((x {D} 16)+(y {D} 16))%9 = 0 then 0 else 1 + ((x {D} 16)*5+(y {D} 16)*3)%30 end as koppen,
 case when (x+y) % 41 = 0 then null when x >= 120 and y % 64 < 60 then 0 else 1 end as land from e""",
    ),
    "points": (
        "customer",
        """select c_custkey as point_id, (c_custkey*37) % 128 as x, (c_custkey*10) {D} 128 as y, cast(((c_custkey*7919) % 36000) - 18000 as double) / cast(100 as double) as lon,
 cast(((c_custkey*104729) % 17000) - 8500 as double) / cast(100 as double) as lat, c_mktsegment as segment from {T}""",
    ),
    "boxes": (
        "supplier",
        """select s_suppkey as box_id, (s_suppkey*29) % 120 as min_x, (s_suppkey*29) % 120 + s_suppkey % 9 as max_x, s_suppkey as min_y, s_suppkey + s_suppkey % 7 as max_y,
 (s_suppkey*13) % 40 - 10 as base, s_suppkey % 3 as kind from {T}""",
    ),
    "dir": (
        "part",
        """select p_partkey as seq, cast(7 as bigint) as delta, case when p_partkey % 5 = 0 then 0 else 1 + p_partkey % 6 end as run_length, cast(100 + p_size as bigint) as length,
 case when p_partkey > 0 and p_partkey % 3 <> 0 then 0 else p_partkey*500 + 1 end as stored_offset from {T}""",
    ),
    "lookups": ("lineitem", "select l_orderkey as q_id, l_linenumber as q_line, l_partkey*7 + l_linenumber*2 as tile_id from {T}"),
    "reqs": (
        "events",
        """select event_id, ts, user_id, case when event_id % 97 = 0 then cast('NaN' as double) else cast(((event_id*104729) % 24000) - 12000 as double) / cast(100 as double) end as lat,
 cast(((event_id*7919) % 40000) - 20000 as double) / cast(100 as double) as lon, event_type as text from {T}""",
    ),
}

#: A short rule list for tests: cover, climate (null: fallback of the cover), class.
RULES = ((10, "AF", "rainforest"), (10, "CFB", "broadleaf"), (10, "DFC", "conifer"), (10, None, "woodland"), (20, "BSH", "dry_shrub"), (20, None, "shrub"), (30, "ET", "tundra_grass"), (30, "AW", "savanna"), (30, None, "grass"), (40, None, "crop"), (60, "BWH", "hot_desert"), (60, "BWK", "cold_desert"), (60, None, "bare"))


def _rules_sql() -> str:
    rows = ", ".join(f"({c}, {'null' if k is None else repr(k)}, {name!r})" for c, k, name in RULES)
    return f"select * from (values {rows}) as r(cover, climate, class)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, text = TEXTS[name]
    return spark.sql(text.replace("{D}", "div").replace("{T}", "{source}"), source=table(spark, sf_dir, source))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "cover int, climate string, class string")


def oracle(sql: str, *names: str) -> str:
    """DuckDB text in which the fixtures of those names are tables; ``sql`` may go on with further CTEs after ``+``."""
    parts = [f"{n} as ({TEXTS[n][1].replace('{D}', '//').replace('{T}', TEXTS[n][0])})" if n != "rules" else f"rules as ({_rules_sql()})" for n in names]
    head = "with recursive " + ", ".join(parts) if parts else ""
    sql = sql.strip()
    return f"{head}, {sql[1:]}" if sql.startswith("+") else f"{head} {sql}"
