"""Request streams. Every function takes a stream or a table with the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupStateTimeout

from geoloom.functions.project import clean_requests, lonlat_to_block
from geoloom.operators.ranges import k_ring
from geoloom.operators.sampling import sample_nearest
from geoloom.sources.tiles import TILE_KEY, missing_keys

C = F.col

#: What a store of tiles filled by streams holds beside its tiles: the stream's name and the batch that wrote them.
LEDGER = ["filler", "batch"]


def enrich(requests: DataFrame, surface: DataFrame, water: DataFrame, size: int, scale: float, low: int, high: int) -> DataFrame:
    """Clean requests with the height to arrive at: one above the ground or the water, inside the limits.

    ``surface`` and ``water`` are tile tables; on a stream this is a stream-static join.
    """
    x, z = lonlat_to_block(C("lon"), C("lat"), scale)
    placed = clean_requests(requests).withColumns({"x": x, "y": z})
    both = sample_nearest(sample_nearest(placed, surface, size, "_ground"), water, size, "_water")
    top = F.greatest(C("_ground"), C("_water")) + 1
    return both.withColumn("target", F.when(top.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), top)))).drop("_ground", "_water")


def debounce(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """(user_id, fired_at, text): the last text of each burst of a user's events that no event follows within ``gap``.

    A stream needs a watermark; bursts come out once it has passed their end.
    """
    timed = events.withColumn("ts", C("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", watermark) if watermark else timed
    bursts = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.max_by("text", F.struct("ts", "event_id")).alias("text"))
    return bursts.select("user_id", C("w.end").cast("timestamp_ntz").alias("fired_at"), "text").filter("text <> ''")


def latest_wins(results: DataFrame, key: str = "user_id", request: str = "event_id", ts: str | None = None, watermark: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """The result of the newest request of each key; rows without a request number are left out.

    With ``ts`` given, on a stream in update mode, a key is forgotten once the watermark is ``idle_ms`` past its last result, so state is
    bounded by the keys of that time. Requests of a key must be numbered in order of time, within the watermark's delay.
    """
    numbered = results.filter(C(request).isNotNull())
    if ts is None or not results.isStreaming:
        return numbered.groupBy(key).agg(F.max_by(F.struct(*results.columns), request).alias("r")).select("r.*")

    names = results.columns

    def newest(_key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        held, seen = state.get if state.exists else (None, 0)
        best = None
        for part in parts:
            top = part[request].idxmax()
            if held is None or part[request][top] > held:
                held, best = int(part[request][top]), part.loc[[top]]
            seen = max(seen, int(part["_ms"].max()))
        state.update((held, seen))
        state.setTimeoutTimestamp(max(seen + idle_ms, state.getCurrentWatermarkMs() + 1))
        if best is not None:
            yield best[names]

    timed = numbered.withColumn(ts, C(ts).cast("timestamp")).withWatermark(ts, watermark).withColumn("_ms", F.unix_millis(ts))
    return timed.groupBy(key).applyInPandasWithState(newest, timed.select(*names).schema, "held long, seen long", "update", GroupStateTimeout.EventTimeTimeout)


def tile_demand(requests: DataFrame, r: int, watermark: str | None = None) -> DataFrame:
    """Tiles (z, x, y) around the requested ones, each once; on a stream, once within the watermark."""
    if watermark is None:
        return k_ring(requests.select("z", "x", "y"), r)
    side = F.call_function("shiftleft", F.lit(1).cast("bigint"), C("z").cast("int")) - 1
    span = lambda c: F.explode(F.sequence(F.greatest(C(c) - r, F.lit(0)), F.least(C(c) + r, side)))
    timed = requests.withColumn("ts", C("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.select("ts", "z", span("x").alias("x"), "y").select("ts", "z", "x", span("y").alias("y")).dropDuplicatesWithinWatermark(["z", "x", "y"])


def read_store(spark, path: str) -> DataFrame | None:
    """The tiles (z, tx, ty, values, filler, batch) of a store that streams fill; None before the first tile."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "filler=*/batch=*/part-*"))
    if not files:
        return None
    return spark.read.option("basePath", path).parquet(path).withColumns({"filler": C("filler").cast("string"), "batch": C("batch").cast("bigint")})


def fill_batch(keys: DataFrame, batch: int, path: str, make: Callable[[DataFrame], DataFrame], filler: str) -> None:
    """Write the tiles of ``keys`` that no other batch has written; the batch's own earlier tiles are replaced.

    A batch's folder is the ledger's entry: it is overwritten as a whole, and what it holds isn't counted as had. So a batch that was
    cut off after its write, and comes again, writes the same tiles to the same place, and each tile is stored once.
    """
    wanted = keys.filter(" and ".join(f"{k} is not null" for k in TILE_KEY))
    have = read_store(keys.sparkSession, path)
    if have is not None:
        others = have.filter((C("filler") != filler) | (C("batch") != batch))
        wanted = missing_keys(wanted, others)
    made = make(wanted.select(*TILE_KEY).distinct())
    made.write.mode("overwrite").parquet(f"{path}/filler={filler}/batch={batch}")


def fill_store(demand: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], filler: str = "demand") -> DataStreamWriter:
    """The writer of a stream of wanted keys (z, tx, ty) that keeps a store of tiles filled: start it with its own checkpointLocation.

    ``make`` gives the tiles (z, tx, ty, values) of a table of keys. Streams that share a store need names (``filler``) of their own, as
    batches are numbered within a checkpoint; two of them may write a tile that both ask for at one time.
    """
    return demand.writeStream.foreachBatch(lambda keys, batch: fill_batch(keys, batch, path, make, filler))
