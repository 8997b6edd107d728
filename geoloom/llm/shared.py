"""Tables in the shared folder, and numpy views of Arrow text columns."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's own setting.

    Only a local master, where all tasks run in this process, may go without the setting.
    """
    found = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


_shipped: set[str] = set()


#: Bytes of text in one Arrow batch; Python cuts texts to chunks of about a megabyte anyway.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, as ``--py-files`` would, once for each application, and keep Arrow batches of long texts small."""
    if not spark.sparkContext.getConf().contains(BATCH_KEY):  # an application's own setting stays
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parents[1]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}-package", "zip", package.parent, package.name))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back; cuts the lineage.

    Nothing reads the shuffles behind it again, so Spark removes their files after the write.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    spare_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Share of the driver's heap limit that it may hold before ``spare_driver`` collects it.
HELD_HEAP = 0.6
#: Bytes in use after the last collection by ``spare_driver``, by application.
_live: dict[str, int] = {}


def trim_python() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(trim := ctypes.CDLL(None), "malloc_trim"):
        trim.malloc_trim(0)


def trim_jvm(spark: SparkSession) -> None:
    """The same for the driver's JVM, by its own command, which Java has on Linux since 17.0.9; other JVMs keep the memory."""
    jvm = spark.sparkContext._jvm
    # py4j doesn't see the methods of the server's own class, which no package exports, but those of its interface
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)  # the last two: no arguments of no types
    with suppress(Py4JError):
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def spare_driver(spark: SparkSession) -> None:
    """Give memory that the driver has freed back to the system.

    Plans, their compilation and broadcasts leave heap and native memory that the JVM keeps for itself, up to several times what is in use. The heap is
    collected where it has grown over ``HELD_HEAP`` of its limit and at most half of it was in use the last time.
    """
    heap, app = spark.sparkContext._jvm.java.lang.Runtime.getRuntime(), spark.sparkContext.applicationId
    held = heap.totalMemory()
    if held > HELD_HEAP * heap.maxMemory() and 2 * _live.get(app, 0) <= held:
        spark.sparkContext._jvm.java.lang.System.gc()
        _live[app] = heap.totalMemory() - heap.freeMemory()
    trim_jvm(spark)
    trim_python()


def unstage(df: DataFrame) -> None:
    """Delete the files of a table that ``stage`` wrote and nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Tables of a few short columns are broadcast up to so many rows, tables of lists or texts also up to so many bytes; beyond, they are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def is_few(n: int, size: int = 0) -> bool:
    """Whether ``n`` rows, of ``size`` bytes together where their width isn't fixed, may be broadcast."""
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def few(rows: DataFrame, n: int, size: int = 0) -> DataFrame:
    """The rows, broadcast if they are few."""
    return F.broadcast(rows) if is_few(n, size) else rows


def extent(rows: DataFrame, width: Column) -> tuple[int, int]:
    """How many rows there are, and the sum of their ``width``."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0)).cast("long")).first()
    return n, size


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name in taken:
        name = f"_{name}"
    return name


#: Keys with more than this share of all rows are salted, if they have over LEAST_HEAVY rows. There can't be more than HEAVY of them.
HEAVY, LEAST_HEAVY = 4096, 256


def heavy_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, by: str | list[str], how: str = "inner") -> DataFrame:
    """Join on column ``key``, rows of heavy keys dealt out by the columns ``by``, which must tell a key's rows apart, and met by copies of their key's few right rows.

    ``counts`` has key and n, the left rows of each key. Null keys meet nothing.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(total // HEAVY, LEAST_HEAVY)
    heavy = counts.filter(F.col("n") > most).select(F.col(key).alias("_heavy"), F.ceil(F.col("n") / most).cast("int").alias("_salts"))
    heavy = F.broadcast(stage(heavy, "heavy-keys"))  # up to HEAVY rows
    salts = F.coalesce("_salts", F.lit(1))
    near = left.join(heavy, F.col(key) == F.col("_heavy"), "left").withColumn("_salt", F.pmod(F.xxhash64(*([by] if isinstance(by, str) else by)), salts).cast("int")).drop("_heavy", "_salts")
    far = right.join(heavy, F.col(key) == F.col("_heavy"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_heavy", "_salts")
    return near.join(far, [key, "_salt"], how).drop("_salt")


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving the memory it freed, and the table of powers, back to the system at its task's end, as Python workers live on for other stages."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _powers[:] = np.ones((2, 1), np.uint64)
            trim_python()

    return inner


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, true for the byte values of the closed ranges."""
    flags = np.zeros(256, dtype=bool)
    for low, high in ranges:
        flags[low : high + 1] = True
    return flags


#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` in lower-cased UTF-8 text.
LETTERS_DIGITS = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of ``[^\x20\x09-\x0D]``.
NOT_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def unsliced(column: pa.Array) -> pa.Array:
    """The texts as a string array of its own; null counts as empty. Arrow's ``ascii_lower`` misreads slices of longer arrays."""
    raw, at = text_bytes(column)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(at.copy()), pa.py_buffer(raw))


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``max_bytes`` of text, or one longer row."""
    for batch in batches:
        _, at = text_bytes(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(at, at[begin] + max_bytes, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that end where a group of equal ``key`` ends, from batches sorted by it."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        split = int(np.searchsorted(keys, keys[-1]))
        if left and (split or left[-1].column(key)[-1].as_py() != keys[-1]):
            yield pa.Table.from_batches([*left, batch.slice(0, split)])
            left = []
        elif split:
            yield pa.Table.from_batches([batch.slice(0, split)])
        left.append(batch.slice(split))
    if left:
        yield pa.Table.from_batches(left)


def word_bounds(raw: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (maximal run of ``member`` bytes within a text), and words per text."""
    inside = member[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    before = np.empty(len(raw), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


def cut(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ascending, disjoint byte ranges as an Arrow string array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    step = np.zeros(len(raw) + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1
    data = raw[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each range of length n, end to end."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def merged(keys: Iterable[np.ndarray], numbers: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and the sum of each one's numbers."""
    keys, numbers = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *numbers])
    by = np.argsort(keys, kind="stable")
    keys, numbers = keys[by], numbers[by]
    lead = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[lead], np.add.reduceat(numbers, lead) if len(lead) else numbers


ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse, modulo 2 ** 64, for i up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((ODD, INVERSE)):
            row = np.full(n + 1, np.uint64(base))
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]
