"""Token ids in training order: a keyed permutation of sequence numbers, written as fixed-stride shards.

Texts are encoded by byte-level BPE. Sequences are numbered by the order of the input's own partitions. A Feistel network over the next
even power of two, walked along its cycle until it falls inside the range, sends each number to a
slot of its own. Slots are cut into ranges; each range is one shard file in which the record of
slot s starts at (s - first slot) * stride, so a reader resumes anywhere by seeking.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from geoloom.llm.byte_bpe import BETWEEN_ZEROS, LIBRARY_BYTES, PieceEncoder, count_ids, encode_texts, in_bulk, load
from geoloom.llm.shared import chunks, releasing, stage, text_bytes

ROUNDS = 6
CHUNK_BYTES = 8 << 20
#: Starts of up to so many input partitions are broadcast, about 100 bytes each; beyond, they are joined by shuffle.
BROADCAST_PARTS = 1_000_000
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values of splitmix64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def feistel(numbers: np.ndarray, size: int, key: int, inverse: bool = False) -> np.ndarray:
    """The permutation of range(size) for ``key``, or its inverse, at ``numbers``."""
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        keys = _mix(np.uint64(key & (2**64 - 1)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (_mix(right ^ k) & mask)
        return (left << half) | right

    out = once(np.asarray(numbers).astype(np.uint64))
    while (walk := out >= size).any():
        out[walk] = once(out[walk])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Tokens:
    """How texts become ids: the rank file and the width; the two ids after the vocabulary end a text and fill a sequence."""

    path: str
    dtype: str = "uint16"

    @property
    def end_id(self) -> int:
        return max(load(self.path).tokens) + 1

    @property
    def pad_id(self) -> int:
        return self.end_id + 1

    def encoder(self) -> PieceEncoder:
        short, long = library(self.path), load(self.path).encode
        return in_bulk(short, lambda piece: short._encode_single_piece(piece) if len(piece) <= LIBRARY_BYTES else long(piece))

    def count(self, column: pa.Array, encoder: PieceEncoder) -> int:
        """Number of ids of all texts, each followed by ``end_id``."""
        return count_ids(column, encoder) + len(column)

    def encode(self, column: pa.Array, encoder: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and the offset of each text and of the end."""
        ids, at = encode_texts(column, encoder)
        return np.insert(ids, at[1:], self.end_id).astype(self.dtype), at + np.arange(len(at))


@lru_cache(maxsize=4)
def library(path: str) -> tiktoken.Encoding:
    """The library's encoder of pieces."""
    return tiktoken.Encoding("pieces", pat_str=BETWEEN_ZEROS, mergeable_ranks=load(path).ranks, special_tokens={})


def sequence_rows(rows: DataFrame, tokens: Tokens, stride: int, count_only: bool) -> DataFrame:
    """(part, k, n, digest, data, doc_ids, starts): each input partition's sequences, and a last row (k null) with their number and the texts' digest.

    With ``count_only``, the last rows only.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    ids_kind = pa.int64()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if np.iinfo(tokens.dtype).max < tokens.pad_id:
            raise ValueError(f"{tokens.dtype} is too narrow for ids up to {tokens.pad_id}")
        part, done, digest = TaskContext.get().partitionId(), 0, hashlib.sha256()
        rest, owner = np.zeros(0, tokens.dtype), np.zeros(0, np.int64)  # ids of an unfinished sequence, and the row of each
        names: list = []  # doc_ids of the rows from ``first`` on
        first, seen, id_type, encoder = 0, 0, ids_kind, tokens.encoder()

        def sequences(ids: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
            nonlocal done
            n = len(ids) // stride
            place = np.arange(n * stride)
            begins = np.flatnonzero(np.append(True, of[1 : n * stride] != of[: n * stride - 1]) | (place % stride == 0)) if n else np.zeros(0, np.int64)
            edges = pa.array(np.searchsorted(begins, np.arange(n + 1) * stride).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, x) for x in (pa.array([names[i - first] for i in of[begins]], id_type), pa.array((begins % stride).astype(np.int32)))]
            data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * stride * ids.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
            done += n
            return batch_of(n, pa.array(np.arange(done - n, done)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), data, *lists)

        def batch_of(n: int, *columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, dtype=np.int64)), *columns], ["part", "k", "n", "digest", "data", "doc_ids", "starts"])

        for batch in chunks(batches, "text", CHUNK_BYTES):
            for piece in text_bytes(batch.column("text")):  # bytes and offsets decide the ids
                digest.update(piece.tobytes())
            id_type = batch.column("doc_id").type
            if count_only:
                done += tokens.count(batch.column("text"), encoder)
                continue
            ids, at = tokens.encode(batch.column("text"), encoder)
            names += batch.column("doc_id").to_pylist()
            rest = np.concatenate([rest, ids])
            owner = np.concatenate([owner, np.repeat(np.arange(seen, seen + batch.num_rows), np.diff(at))])
            seen += batch.num_rows
            whole = len(rest) // stride * stride
            if whole:
                yield sequences(rest[:whole], owner[:whole])
                rest, owner = rest[whole:], owner[whole:]
                keep = int(owner[0]) if len(owner) else seen
                names, first = names[keep - first :], keep
        if len(rest):
            fill = stride - len(rest)
            yield sequences(np.concatenate([rest, np.full(fill, tokens.pad_id, tokens.dtype)]), np.append(owner, np.full(fill, owner[-1])))
        total = -(-done // stride) if count_only else done
        if total:
            none = lambda t: pa.nulls(1, t)
            yield batch_of(1, none(pa.int64()), pa.array([total]), pa.array([digest.hexdigest()]), none(pa.binary()), none(pa.list_(id_type)), none(pa.list_(pa.int32())))

    return rows.mapInArrow(run, f"part long, k long, n long, digest string, data binary, doc_ids array<{kind}>, starts array<int>")


def starts_of(counts: DataFrame) -> DataFrame:
    """Adds start: the sequences of all lower partitions. Totals of 4,096 partitions each are summed up first."""
    grouped = counts.withColumn("_g", F.floor(F.col("part") / 4096))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = grouped.groupBy("_g").agg(F.sum("n").alias("n"))
    above = above.select("_g", before(Window.orderBy("_g")).alias("_base"))  # a row for 4,096 partitions of the input
    inside = grouped.withColumn("_in", before(Window.partitionBy("_g").orderBy("part")))
    return inside.join(above, "_g").select(*counts.columns, (F.col("_in") + F.col("_base")).alias("start"))


def write_shards(docs: DataFrame, folder: str, tokens: Tokens, stride: int = 4096, per_shard: int = 2048, key: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pack the token ids of all texts into sequences of ``stride`` ids and write them in training order.

    Each text is followed by the tokens' ``end_id``; the last sequence of a partition is filled with ``pad_id``.
    ``docs`` must give the same rows in the same partitions when read again, as a scan of files does;
    each partition's texts are compared by digest, and a difference raises an error.
    Null and empty texts give their ``end_id`` only; repeated rows are written each; ids may be null and of any type; an empty table gives no shard.
    Other columns are ignored. A shard appears under its name only when whole, so a task that runs again replaces it.

    Returns one row per shard (shard, first_slot, n_sequences, file), and the index, one row per
    sequence: slot, doc_ids and starts (place in the sequence where each document's ids begin or go on).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = stage(sequence_rows(rows, tokens, stride, True).select("part", "n", "digest"), "sequence-counts")
    starts = stage(starts_of(counts), "sequence-starts")
    n_parts, size = starts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not size:
        return spark.createDataFrame([], "shard long, first_slot long, n_sequences long, file string"), spark.createDataFrame([], f"slot long, doc_ids array<{kind}>, starts array<int>")

    @F.arrow_udf(LongType())
    def slot_of_number(number: pa.Array) -> pa.Array:
        return pa.array(feistel(number.to_numpy(), size, key))

    named = starts.select(F.col("part").alias("_part"), F.col("n").alias("_n"), F.col("digest").alias("_digest"), "start")
    made = sequence_rows(rows, tokens, stride, False).join(F.broadcast(named) if n_parts <= BROADCAST_PARTS else named, F.col("part") == F.col("_part"), "left")
    same = (F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_digest"))
    changed = F.raise_error(F.concat(F.lit("the input changed between two readings of partition "), F.col("part").cast("string"))).cast("boolean")
    made = made.filter(F.when(F.col("n").isNull(), F.lit(True)).when(F.coalesce(same, F.lit(False)), F.lit(False)).otherwise(changed))
    made = made.select(slot_of_number(F.col("start") + F.col("k")).alias("slot"), "data", "doc_ids", "starts").withColumn("shard", F.floor(F.col("slot") / per_shard))

    @releasing
    def shard_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, state = None, None
        names = ["shard", "first_slot", "n_sequences", "file", "slot", "doc_ids", "starts"]

        def close(list_types: list[pa.DataType]) -> pa.RecordBatch:
            out.close()
            store.move(state["part"], state["file"])
            row = (state["shard"], state["shard"] * per_shard, state["n"], f"{folder}/{state['file'].rsplit('/', 1)[-1]}")
            head = [pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays([*head, *[pa.nulls(1, t) for t in (pa.int64(), *list_types)]], names)

        for batch in batches:
            data, lists = batch.column("data"), [batch.column("doc_ids"), batch.column("starts")]
            for k, shard in enumerate(batch.column("shard").to_pylist()):
                if state is None or shard != state["shard"]:
                    if state is not None:
                        yield close([x.type for x in lists])
                    name = f"{root}/shard-{shard:08d}"
                    state = {"shard": shard, "n": 0, "file": f"{name}.bin", "part": f"{name}.{TaskContext.get().taskAttemptId()}.part"}
                    out = store.open_output_stream(state["part"])
                out.write(data[k].as_buffer())
                state["n"] += 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), batch.column("slot"), *lists], names)
        if state is not None:
            yield close([x.type for x in lists])

    n_shards = -(-size // per_shard)
    # shard numbers are partition numbers, modulo a cap on open tasks; each partition writes its shards in order
    dealt = made.repartitionById(min(n_shards, 20_000), F.pmod("shard", F.lit(min(n_shards, 20_000))).cast("int")).sortWithinPartitions("shard", "slot")
    dealt = dealt.select("shard", "slot", "data", "doc_ids", "starts")
    table = stage(dealt.mapInArrow(shard_files, f"shard long, first_slot long, n_sequences long, file string, slot long, doc_ids array<{kind}>, starts array<int>"), "shard-list")
    return table.filter("file is not null").select("shard", "first_slot", "n_sequences", "file"), table.filter("file is null").select("slot", "doc_ids", "starts")


def read_shards(shards: DataFrame, stride: int = 4096, dtype: str = "uint16", start: int = 0) -> DataFrame:
    """(shard, slot, byte_offset, ids binary) of all records from slot ``start`` on, each shard read in sequence."""
    width = stride * np.dtype(dtype).itemsize

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, n, file in zip(*[batch.column(c).to_pylist() for c in ("shard", "first_slot", "n_sequences", "file")], strict=True):
                store, path = pa.fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as source:
                    skip = min(n, max(0, start - first))
                    source.seek(skip * width)
                    for k in range(skip, n, 256):
                        m = min(256, n - k)
                        data = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(m + 1, dtype=np.int32) * np.int32(width)), source.read_buffer(m * width)])
                        slots = np.arange(first + k, first + k + m)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, shard)), pa.array(slots), pa.array((slots - first) * width), data], ["shard", "slot", "byte_offset", "ids"])

    return shards.mapInArrow(run, "shard long, slot long, byte_offset long, ids binary")
