"""Ingest jobs: files of raster formats to tile tables, a file (or a part of one) at a time in the tasks."""

from __future__ import annotations

import gzip
import lzma
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.scalar import terrarium_decode
from geoloom.operators.windows import decode_directory

TILES = "path string, z int, tx long, ty long, width int, height int, values array<int>"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def unfilter(kind: int, row: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """A PNG scan line without its filter: 0 none, 1 left, 2 up, 3 average, 4 paeth."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()
    out = row.astype(np.int64)
    up = above.astype(np.int64)
    for i in range(len(out)):
        left, b, c = (out[i - bpp] if i >= bpp else 0), up[i], (up[i - bpp] if i >= bpp else 0)
        base = (left + b) // 2 if kind == 3 else min((left, b, c), key=lambda v, p=left + b - c: abs(p - v))
        out[i] = (out[i] + base) & 255
    return out.astype(np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of an 8-bit PNG that isn't interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + n
    width, height, depth, color, _, _, interlace = head
    if depth != 8 or interlace or color not in (0, 2, 4, 6):
        raise ValueError("only plain 8-bit grey and colour PNGs")
    bpp = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * bpp)
    out, above = np.zeros((height, width * bpp), np.uint8), np.zeros(width * bpp, np.uint8)
    for y in range(height):
        above = out[y] = unfilter(int(lines[y, 0]), lines[y, 1:], above, bpp)
    return out.reshape(height, width, bpp)


def ingest_png(spark: SparkSession, path: str) -> DataFrame:
    """Elevation tiles from files named .../z/x/y.png: z, tx, ty, values (metres, row-major)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                key = re.search(r"/(\d+)/(\d+)/(\d+)\.png$", name)
                if key:
                    image = read_png(bytes(content)).astype(np.int32)
                    flat = image[:, :, :3].reshape(-1, 3)
                    yield pd.DataFrame({"z": [int(key[1])], "tx": [int(key[2])], "ty": [int(key[3])], "rgb": [(flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2]).tolist()]})

    raw = files(spark, path, "*.png").mapInPandas(run, "z int, tx long, ty long, rgb array<int>")
    part = lambda c, s: F.shiftright(c, s).bitwiseAND(F.lit(255))
    return raw.select("z", "tx", "ty", F.transform("rgb", lambda c: terrarium_decode(part(c, 16), part(c, 8), part(c, 0)).cast("int")).alias("values"))


def lzw(data: bytes) -> bytes:
    """Decode the LZW of TIFF: codes of 9 to 12 bits, most significant bit first, clear 256, end 257."""
    out, table, width, bits, n, before = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        while n >= width:
            code = bits >> (n - width) & ((1 << width) - 1)
            n -= width
            bits &= (1 << n) - 1
            if code == 256:
                table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return bytes(out)
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            if before:
                table.append(before + entry[:1])
            before = entry
            width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


SIZES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 12: (8, "d"), 16: (8, "Q")}


def read_tiff_head(data: bytes) -> dict:
    """Tags of the first directory of a classic TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        e = at + 2 + 12 * k
        tag, kind, count = struct.unpack(order + "HHI", data[e : e + 8])
        size, code = SIZES.get(kind, (1, "B"))
        where = e + 8 if size * count <= 4 else struct.unpack(order + "I", data[e + 8 : e + 12])[0]
        if code != "s":
            tags[tag] = struct.unpack(f"{order}{count}{code}", data[where : where + size * count])
    return tags


def ingest_tiff(spark: SparkSession, path: str) -> DataFrame:
    """A row per internal tile of 8-bit tiled GeoTIFFs (Deflate or LZW), cut to the raster, with its georeference."""
    schema = f"{TILES}, tie_lon double, tie_lat double, scale_x double, scale_y double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content)
                tags = read_tiff_head(data)
                (width,), (height,), (tw,), (th,), (kind,) = (tags[t] for t in (256, 257, 322, 323, 259))
                tie, scale = tags[33922], tags[33550]
                across = -(-width // tw)
                for k, (at, n) in enumerate(zip(tags[324], tags[325], strict=True)):
                    raw = data[at : at + n]
                    plain = {8: zlib.decompress, 32946: zlib.decompress, 5: lzw, 1: bytes}[kind](raw)
                    ty, tx = divmod(k, across)
                    w, h = min(tw, width - tx * tw), min(th, height - ty * th)
                    image = np.frombuffer(plain, np.uint8, tw * th).reshape(th, tw)[:h, :w]
                    yield pd.DataFrame({"path": [name], "z": [0], "tx": [tx], "ty": [ty], "width": [w], "height": [h], "values": [image.ravel().astype(np.int32).tolist()], "tie_lon": [tie[3]], "tie_lat": [tie[4]], "scale_x": [scale[0]], "scale_y": [scale[1]]})

    return files(spark, path, "*.tif*").mapInPandas(run, schema)


def varints(data: bytes) -> Iterator[int]:
    value = shift = 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            yield value
            value = shift = 0


def archive_directory(data: bytes) -> tuple[list[int], list[int], list[int], list[int]]:
    """Deltas, run lengths, lengths and stored offsets of a serialised directory."""
    it = varints(data)
    n = next(it)
    columns = [[next(it) for _ in range(n)] for _ in range(4)]
    return columns[0], columns[1], columns[2], columns[3]


#: Directories on the way to a tile, the root included.
MAX_DIRECTORY_DEPTH = 4


def ingest_archive_dir(spark: SparkSession, path: str) -> DataFrame:
    """Tile entries of version 3 tile archives, leaf directories followed: path, tile_id, run_length, length, offset.

    Each level's pointers are rows, dealt out by directory, and each directory is decoded by itself. Pointers that
    remain after ``MAX_DIRECTORY_DEPTH`` levels raise an error. Entries of run length 0 in an archive without a leaf
    section lead nowhere and stay as they are.
    """
    schema = "path string, leaves long, dir_at long, seq long, delta long, run_length long, length long, stored_offset long"

    def entries(name: str, leaves: int, at: int, raw: bytes, zipped: bool) -> pd.DataFrame:
        columns = archive_directory(gzip.decompress(raw) if zipped else raw) if raw else ([], [], [], [])
        delta, run_length, length, stored = columns
        return pd.DataFrame({"path": name, "leaves": leaves, "dir_at": at, "seq": range(len(delta)), "delta": delta, "run_length": run_length, "length": length, "stored_offset": stored})

    def root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content)
                if data[:7] != b"PMTiles" or data[7] != 3:
                    raise ValueError(f"{name}: not a version 3 archive")
                at, n = struct.unpack("<QQ", data[8:24])
                yield entries(name, struct.unpack("<Q", data[48:56])[0], at, data[at : at + n], data[97] == 2)

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, leaves, at, raw, zipped in zip(batch["path"], batch["leaves"], batch["dir_at"], batch["raw"], batch["zipped"], strict=True):
                yield entries(name, leaves, at, bytes(raw), zipped)

    def decoded(raw: DataFrame) -> DataFrame:
        return decode_directory(raw, ["path", "dir_at"], "seq").select("path", "leaves", "tile_id", "run_length", "length", "offset")

    def number(at: int) -> str:
        return f"cast(conv(hex(reverse(substring(content, {at + 1}, 8))), 16, 10) as long)"

    tile, pointer = "run_length > 0 or leaves = 0", "run_length = 0 and leaves > 0"
    source = files(spark, path)
    level = decoded(source.mapInPandas(root, schema))
    out = level.filter(tile)
    for _ in range(MAX_DIRECTORY_DEPTH - 1):
        pointers = level.filter(pointer).select("path", "leaves", F.col("offset").alias("leaf"), F.col("length").alias("n")).distinct()
        asked = source.select("path", "content").join(pointers, "path")
        cut = asked.select("path", "leaves", F.expr(f"{number(40)} + leaf").alias("dir_at"), F.expr(f"substring(content, cast({number(40)} + leaf + 1 as int), cast(n as int))").alias("raw"), F.expr("hex(substring(content, 98, 1)) = '02'").alias("zipped"))
        level = decoded(cut.repartition("path", "dir_at").mapInPandas(leaf, schema))
        out = out.union(level.filter(tile))
    too_deep = level.filter(pointer).select("path", "leaves", F.raise_error(F.lit("tile archive: directories are nested too deep")).cast("long").alias("tile_id"), "run_length", "length", "offset")
    return out.union(too_deep).drop("leaves")


def undo(kind: int, chunk: np.ndarray) -> np.ndarray:
    """A chunk of 16-bit values without its filter: 0 none, 1 left, 2 up, 3 average, 4 paeth; sums wrap."""
    if kind in (0, 1, 2):
        return chunk if kind == 0 else np.cumsum(chunk, axis=2 - kind, dtype=np.int16)
    out = chunk.astype(np.int64)
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            left, up = (out[y, x - 1] if x else 0), (out[y - 1, x] if y else 0)
            corner = out[y - 1, x - 1] if x and y else 0
            base = int((left + up) / 2) if kind == 3 else min((left, up, corner), key=lambda v, p=left + up - corner: abs(p - v))
            out[y, x] = (out[y, x] + base + 32768) % 65536 - 32768
    return out.astype(np.int16)


def ingest_chunked(spark: SparkSession, path: str, signature: bytes) -> DataFrame:
    """A row per chunk of chunked 16-bit rasters, cut to the raster; tx and ty are the chunk's cell position.

    A file is ``signature``, version 0, width, height, format 1 for 16 bits, then chunks: length, x, y, width,
    height, filter, xz payload; numbers are big-endian.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content)
                at = len(signature)
                version, width, height, _ = struct.unpack(">BiiB", data[at : at + 10])
                if data[:at] != signature or version != 0:
                    raise ValueError(f"{name}: not such a raster")
                at += 10
                while at + 4 <= len(data):
                    (n,) = struct.unpack(">i", data[at : at + 4])
                    x, y, w, h, kind = struct.unpack(">iiiiB", data[at + 4 : at + 21])
                    values = undo(kind, np.frombuffer(lzma.decompress(data[at + 21 : at + 4 + n]), ">i2", w * h).reshape(h, w).astype(np.int16))
                    left, top = max(0, -x), max(0, -y)
                    kept = values[top : max(top, min(h, height - y)), left : max(left, min(w, width - x))]
                    if kept.size:
                        yield pd.DataFrame({"path": [name], "z": [0], "tx": [x + left], "ty": [y + top], "width": [kept.shape[1]], "height": [kept.shape[0]], "values": [kept.ravel().astype(np.int32).tolist()]})
                    at += 4 + n

    return files(spark, path).mapInPandas(run, TILES)
