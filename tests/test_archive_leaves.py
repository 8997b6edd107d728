from __future__ import annotations

import gzip
import struct

import pytest
from geoloom.sources import rasters


def varint(v):
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def directory(entries):
    ids = [e[0] for e in entries]
    columns = [[b - a for a, b in zip([0, *ids], ids, strict=False)], *[[e[k] for e in entries] for k in (1, 2)], [e[3] + 1 for e in entries]]
    return gzip.compress(b"".join(map(varint, [len(entries), *[v for c in columns for v in c]])))


def archive(depth):
    """An archive with one tile in the root and two below at each level, and those tiles."""
    leaves, tiles, pointers = b"", [], []
    for d in range(depth, 0, -1):
        own = [(100 * d, 1, 10, d), (100 * d + 1, 2, 20, 50 + d)]
        tiles += own
        raw = directory(own + pointers)
        pointers = [(100 * d, 0, len(raw), len(leaves))]
        leaves += raw
    top = [(5, 1, 7, 0)]
    raw = directory(top + pointers)
    head = bytearray(b"PMTiles\x03" + struct.pack("<QQQQQQ", 127, len(raw), 0, 0, 127 + len(raw), len(leaves)) + bytes(71))
    head[97] = 2
    return bytes(head) + raw + leaves, sorted(top + tiles)


def found(spark, path):
    return sorted((r.tile_id, r.run_length, r.length, r.offset) for r in rasters.ingest_archive_dir(spark, str(path)).collect())


def test_leaf_directories_are_followed(spark, tmp_path):
    wants = []
    for depth in (1, 3):
        data, tiles = archive(depth)
        (tmp_path / f"{depth}.archive").write_bytes(data)
        wants += tiles
    assert found(spark, tmp_path) == sorted(wants)


def test_directories_nested_too_deep(spark, tmp_path):
    (tmp_path / "4.archive").write_bytes(archive(4)[0])
    with pytest.raises(Exception, match="nested too deep"):
        found(spark, tmp_path)
