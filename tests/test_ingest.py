from __future__ import annotations

import gzip
import lzma
import struct
import zlib

import numpy as np
from geoloom.sources import rasters


def png(image: np.ndarray, kinds: list[int]) -> bytes:
    h, w, c = image.shape
    flat, lines = image.reshape(h, w * c).astype(int), b""
    for y in range(h):
        kind = kinds[y % len(kinds)]
        row = []
        for i in range(w * c):
            left, up = (flat[y, i - c] if i >= c else 0), (flat[y - 1, i] if y else 0)
            corner = flat[y - 1, i - c] if y and i >= c else 0
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(p - v))
            row.append((flat[y, i] - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
        lines += bytes([kind, *row])
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def test_png_tiles(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 7, 3))
    (tmp_path / "3/5").mkdir(parents=True)
    (tmp_path / "3/5/2.png").write_bytes(png(image, [0, 1, 2, 3, 4]))
    row = rasters.ingest_png(spark, str(tmp_path)).first()
    want = np.floor(image[:, :, 0] * 256.0 + image[:, :, 1] + image[:, :, 2] / 256 - 32768 + 0.5).astype(int)
    assert (row.z, row.tx, row.ty, row["values"]) == (3, 5, 2, want.ravel().tolist())


def lzw_encode(data: bytes) -> bytes:
    bits, n, out, table, width, now = 0, 0, bytearray(), {}, 9, b""

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            out.append(bits >> (n - 8) & 255)
            n -= 8

    put(256)
    table = {bytes([i]): i for i in range(256)}
    size = 258
    for byte in data:
        if (joined := now + bytes([byte])) in table:
            now = joined
            continue
        put(table[now])
        table[joined], size = size, size + 1
        width = min(12, max(9, size.bit_length()))
        now = bytes([byte])
    put(table[now])
    width = min(12, max(9, (size + 1).bit_length()))
    put(257)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def tiff(image: np.ndarray, tile: int, kind: int) -> bytes:
    h, w = image.shape
    tiles = []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            t = np.zeros((tile, tile), np.uint8)
            part = image[y : y + tile, x : x + tile]
            t[: part.shape[0], : part.shape[1]] = part
            tiles.append(zlib.compress(t.tobytes()) if kind == 8 else lzw_encode(t.tobytes()))
    body, offsets = b"", []
    for t in tiles:
        offsets.append(8 + len(body))
        body += t
    extra_at = 8 + len(body)
    extra, entries = b"", []
    doubles = lambda v: struct.pack(f"<{len(v)}d", *v)
    for tag, code, count, data in ((256, 4, 1, struct.pack("<I", w)), (257, 4, 1, struct.pack("<I", h)), (259, 3, 1, struct.pack("<HH", kind, 0)), (322, 4, 1, struct.pack("<I", tile)), (323, 4, 1, struct.pack("<I", tile)), (324, 4, len(tiles), struct.pack(f"<{len(tiles)}I", *offsets)), (325, 4, len(tiles), struct.pack(f"<{len(tiles)}I", *map(len, tiles))), (33550, 12, 3, doubles([0.5, 0.25, 0])), (33922, 12, 6, doubles([0, 0, 0, 30, 40, 0]))):
        if len(data) > 4:
            entries.append(struct.pack("<HHII", tag, code, count, extra_at + len(extra)))
            extra += data
        else:
            entries.append(struct.pack("<HHI", tag, code, count) + data)
    return b"II*\0" + struct.pack("<I", extra_at + len(extra)) + body + extra + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"


def test_tiff_tiles(spark, tmp_path):
    rng = np.random.default_rng(2)
    for kind in (8, 5):
        image = rng.integers(0, 5 if kind == 5 else 256, (40, 50)).astype(np.uint8)
        (tmp_path / str(kind)).mkdir()
        (tmp_path / str(kind) / "a.tif").write_bytes(tiff(image, 32, kind))
        rows = rasters.ingest_tiff(spark, str(tmp_path / str(kind))).collect()
        assert len(rows) == 4
        for r in rows:
            want = image[r.ty * 32 : r.ty * 32 + r.height, r.tx * 32 : r.tx * 32 + r.width]
            assert r["values"] == want.ravel().tolist() and (r.tie_lon, r.tie_lat, r.scale_x, r.scale_y) == (30, 40, 0.5, 0.25)


def varint(v: int) -> bytes:
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def test_archive_directory(spark, tmp_path):
    entries = [(5, 1, 100, 0), (6, 0, 900, 100), (300, 3, 50, 1000), (70_000, 1, 10, 5)]
    deltas = [e[0] - p for e, p in zip(entries, [0, *[e[0] for e in entries]], strict=False)]
    stored = [e[3] + 1 if k == 0 or e[3] != entries[k - 1][3] + entries[k - 1][2] else 0 for k, e in enumerate(entries)]
    raw = gzip.compress(b"".join(map(varint, [len(entries), *deltas, *[e[1] for e in entries], *[e[2] for e in entries], *stored])))
    head = bytearray(b"PMTiles\x03" + struct.pack("<QQ", 127, len(raw)) + bytes(103))
    head[97] = 2
    (tmp_path / "a.archive").write_bytes(bytes(head) + raw)
    rows = rasters.ingest_archive_dir(spark, str(tmp_path)).orderBy("tile_id").collect()
    assert [(r.tile_id, r.run_length, r.length, r.offset) for r in rows] == entries


def test_chunked_raster(spark, tmp_path):
    rng = np.random.default_rng(3)
    body = b"MARK" + struct.pack(">BiiB", 0, 20, 12, 1)
    want = {}
    for kind, (x, y) in enumerate([(0, 0), (8, 0), (16, 0), (-4, 6), (100, 100)]):
        values = rng.integers(-30000, 30000, (6, 8))
        coded = values.copy()
        for j in range(6):
            for i in range(8):
                left, up = (values[j, i - 1] if i else 0), (values[j - 1, i] if j else 0)
                corner = values[j - 1, i - 1] if i and j else 0
                p = left + up - corner
                paeth = min((left, up, corner), key=lambda v, p=p: abs(p - v))
                coded[j, i] = (values[j, i] - [0, left, up, int((left + up) / 2), paeth][kind] + 32768) % 65536 - 32768
        chunk = struct.pack(">iiiiB", x, y, 8, 6, kind) + lzma.compress(coded.astype(">i2").tobytes())
        body += struct.pack(">i", len(chunk)) + chunk
        want |= {(x + i, y + j): int(values[j, i]) for j in range(6) for i in range(8) if 0 <= x + i < 20 and 0 <= y + j < 12}
    (tmp_path / "a.bin").write_bytes(body)
    got = {}
    for r in rasters.ingest_chunked(spark, str(tmp_path), b"MARK").collect():
        got |= {(r.tx + k % r.width, r.ty + k // r.width): v for k, v in enumerate(r["values"])}
    assert got == want
