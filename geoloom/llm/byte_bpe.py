"""Byte-level BPE as a monoid: encode halves, join neighbours, concatenate to decode.

A sequence of tokens is the BPE encoding of its bytes if and only if each adjacent pair of tokens is
the encoding of its own bytes, given that every token's bytes encode to that token. Joining two
encodings therefore re-encodes a window around the boundary, grown on the side where the pair at
the window's edge isn't stable, and stops as soon as both edge pairs are. Texts are cut at powers of
two, so equal stretches of a long run are equal blocks, which are encoded once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.shared import chunks, releasing, text_bytes

CHUNK_BYTES = 1 << 20
#: Pieces up to so many bytes are leaves of the tree.
LEAF_BYTES = 16
#: Ids up to so many are leaves of the decoding tree.
LEAF_IDS = 64
#: Windows over so many bytes are merged through a heap.
LONG_BYTES = 64
#: Different pieces whose ids a task remembers, and pairs that a worker does.
REMEMBERED, REMEMBERED_PAIRS = 150_000, 50_000
#: Blocks of long pieces that a worker remembers, of up to so many bytes in all.
BLOCK_MEMORY = 1 << 20
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
#: Code points that are classed at once; surrogates are a whole number of such blocks.
CODE_BLOCK = 0x800


class BytePairs:
    """Encoder and decoder for one table of ranks, in which each token's bytes encode to that token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.pair_is_stable: dict[tuple[int, int], bool] = {}
        self.blocks: dict[bytes, list[int]] = {}
        self.block_bytes = 0

    def leaf(self, data: bytes) -> list[int]:
        """Ids by repeatedly merging the pair of lowest rank, leftmost first."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        if len(data) > LONG_BYTES:
            return self.long_leaf(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], 1 << 30) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == 1 << 30:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def long_leaf(self, data: bytes) -> list[int]:
        """As ``leaf``: pairs come from a heap by rank and place; one that has changed since is passed over."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by start of a part; end 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        found = self.pair_is_stable.get((a, b))
        if found is None:
            if len(self.pair_is_stable) > REMEMBERED_PAIRS:
                self.pair_is_stable.clear()
            found = self.pair_is_stable[a, b] = self.leaf(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, one after the other."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1  # the window is left[i:] and right[:j]
        by_left = by_right = 1
        while True:
            inner = self.leaf(b"".join(map(self.tokens.__getitem__, left[i:] + right[:j])))
            grow_left = i > 0 and not self.stable(left[i - 1], inner[0])
            grow_right = j < len(right) and not self.stable(inner[-1], right[j])
            if not grow_left and not grow_right:
                return left[:i] + inner + right[j:]
            if grow_left:  # by twice as much each time
                i, by_left = max(0, i - by_left), 2 * by_left
            if grow_right:
                j, by_right = min(len(right), j + by_right), 2 * by_right

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece, by halves: a block of the greatest power of two bytes, and the rest."""
        if len(data) <= LEAF_BYTES:
            return self.leaf(data)
        if (known := self.blocks.get(data)) is not None:
            return known
        half = 1 << (len(data) - 1).bit_length() - 1
        out = self.join(self.encode(data[:half]), self.encode(data[half:]))
        if len(data) == 2 * half > 4 * LEAF_BYTES:  # a whole block, which a run repeats
            self.block_bytes += len(data)
            if self.block_bytes > BLOCK_MEMORY:
                self.blocks, self.block_bytes = {}, len(data)
            self.blocks[data] = out
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, concatenated up the tree."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file; the path is on every machine, like the libraries."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def load(path: str) -> BytePairs:
    return BytePairs(read_ranks(path))


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point as the pattern sees it."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for low in range(0, 0x110000, CODE_BLOCK):  # all at once take 120 MB of every worker
        if 0xD800 <= low < 0xE000:
            continue
        every = "".join(map(chr, range(low, low + CODE_BLOCK)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[low + m.start() : low + m.end()] = kind
    return out


def piece_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets where the matches of the pattern start, for texts end to end.

    The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ of
    the public tokenizers; it covers every character.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    place = np.flatnonzero((raw & 0xC0) != 0x80)
    kind = classes()[code]
    n = len(code)
    first = np.zeros(n + 1, dtype=bool)  # of its text
    first[np.searchsorted(place, at)] = True
    starts = first[:-1].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    run_start = starts.copy()
    blank = kind == BLANK
    last_blank = blank.copy()  # a blank just before a word, in the same text
    last_blank[:-1] &= ~blank[1:] & ~first[1:-1]
    last_blank[-1] = False
    starts |= last_blank  # it leaves its run
    follow = np.zeros(n, dtype=bool)
    follow[1:] = last_blank[:-1]
    joined = follow.copy()  # the word takes the blank if it is a space
    joined[1:] &= code[:-1] == 0x20
    starts &= ~joined
    # contractions: a lone apostrophe that starts a piece, then letters
    quote = np.flatnonzero((code == 0x27) & run_start & starts)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        x = code[quote + 1]
        second = np.where((quote + 2 < n), code[np.minimum(quote + 2, n - 1)], 0)
        second = np.where(first[np.minimum(quote + 2, n)], 0, second)
        two = ((x == ord("r")) & (second == ord("e"))) | ((x == ord("v")) & (second == ord("e"))) | ((x == ord("l")) & (second == ord("l")))
        one = np.isin(x, [ord(c) for c in "stmd"])
        starts[quote[one | two] + 1] = False
        for q, width in ((quote[one], 2), (quote[two & ~one], 3)):
            after = q + width
            after = after[after < n]
            starts[after[(kind[after] == LETTER) & ~first[after]]] = True
    return place[starts]


#: Ids of different pieces, end to end, and how many each has.
PieceEncoder = Callable[[pa.LargeBinaryArray], tuple[np.ndarray, np.ndarray]]


def one_by_one(encode_piece: Callable[[bytes], list[int]], memory: dict[bytes, list[int]]) -> PieceEncoder:
    """Each piece by ``encode_piece``, once while it is remembered."""

    def run(pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        table: list[list[int]] = []
        for piece in pieces.to_pylist():
            ids = memory.get(piece)
            if ids is None:
                ids = encode_piece(piece)
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[piece] = ids
            table.append(ids)
        lengths = np.fromiter(map(len, table), dtype=np.int64, count=len(table))
        return np.fromiter(chain.from_iterable(table), dtype=np.int32, count=int(lengths.sum())), lengths

    return run


#: The pattern of a library's encoder for ``in_bulk``.
BETWEEN_ZEROS = r"[^\x00]+|\x00"
#: Pieces up to so many bytes go to the library's encoder, whose time grows with the square of a run.
LIBRARY_BYTES = 1000


def in_bulk(library: tiktoken.Encoding, encode_long: Callable[[bytes], list[int]]) -> PieceEncoder:
    """All pieces by one call of a library's encoder that cuts by ``BETWEEN_ZEROS``: they are laid out with a zero byte after each.

    Pieces of over ``LIBRARY_BYTES`` are encoded by ``encode_long``, and so are those that hold a zero byte.
    """
    zero = library.encode_single_token(b"\0")

    def run(pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        raw, at = piece_bytes(pieces)
        zeros = np.searchsorted(np.flatnonzero(raw == 0), at)
        alone = (np.diff(at) > LIBRARY_BYTES) | (np.diff(zeros) > 0)
        if alone.any():
            raw, at = piece_bytes(pieces.filter(pa.array(~alone)))
        laid = library.encode_ordinary(np.insert(raw, at[1:], 0).tobytes().decode())
        laid = np.fromiter(laid, dtype=np.int32, count=len(laid))
        ends = laid == zero
        flat, n = laid[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1
        if not alone.any():
            return flat, n
        others = [encode_long(piece) for piece in pieces.filter(pa.array(alone)).to_pylist()]
        lengths = np.zeros(len(pieces), np.int64)
        lengths[~alone], lengths[alone] = n, [len(ids) for ids in others]
        of_alone = np.repeat(alone, lengths)
        out = np.empty(len(of_alone), np.int32)
        out[~of_alone], out[of_alone] = flat, list(chain.from_iterable(others))
        return out, lengths

    return run


def piece_bytes(pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces end to end, and their offsets."""
    _, offsets, data = pieces.buffers()
    at = np.frombuffer(offsets, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def coded_pieces(column: pa.Array, encoder: PieceEncoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text offsets, start of each piece, its code, and the ids of all codes end to end with how many each has."""
    raw, at = text_bytes(column)
    starts = piece_starts(raw, at)
    offsets = np.append(starts, len(raw))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    return at, starts, coded.indices.to_numpy().astype(np.int64), *encoder(coded.dictionary)


def count_ids(column: pa.Array, encoder: PieceEncoder) -> int:
    """Number of ids of all texts."""
    _, _, codes, _, lengths = coded_pieces(column, encoder)
    return int(lengths[codes].sum())


def encode_texts(column: pa.Array, encoder: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts end to end, and the offset of each text."""
    at, starts, codes, flat, lengths = coded_pieces(column, encoder)
    begin = np.cumsum(lengths) - lengths
    n = lengths[codes]
    total = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.repeat(begin[codes] - total[:-1], n) + np.arange(total[-1])]
    return ids, total[np.searchsorted(starts, at)]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row, without special tokens; null and empty texts have no ids."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = one_by_one(load(path).encode, {})
        for part in chunks(batches, "_t", CHUNK_BYTES):
            ids, at = encode_texts(part.column("_t"), encoder)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data binary): the bytes of every row's ids; null ids decode to nothing."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.decode(ids or []) for ids in batch.column("_ids").to_pylist()], pa.binary())], ["doc_id", "data"])

    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("_ids")).mapInArrow(run, f"doc_id {dict(tokens.dtypes)[id_col]}, data binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; ids are joined by commas in decimal.

    Encodes and decodes (up the tree) in one pass, so the ids of a corpus need not be written to be checked. Null and
    empty texts have no ids and the digests of nothing. Ids may be null, repeat and be of any type; each row has its own
    answer. An empty table gives an empty one. Other columns are ignored.
    """
    import hashlib

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        encoder = one_by_one(bpe.encode, {})
        spoken = pa.array([f"{i}," for i in range(max(bpe.tokens) + 1)], pa.large_string())

        def listed(ids: np.ndarray, at: np.ndarray) -> list[str]:
            _, offsets, data = spoken.take(pa.array(ids)).buffers()
            edge = np.frombuffer(offsets, np.int64)[at].tolist()
            data = memoryview(data) if data is not None else memoryview(b"")
            return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(edge, edge[1:], strict=False)]

        for part in chunks(batches, "_t", CHUNK_BYTES):
            ids, at = encode_texts(part.column("_t"), encoder)
            decoded = [hashlib.sha256(bpe.decode(ids[a:b].tolist())).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(listed(ids, at), pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
