"""Which ids of two tokenizers cover the same bytes, and how many documents hold each pair of ids linked.

A text is cut into units before each space that follows a character other than white space: there both tokenizers end a token, whatever
stands around it, so tokens and groups of a text are those of its units end to end, and a unit that repeats is aligned once.

Long texts go over Spark tasks by byte ranges. A range yields a fragment: an open prefix (bytes before its first cut), the closed groups
between its first and last cut, and an open suffix. Two neighbours compose to a fragment of both: suffix and prefix that meet are bytes
between two cuts, whose groups close. That is associative, so fragments are composed up a tree, ``FAN`` of them in one task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.byte_bpe import BETWEEN_ZEROS, LIBRARY_BYTES, BytePairs, encode_texts, in_bulk
from geoloom.llm.shared import chunks, merged, releasing, spread, stage, text_bytes, unstage

CHUNK_BYTES = 2 << 20
#: Texts over so many bytes are cut into ranges of so many, and fragments that one task composes.
RANGE_BYTES, FAN = 128 << 10, 16
#: The most frequent pairs, whose counts every task holds (about 20 bytes each); all others meet their counts in a join.
HOT_PAIRS = 1 << 20
#: Different pairs that a task counts before it sends them on.
HELD_PAIRS = 1 << 20
#: Groups of more links than this reduce their ids first.
LARGE_GROUP = 4096


def byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable Latin letters stand for themselves, other bytes for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Id of each token's bytes; a lower id must mean an earlier merge, so that ids are ranks."""
    model = json.loads(open(path, "rb").read())["model"]
    letter, vocab = byte_letters(), model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        raise ValueError(f"{path}: ids don't follow the order of the merges")
    return {bytes(map(letter.__getitem__, token)): i for token, i in vocab.items()}


@dataclass
class Units:
    """What each unit holds: whether both tokenizers give its bytes back, numbers, groups as text (each after a semicolon), and its different linked pairs with their occurrences."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    text: pa.LargeBinaryArray
    pair_at: np.ndarray
    pairs: np.ndarray
    occ: np.ndarray


class Aligner:
    """Two tokenizers: byte-level BPE (A) of space and text, pieces (B) of the text, to which B itself adds the space."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.bpe = BytePairs(read_vocabulary(a_path))
        self.library = tiktoken.Encoding("pieces", pat_str=BETWEEN_ZEROS, mergeable_ranks=self.bpe.ranks, special_tokens={})
        self.encoder = in_bulk(self.library, self.merges)
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        ids = range(self.model.vocab_size())
        pieces = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        if any(b" " in p.lstrip(b" ") for p in pieces):
            raise ValueError(f"{b_path}: a piece holds a space after another character, so that units can't be cut there")
        self.blank = self.model.piece_to_id("▁")
        self.b_tokens = pa.array(pieces, pa.large_binary())
        self.b_len = np.array([len(p) for p in pieces])
        n_a = max(self.bpe.tokens) + 1
        self.a_len = np.array([len(self.bpe.tokens.get(i, b"")) for i in range(n_a)])
        self.ids = max(n_a, len(pieces))
        self.spoken = pa.array([f"{mark}{i}" for mark in ";,|" for i in range(self.ids)], pa.large_string())

    def merges(self, piece: bytes) -> list[int]:
        return self.library._encode_single_piece(piece) if len(piece) <= LIBRARY_BYTES else self.bpe.encode(piece)

    def pieces(self, units: list[str]) -> list[list[int]]:
        return [ids or [self.blank] for ids in self.model.encode([u[1:] for u in units], num_threads=1)]  # else as many as the machine has, in each task

    def align(self, units: pa.Array, spoken: bool = True) -> Units:
        """Groups of units of text, each of which begins with a space; without ``spoken``, not as text."""
        raw, at = text_bytes(units)
        n = len(units)
        a, a_at = encode_texts(units, self.encoder)
        lists = self.pieces(units.to_pylist())
        b_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, n))]).astype(np.int64)
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(b_at[-1]))
        a = a.astype(np.int64)
        ok = self._same_bytes(raw, at, b, b_at)
        unit_a, unit_b = np.repeat(np.arange(n), np.diff(a_at)), np.repeat(np.arange(n), np.diff(b_at))
        if not ok.all():
            a, unit_a, b, unit_b = a[ok[unit_a]], unit_a[ok[unit_a]], b[ok[unit_b]], unit_b[ok[unit_b]]
            a_at, b_at = np.searchsorted(unit_a, np.arange(n + 1)), np.searchsorted(unit_b, np.arange(n + 1))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        n_a, n_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        unit = unit_a[first_a] if len(ends) else np.zeros(0, np.int64)
        group_at = np.searchsorted(unit, np.arange(n + 1))
        links = np.concatenate([[0], np.cumsum(n_a * n_b)])[group_at]
        pairs, occ, pair_at = self._pairs(a, group_a, n_a, first_a, b, n_b, first_b, unit, n)
        text = self._spoken(a, a_at, group_a, n_a, first_a, b, b_at, group_b, first_b) if spoken else pa.array([b""] * n, pa.large_binary())
        return Units(ok, np.diff(a_at), np.diff(b_at), np.diff(group_at), np.diff(links), text, pair_at, pairs, occ)

    def _spoken(self, a: np.ndarray, a_at: np.ndarray, group_a: np.ndarray, n_a: np.ndarray, first_a: np.ndarray, b: np.ndarray, b_at: np.ndarray, group_b: np.ndarray, first_b: np.ndarray) -> pa.LargeBinaryArray:
        """Groups of each unit as text."""
        n = len(a_at) - 1
        # ids in the order in which they are written: A's of a group, then B's
        word = np.zeros(len(a) + len(b), np.int64)
        lead_a, lead_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        lead_a[first_a], lead_b[first_b] = True, True
        word[np.arange(len(a)) + first_b[group_a]] = np.where(lead_a, 0, self.ids) + a
        word[np.arange(len(b)) + (first_a + n_a)[group_b]] = np.where(lead_b, 2 * self.ids, self.ids) + b
        _, offsets, data = self.spoken.take(pa.array(word)).buffers()
        text_at = np.frombuffer(offsets, np.int64)[a_at + b_at] if len(word) else np.zeros(n + 1, np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(text_at.copy()), data if len(word) else pa.py_buffer(b"")])

    def _same_bytes(self, raw: np.ndarray, at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
        """Whether B's pieces join to the unit's bytes. A's always do: it has every byte."""
        joined = np.frombuffer(self.b_tokens.take(pa.array(b)).buffers()[2] or b"", np.uint8)
        edge = np.concatenate([[0], np.cumsum(self.b_len[b])])[b_at]
        ok = np.diff(edge) == np.diff(at)
        if ok.all():
            ok[np.searchsorted(at, np.flatnonzero(joined[: len(raw)] != raw), "right") - 1] = False
        else:
            for k in np.flatnonzero(ok):
                ok[k] = np.array_equal(joined[edge[k] : edge[k + 1]], raw[at[k] : at[k + 1]])
        return ok

    @staticmethod
    def _pairs(a: np.ndarray, group_a: np.ndarray, n_a: np.ndarray, first_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, first_b: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different pairs of each unit (a << 32 | b), their occurrences, and where each unit's begin."""
        large = n_a * n_b > LARGE_GROUP
        if len(a) and not large.any() and max(int(a.max()), int(b.max())) < 1 << 16 and n < 1 << 31:  # unit and pair are one number
            reps = n_b[group_a]
            key = np.repeat(unit[group_a] << 32 | a << 16, reps) | b[spread(first_b[group_a], reps)]
            key.sort()
            lead = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            occ, key = np.diff(np.append(lead, len(key))), key[lead]
            return (key >> 16 & 0xFFFF) << 32 | key & 0xFFFF, occ, np.searchsorted(key >> 32, np.arange(n + 1))
        own = np.flatnonzero(~large[group_a])
        reps = n_b[group_a[own]]
        pairs = [np.repeat(a[own] << 32, reps) | b[spread(first_b[group_a[own]], reps)]]
        units, occ = [np.repeat(unit[group_a[own]], reps)], [np.ones(len(pairs[0]), np.int64)]
        for g in np.flatnonzero(large):
            ids_a, times_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            ids_b, times_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            pairs.append(((ids_a << 32)[:, None] | ids_b).ravel())
            occ.append((times_a[:, None] * times_b).ravel())
            units.append(np.full(len(pairs[-1]), unit[g]))
        pairs, units, occ = map(np.concatenate, (pairs, units, occ))
        by = np.lexsort((pairs, units))
        pairs, units, occ = pairs[by], units[by], occ[by]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]) | (units[1:] != units[:-1])
        lead = np.flatnonzero(new)
        return pairs[lead], np.add.reduceat(occ, lead) if len(lead) else occ, np.searchsorted(units[lead], np.arange(n + 1))


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


#: Bytes of visible ASCII characters.
VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = True


def cuts(raw: np.ndarray) -> np.ndarray:
    """Places of spaces that follow a character other than white space, of which the three bytes before the space tell."""
    at = np.flatnonzero(raw == 0x20)
    at = at[at >= 3]
    x, y, z = raw[at - 1], raw[at - 2].astype(int), raw[at - 3].astype(int)
    three = z << 16 | y << 8 | x
    blank = ((y == 0xC2) & ((x == 0x85) | (x == 0xA0))) | (three == 0xE19A80) | (three == 0xE1A08E) | (three == 0xE2819F) | (three == 0xE38080) | ((three >= 0xE28080) & (three <= 0xE2808A)) | np.isin(three, [0xE280A8, 0xE280A9, 0xE280AF])
    return at[VISIBLE[x] | ((x >= 0x80) & ~blank)]


@dataclass
class Chunk:
    """Texts end to end: the units of each, coded, and what each different unit holds."""

    unit_at: np.ndarray
    codes: np.ndarray
    units: Units

    def sums(self, of_unit: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_unit[self.codes])])
        return total[self.unit_at[1:]] - total[self.unit_at[:-1]]


def read_chunk(column: pa.Array, both: Aligner, spoken: bool = True) -> Chunk:
    """Units of texts that each begin with a space; null ones have none. ``spoken``: with their groups as text."""
    raw, at = text_bytes(column)
    first = np.zeros(len(raw) + 1, bool)
    first[cuts(raw)] = first[at] = True
    starts = np.flatnonzero(first[:-1])
    offsets = np.append(starts, len(raw)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
    return Chunk(np.searchsorted(starts, at), coded.indices.to_numpy().astype(np.int64), both.align(coded.dictionary, spoken))


@dataclass(frozen=True)
class Fragment:
    """A byte range of a text. Without a cut in it, all of it is ``head``."""

    head: bytes = b""
    closed: bool = False
    tail: bytes = b""
    ok: bool = True
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups: bytes = b""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    occ: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


FRAGMENT = "head binary, closed boolean, tail binary, ok boolean, n_a long, n_b long, n_groups long, n_links long, groups binary, pairs array<bigint>, occ array<bigint>"
NAMES = [part.split(" ")[0] for part in FRAGMENT.split(", ")]


def closed_groups(data: bytes, both: Aligner) -> Fragment:
    """The groups of bytes between two cuts (or the ends of a text)."""
    if not data:
        return Fragment(closed=True)
    chunk = read_chunk(pa.array([data], pa.large_binary()).cast(pa.large_string()), both)
    u = chunk.units
    n = np.diff(u.pair_at)[chunk.codes]
    at = spread(u.pair_at[chunk.codes], n)
    pairs, occ = merged([u.pairs[at]], [u.occ[at]])
    numbers = {name: int(chunk.sums(getattr(u, name))[0]) for name in ("n_a", "n_b", "n_groups", "n_links")}
    return Fragment(closed=True, ok=bool(u.ok.all()), groups=b"".join(u.text.take(pa.array(chunk.codes)).to_pylist()), pairs=pairs, occ=occ, **numbers)


def fragment(data: bytes, first: bool, both: Aligner) -> Fragment:
    """The fragment of a byte range; the ``first`` range of a text begins at a cut."""
    at = cuts(np.frombuffer(data, np.uint8))
    begin = 0 if first else int(at[0]) if len(at) else None
    if begin is None:
        return Fragment(head=data)
    end = int(at[-1]) if len(at) else begin
    return replace(closed_groups(data[begin:end], both), head=data[:begin], tail=data[end:])


def compose(x: Fragment, y: Fragment, both: Aligner) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if not x.closed:
        return replace(y, head=x.head + y.head)
    if not y.closed:
        return replace(x, tail=x.tail + y.head)
    parts = [x, closed_groups(x.tail + y.head, both), y]
    pairs, occ = merged([p.pairs for p in parts], [p.occ for p in parts])
    numbers = {name: sum(getattr(p, name) for p in parts) for name in ("n_a", "n_b", "n_groups", "n_links")}
    return Fragment(x.head, True, y.tail, all(p.ok for p in parts), groups=b"".join(p.groups for p in parts), pairs=pairs, occ=occ, **numbers)


def whole(x: Fragment, both: Aligner) -> Fragment:
    """The fragment of a whole text, closed at both ends."""
    return reduce(lambda p, q: compose(p, q, both), [Fragment(closed=True), x, Fragment(closed=True)])


def long_texts(rows: DataFrame, a_path: str, b_path: str, range_bytes: int) -> DataFrame:
    """(doc_id, ok, n_a, n_b, n_groups, n_links, groups_sha256, pairs, occ) of long texts (doc_id, _t), composed up a tree over byte ranges."""
    kind = dict(rows.dtypes)["doc_id"]
    data, n = F.col("_b"), F.ceil(F.octet_length("_t") / range_bytes)
    ranges = rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("n", n.cast("int")).withColumn("_b", F.col("_t").cast("binary"))
    ranges = ranges.select("doc_id", "rid", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.substring(data, k * range_bytes + 1, F.lit(range_bytes)))).alias("k", "part"))
    now = stage(ranges, "byte-ranges")

    @releasing
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                made = fragment(one.column("part")[0].as_py(), one.column("k")[0].as_py() == 0, both)
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in ("doc_id", "rid", "n", "k")], *columns(made)], ["doc_id", "rid", "n", "k", *NAMES])

    def columns(x: Fragment) -> list[pa.Array]:
        lists = {"pairs", "occ"}
        kinds = {"head": pa.binary(), "tail": pa.binary(), "groups": pa.binary()}
        return [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) if name in lists else pa.array([v], kinds.get(name)) for name in NAMES for v in [getattr(x, name)]]

    def fragments(table: pa.Table) -> list[Fragment]:
        lists = {name: table[name].combine_chunks() for name in ("pairs", "occ")}
        plain = table.select([name for name in NAMES if name not in lists]).to_pylist()
        return [Fragment(**row, **{name: lists[name][k].values.to_numpy() for name in lists}) for k, row in enumerate(plain)]

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        made = reduce(lambda p, q: compose(p, q, aligner(a_path, b_path)), fragments(table))
        one = table.slice(0, 1)
        return pa.Table.from_arrays([one["doc_id"], one["rid"], pa.chunked_array([pa.array([(one["n"][0].as_py() + FAN - 1) // FAN], pa.int32())]), pa.chunked_array([pa.array([one["k"][0].as_py() // FAN], pa.int32())]), *map(pa.chunked_array, map(lambda c: [c], columns(made)))], ["doc_id", "rid", "n", "k", *NAMES])

    schema = f"doc_id {kind}, rid long, n int, k int, {FRAGMENT}"
    # a few ranges lie in one file, so they are dealt out
    after = stage(now.repartition("rid", "k").mapInArrow(leaves, schema), "fragments")
    unstage(now)
    now, most = after, after.agg(F.max("n")).first()[0] or 0
    while most > 1:
        after = stage(now.withColumn("_g", F.floor(F.col("k") / FAN)).groupBy("rid", "_g").applyInArrow(lambda table: up(table.drop_columns(["_g"])), schema), "fragments")
        unstage(now)
        now, most = after, -(-most // FAN)

    @releasing
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for batch in batches:
            for row in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(row, 1)])
                x = whole(fragments(one)[0], both)
                digest = hashlib.sha256(x.groups[1:]).hexdigest()
                named = dict(zip(NAMES, columns(x), strict=True))
                kept = ["ok", "n_a", "n_b", "n_groups", "n_links", "pairs", "occ"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, 1), pa.array([digest]), *[named[c] for c in kept]], ["doc_id", "groups_sha256", *kept])

    out = stage(now.mapInArrow(close, f"doc_id {kind}, groups_sha256 string, ok boolean, n_a long, n_b long, n_groups long, n_links long, pairs array<bigint>, occ array<bigint>"), "long-texts")
    unstage(now)
    return out


def pair_counts(short: DataFrame, long: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n): documents that hold the pair linked."""

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            pairs, n = merged(*zip(*held, strict=True)) if held else merged([], [])
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

        for part in chunks(batches, "_t", CHUNK_BYTES):
            chunk = read_chunk(part.column("_t"), both, spoken=False)
            u = chunk.units
            good = chunk.sums((~u.ok).astype(np.int64)) == 0
            doc = np.repeat(np.arange(len(good)), np.diff(chunk.unit_at))
            doc, code = np.divmod(np.unique((doc * len(u.ok) + chunk.codes)[good[doc]]), max(1, len(u.ok)))
            every, rank = np.unique(u.pairs, return_inverse=True)
            n = np.diff(u.pair_at)[code]
            once = np.unique(np.repeat(doc, n) * len(every) + rank[spread(u.pair_at[code], n)])
            times = np.bincount(once % max(1, len(every)), minlength=len(every))
            held.append((every[times > 0], times[times > 0]))
            size += len(every)
            if size > HELD_PAIRS:
                out = flush()
                held, size = [(out.column(0).to_numpy(), out.column(1).to_numpy())], out.num_rows
                if size > HELD_PAIRS // 2:
                    held, size = [], 0
                    yield out
        yield flush()

    own = short.select("_t").mapInArrow(count, "pair long, n long")
    more = long.filter("ok").select(F.explode("pairs").alias("pair"), F.lit(1).cast("long").alias("n"))
    return own.union(more).groupBy("pair").agg(F.sum("n").alias("n"))


def hottest(counts: DataFrame, most: int) -> DataFrame:
    """The pairs of the highest counts, at most ``most`` of them: whole classes of counts, an eighth of a power of two wide."""
    width = F.floor(8 * F.log2("n"))
    classes = sorted(counts.groupBy(width.alias("class")).count().collect(), reverse=True)  # up to 8 x 63 rows
    least, total = None, 0
    for name, n in classes:
        total += n
        if total > most:
            break
        least = name
    return counts.filter(F.lit(False)) if least is None else counts.filter(width >= least)


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A group ends where tokens of both end; its links are all pairs of A's and B's token occurrences in it. A pair's count is the number of rows
    that hold it linked; n_best counts links whose count is the highest of their A id, ties included, count_sum adds the counts over links. Texts that are
    null, empty, or not given back by B's pieces (U+2581 in the text) have zeros and an empty digest, and count for nothing. Repeated rows and
    rows that repeat an id are rows of their own; ids may be null and of any type; an empty table gives an empty one. Other columns are ignored.

    Counts of at most ``hot_pairs`` frequent pairs are sent to all tasks; links of rarer ones meet theirs in a join, which has no hot key.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    text = F.when(F.length(text_col) > 0, F.concat(F.lit(" "), F.col(text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    is_long = F.coalesce(F.octet_length("_t") > range_bytes, F.lit(False))
    short, long = rows.filter(~is_long), long_texts(rows.filter(is_long), a_path, b_path, range_bytes)
    counts = pair_counts(short, long, a_path, b_path)
    counts = stage(counts, "pair-counts")
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("highest"))  # a row for each id of A's vocabulary
    scored = counts.withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    hot = hottest(scored, hot_pairs).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast((hot["pair"].to_numpy(), np.append(hot["n"].to_numpy(), 0), np.append(hot["best"].to_numpy().astype(np.int64), 0)))
    cold = scored.filter(F.col("n") < F.lit(int(hot["n"].to_numpy().min()))) if hot.num_rows else scored

    def look_up(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, whether it is the best, and whether the pair isn't known."""
        names, n, best = known.value
        at = np.searchsorted(names, pairs)
        there = (at < len(names)) & (np.append(names, -1)[at] == pairs)
        at = np.where(there, at, len(names))
        return n[at], best[at], ~there

    result = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in result)}, groups_sha256 string, pairs array<bigint>, occ array<bigint>"

    def listed(at: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))

    @releasing
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for part in chunks(batches, "_t", CHUNK_BYTES):
            chunk = read_chunk(part.column("_t"), both)
            u = chunk.units
            good = (chunk.sums((~u.ok).astype(np.int64)) == 0) & (np.diff(chunk.unit_at) > 0)
            n, best, unknown = look_up(u.pairs)
            of_unit = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[u.pair_at])
            sums = {c: chunk.sums(v) * good for c, v in [*((c, getattr(u, c)) for c in result[:4]), ("n_best", of_unit(u.occ * best)), ("count_sum", of_unit(u.occ * n))]}
            _, offsets, data = u.text.take(pa.array(chunk.codes)).buffers()
            edge = np.frombuffer(offsets, np.int64)[chunk.unit_at].tolist() if len(chunk.codes) else [0] * (len(good) + 1)
            data = memoryview(data) if data is not None else memoryview(b"")
            digest = [hashlib.sha256(data[s + 1 : e]).hexdigest() if g else "" for s, e, g in zip(edge, edge[1:], good.tolist(), strict=False)]
            rare = np.flatnonzero(unknown)
            rare_at = np.searchsorted(rare, u.pair_at)
            of = np.diff(rare_at)[chunk.codes] * np.repeat(good, np.diff(chunk.unit_at))
            at = rare[spread(rare_at[chunk.codes], of)]
            list_at = np.concatenate([[0], np.cumsum(of)])[chunk.unit_at]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(sums[c]) for c in result], pa.array(digest, pa.string()), listed(list_at, u.pairs[at]), listed(list_at, u.occ[at])], ["doc_id", *result, "groups_sha256", "pairs", "occ"])

    @releasing
    def score_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
            good = row.column("ok")[0].as_py()
            pairs, occ = (row.column(c)[0].values.to_numpy() * good for c in ("pairs", "occ"))
            n, best, unknown = look_up(pairs)
            unknown &= good
            sums = [*(row.column(c)[0].as_py() * good for c in result[:4]), int((occ * best).sum()), int((occ * n).sum())]
            at = np.array([0, int(unknown.sum())])
            digest = row.column("groups_sha256")[0].as_py() if good else ""
            yield pa.RecordBatch.from_arrays([row.column("doc_id"), *[pa.array([v], pa.int64()) for v in sums], pa.array([digest]), listed(at, pairs[unknown]), listed(at, occ[unknown])], ["doc_id", *result, "groups_sha256", "pairs", "occ"])

    scores = short.mapInArrow(score, schema).union(long.mapInArrow(score_long, schema))
    kept = stage(scores.withColumn("_rid", F.monotonically_increasing_id()), "alignment")
    final = ["doc_id", *result, "groups_sha256"]
    some = kept.filter(F.size("pairs") > 0)
    met = some.select("_rid", F.explode(F.arrays_zip("pairs", "occ")).alias("x")).select("_rid", F.col("x.pairs").alias("pair"), F.col("x.occ").alias("occ")).join(cold, "pair")
    rest = met.groupBy("_rid").agg(F.sum(F.col("occ") * F.col("best").cast("long")).alias("b"), F.sum(F.col("occ") * F.col("n")).alias("c"))
    joined = some.join(rest, "_rid").withColumns({"n_best": F.col("n_best") + F.col("b"), "count_sum": F.col("count_sum") + F.col("c")})
    return kept.filter(F.size("pairs") == 0).select(final).union(joined.select(final))
