"""Removal of byte strings that occur elsewhere, found with suffix arrays of aligned neighbourhoods.

A string of ``LENGTH`` bytes owns a core: of the ``CORE``-byte strings inside it, the one of least
hash. Equal strings own equal cores at equal distance, so only texts around a core that occurs twice
can hold a repeated string. Neighbouring strings that own the same core make one context.

1. Contexts go to their core's hash. Contexts that occur twice are repeated whole; cores that occur
   once are dropped.
2. Where a core has several contexts, their bytes are read and cut into bands of starts. Strings of a
   band share a longer core, which becomes one symbol between short margins.
3. The margins of all contexts of a longer core form one text. Its suffix array, by grouping, puts
   equal strings side by side; those that agree over the string's length are repeated.

A longer core with more contexts than one suffix array should hold has its strings, each once for
each batch that sees it, dealt out over several groups by their bytes; equal strings stay together, and
every group is sorted the same way. Texts are told apart by 128 bits of hash. Contexts are equal if both the
64-bit hashes of their core and of their bytes are; strings of a longer core are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.shared import ODD, SPREAD, chunks, few, heavy_join, mix, powers, releasing, stage, text_bytes, unstage, whole_groups
from geoloom.llm.suffix_groups import _ranges, suffix_arrays

LENGTH, CORE = 200, 100
BAND = 26
CHUNK_BYTES = 2 << 20
#: Contexts or strings that one suffix array should take at most.
GROUP_LIMIT = 4096
POSITION_BITS = 22

def contexts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For all contexts of the texts: text, first start in the text, starts, core offset, core hash, context hash."""
    n = len(raw)
    lengths = np.diff(at)
    starts = np.maximum(lengths - (LENGTH - 1), 0)
    if not starts.sum():
        return (*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 2)
    up, down = powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(SPREAD[raw] * up[:n], out=total[1:])
    core = mix((total[CORE:] - total[:-CORE]) * down[: n - CORE + 1])
    low = np.uint64((1 << POSITION_BITS) - 1)
    value = (core & ~low) | np.arange(len(core), dtype=np.uint64)
    # least value over each window of the cores inside a string, by prefix and suffix minima of blocks
    width = LENGTH - CORE + 1
    blocks = -(-len(value) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(value)] = value
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    p = _ranges(at[:-1], starts)
    text = np.repeat(np.arange(len(starts)), starts)
    c = (np.minimum(behind[p], ahead[p + width - 1]) & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (text[1:] != text[:-1])))
    run = np.diff(np.append(first, len(p)))
    begin, c = p[first], c[first]
    end = begin + run - 1 + LENGTH
    offset = c - begin
    whole = mix(mix((total[end] - total[begin]) * down[begin]) + (run << 8 | offset).astype(np.uint64) * np.uint64(ODD))
    return text[first], begin - at[text[first]], run, offset, core[c], whole


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(dk, bytes, offsets, start in the document) of chunks; a long text comes in overlapping pieces."""
    for part in chunks(batches, "_t", CHUNK_BYTES):
        raw, at = text_bytes(part.column("_t"))
        if len(raw) <= 2 * CHUNK_BYTES:
            yield part.column("dk"), raw, at, np.zeros(part.num_rows, np.int64)
            continue
        for k in range(part.num_rows):
            one = raw[at[k] : at[k + 1]]
            for s in range(0, max(1, len(one) - LENGTH + 1), CHUNK_BYTES):
                cut = one[s : s + CHUNK_BYTES + LENGTH - 1]
                yield part.column("dk").slice(k, 1), cut, np.array([0, len(cut)]), np.array([s])


#: Of a context in its chunk: the only one, the first of several, a later one.
ONLY, FIRST, LATER = 0, 1, 2


@releasing
def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dk, raw, at, base in pieces(batches):
        text, p, run, offset, core, whole = contexts(raw, at)
        by = np.lexsort((whole, core))
        again = np.zeros(len(by), dtype=bool)
        again[1:] = (core[by[1:]] == core[by[:-1]]) & (whole[by[1:]] == whole[by[:-1]])
        seen = np.zeros(len(by), dtype=np.int8)
        seen[by[again]] = LATER
        seen[by[np.flatnonzero(~again & np.append(again[1:], False))]] = FIRST
        yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), dk.take(pa.array(text)), pa.array((p + base[text]) << 14 | run << 7 | offset), pa.array(seen)], ["key", "ctx", "dk", "at", "seen"])


OCCURRENCE = "key long, ctx long, dk long, at long, seen tinyint"


@releasing
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key occurs again, with same (its ctx too) and lead (first of its ctx).

    Later rows of a chunk come last and are decided; the others are sorted by key and ctx, so that
    neighbours tell.
    """
    held: pa.RecordBatch | None = None
    before: tuple | None = None

    def emit(rows: pa.RecordBatch, key_prev: np.ndarray, ctx_prev: np.ndarray, key_next: np.ndarray, ctx_next: np.ndarray) -> pa.RecordBatch:
        first = rows.column("seen").to_numpy() == FIRST
        out = rows.append_column("same", pa.array(ctx_prev | ctx_next | first)).append_column("lead", pa.array(~ctx_prev))
        return out.filter(pa.array(key_prev | key_next | first))

    for batch in batches:
        later = batch.column("seen").to_numpy() == LATER
        if later.any():
            n = int(later.sum())
            yield batch.filter(pa.array(later)).append_column("same", pa.array(np.ones(n, bool))).append_column("lead", pa.array(np.zeros(n, bool)))
            batch = batch.filter(pa.array(~later))
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key, ctx = rows.column("key").to_numpy(), rows.column("ctx").to_numpy()
        k = np.append(before is not None and before[0] == key[0], key[1:] == key[:-1])
        c = np.append(k[0] and before[1] == ctx[0], k[1:] & (ctx[1:] == ctx[:-1]))
        if len(key) > 1:
            yield emit(rows.slice(0, len(key) - 1), k[:-1], c[:-1], k[1:], c[1:])
            before = (key[-2], ctx[-2])
        held = rows.slice(len(key) - 1)
    if held is not None:
        key, ctx = held.column("key")[0].as_py(), held.column("ctx")[0].as_py()
        k = np.array([before is not None and before[0] == key])
        c = np.array([bool(k[0]) and before[1] == ctx])
        yield emit(held, k, c, np.zeros(1, bool), np.zeros(1, bool))


BANDED = "key2 long, ctx2 long, dk long, start long, starts int, need boolean, width int, left binary, right binary"


@releasing
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Margins and longer core of each band of each wanted context of a text."""
    names = [c.split()[0] for c in BANDED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]
    digest = lambda b, seed: xxhash.xxh64_intdigest(b, seed) - (1 << 63)
    for batch in batches:
        rows: list[tuple] = []
        for dk, text, wanted in zip(batch.column("dk").to_pylist(), batch.column("_t").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            data = text.encode()
            for w in wanted:
                p, run, offset = w["at"] >> 14, w["at"] >> 7 & 127, w["at"] & 127
                for low in range(0, LENGTH - CORE + 1, BAND):
                    high = min(low + BAND - 1, LENGTH - CORE)
                    a, b = max(0, offset - high), min(run - 1, offset - low)
                    if a > b:
                        continue
                    s, e = p + offset - low, p + offset - high + LENGTH
                    left, right = data[p + a : s], data[e : p + b + LENGTH]
                    rows.append((digest(data[s:e], low), digest(left + b"\0" + right, len(left)), dk, p + a, b - a + 1, not w["same"], LENGTH - (e - s) + 1, left, right))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _spans(dk: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Byte ranges that the repeated strings of each document cover, from (document, start) pairs."""
    by = np.lexsort((start, dk))
    dk, start = dk[by], start[by]
    first = np.flatnonzero(np.append(True, (dk[1:] != dk[:-1]) | (start[1:] > start[:-1] + 1))) if len(dk) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(dk)) - 1 if len(dk) else first
    return pa.RecordBatch.from_arrays([pa.array(dk[first]), pa.array(start[first]), pa.array(start[last] + LENGTH)], ["dk", "s", "e"])


@releasing
def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated strings of whole groups of equal key2, rows sorted by key2 and ctx2."""
    for table in whole_groups(batches, "key2"):
        key, ctx, starts = table["key2"].to_numpy(), table["ctx2"].to_numpy(), table["starts"].to_numpy().astype(np.int64)
        width = table["width"].to_numpy().astype(np.int64)
        new_key = np.append(True, key[1:] != key[:-1])
        new_ctx = new_key | np.append(True, ctx[1:] != ctx[:-1])
        kind = np.flatnonzero(new_ctx)  # first row of each different context
        times = np.diff(np.append(kind, len(key)))
        of_group = np.cumsum(new_key)[kind] - 1
        several = np.bincount(of_group)[of_group] > 1
        begin = np.cumsum(starts[kind]) - starts[kind]  # flags of each different context's starts
        flags = np.repeat(times > 1, starts[kind])
        use = np.flatnonzero(several)
        if len(use):
            left = table["left"].combine_chunks().take(pa.array(kind[use])).to_pylist()
            right = table["right"].combine_chunks().take(pa.array(kind[use])).to_pylist()
            # symbols: 0 ends a group, 1 a context, bytes from 2 on, 258 the core
            parts, lengths = [], []
            for a, b in zip(left, right, strict=True):
                parts += [a, b"\0", b, b"\0"]
                lengths += [len(a), 1, len(b), 1]
            symbols = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.int64) + 2
            edge = np.cumsum(lengths)
            core_at, sep_at = edge[1::4] - 1, edge[3::4] - 1
            symbols[core_at], symbols[sep_at] = 258, 1
            last = np.append(of_group[use][1:] != of_group[use][:-1], True)
            symbols[sep_at[last]] = 0
            array = suffix_arrays(symbols, sep_at[last] + 1)
            owner = np.repeat(np.arange(len(use)), np.add.reduceat(lengths, np.arange(0, len(lengths), 4)))
            first_at = sep_at + 1 - np.add.reduceat(lengths, np.arange(0, len(lengths), 4))
            x, y = array[:-1], array[1:]
            own = lambda q: q - first_at[owner[q]] < starts[kind[use]][owner[q]]
            near = (of_group[use][owner[x]] == of_group[use][owner[y]]) & own(x) & own(y) & (core_at[owner[x]] - x == core_at[owner[y]] - y)
            x, y = x[near], y[near]
            span = width[kind[use]][owner[x]]
            steps = np.arange(int(span.max()) if len(span) else 0)
            reach = len(symbols) - 1
            equal = ((symbols[np.minimum(x[:, None] + steps, reach)] == symbols[np.minimum(y[:, None] + steps, reach)]) | (steps >= span[:, None])).all(axis=1)
            for q in (x[equal], y[equal]):
                flags[begin[use[owner[q]]] + q - first_at[owner[q]]] = True
        which = np.cumsum(new_ctx) - 1
        row = np.flatnonzero(table["need"].to_numpy(zero_copy_only=False))
        at = _ranges(begin[which[row]], starts[row])
        offset = at - np.repeat(begin[which[row]], starts[row])
        hit = flags[at]
        yield _spans(np.repeat(table["dk"].to_numpy()[row], starts[row])[hit], (np.repeat(table["start"].to_numpy()[row], starts[row]) + offset)[hit])


@releasing
def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as of ``_bands``, one for each string of the contexts of large groups, dealt over ``parts`` groups by their bytes.

    A string that a batch has twice is decided (done); one row of it goes on, for other batches to meet.
    """
    names = [c.split()[0] for c in BANDED.split(", ")] + ["done"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
    for batch in batches:
        seen: dict[tuple[int, bytes, bytes], list[tuple[int, int, bool, int, int]]] = {}
        for key, dk, start, n, need, width, left, right, parts in zip(*[batch.column(c).to_pylist() for c in ("key2", "dk", "start", "starts", "need", "width", "left", "right", "parts")], strict=True):
            for i in range(n):
                tail = left[i:]
                seen.setdefault((key, tail, right[: width - 1 - len(tail)]), []).append((dk, start + i, need, width, parts))
        rows: list[tuple] = []
        for (key, tail, right), at in seen.items():
            digest = xxhash.xxh64_intdigest(tail + b"\0" + right, (key + len(tail)) & (2**64 - 1))
            again = len(at) > 1
            dk, start, need, width, parts = at[0]
            group = xxhash.xxh64_intdigest(f"{key} {digest % parts}") - (1 << 63)
            rows.append((group, digest - (1 << 63), dk, start, 1, need and not again, width, tail, right, False))
            if again:
                rows += [(group, 0, dk, start, 1, need, width, b"", b"", True) for dk, start, need, _, _ in at]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names)


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """Stored (dk, ranges): sorted byte ranges (s, e), which may overlap, covered by repeated strings; texts (dk, _t) are all different."""
    found = texts.mapInArrow(_occurrences, OCCURRENCE)
    # one row of each context and chunk meets at its key; the rest, known to be repeated, are dealt evenly
    meeting = F.when(F.col("seen") == LATER, F.xxhash64("dk", "at")).otherwise(F.col("key"))
    shared = stage(found.repartition(meeting).sortWithinPartitions(F.col("seen") == LATER, "key", "ctx").mapInArrow(_shared, f"{OCCURRENCE}, same boolean, lead boolean"), "contexts")
    p = F.shiftright("at", 14)
    ranges = shared.filter("same").select("dk", p.alias("s"), (p + F.shiftright("at", 7).bitwiseAND(F.lit(127)) + LENGTH - 1).alias("e"))

    leads = shared.filter("lead")
    several = stage(leads.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared-cores")
    wanted = heavy_join(leads, several.select("key"), "key", several, ["dk", "at"])  # one core may have very many contexts
    wanted = stage(wanted.groupBy("dk").agg(F.collect_list(F.struct("at", "same")).alias("wanted")), "wanted")
    held = texts.join(few(wanted.select("dk"), wanted.count()), "dk", "left_semi")
    banded = stage(held.join(wanted, "dk").select("dk", "_t", "wanted").mapInArrow(_bands, BANDED), "bands")
    sizes = banded.groupBy("key2").agg(F.count("*").alias("n"), F.max("need").alias("any_need")).filter("n > 1 and any_need").select("key2", "n")
    sizes = stage(sizes, "band-sizes")
    parts = F.ceil(F.col("n") * BAND / GROUP_LIMIT).cast("int")
    met = heavy_join(banded, sizes.select("key2", F.when(F.col("n") > GROUP_LIMIT, parts).alias("parts")), "key2", sizes, "dk")
    columns = [c.split()[0] for c in BANDED.split(", ")]
    strings = stage(met.filter("parts is not null").select(*columns, "parts").mapInArrow(_strings, f"{BANDED}, done boolean"), "strings")
    groups = met.filter("parts is null").select(*columns).union(strings.filter("not done").select(*columns))
    found = groups.repartition("key2").sortWithinPartitions("key2", "ctx2").mapInArrow(_sorted_groups, "dk long, s long, e long")
    decided = strings.filter("done and need").select("dk", F.col("start").alias("s"), (F.col("start") + LENGTH).alias("e"))
    out = stage(ranges.union(found).union(decided).groupBy("dk").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("ranges")), "ranges")
    for df in (shared, several, wanted, banded, sizes, strings):
        unstage(df)
    return out


@releasing
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, ranges in zip(batch.column("doc_id").to_pylist(), batch.column("_t").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            data, kept, end, spans, removed = text.encode(), [], 0, 0, 0
            for r in ranges:  # sorted
                if r["s"] > end or not spans:
                    kept.append(data[end : r["s"]])
                    spans += 1
                    end_before = r["s"]
                else:
                    end_before = end
                removed += max(0, r["e"] - end_before)
                end = max(end, r["e"])
            kept.append(data[end:])
            out.append((doc_id, len(data), removed, spans, b"".join(kept)))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (batch.column("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row, as the module says.

    Null texts are empty. Texts shorter than ``LENGTH`` bytes lose nothing. Rows with equal texts,
    repeated rows included, are each other's repeats: from ``LENGTH`` bytes on, nothing of them is
    kept. Texts of any length are read whole, the longest in overlapping pieces. Ids may have any type; null ids are kept. An empty
    table gives an empty one. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.withColumns({"dk": F.xxhash64("_t"), "_d2": F.xxhash64(F.lit(1), "_t")})
    n_bytes = F.octet_length("_t").cast("long")
    known = stage(rows.filter(n_bytes >= LENGTH).groupBy("dk", "_d2").agg(F.count("*").alias("n")), "different-texts")
    clash = stage(known.groupBy("dk").agg(F.count("*").alias("_k")).filter("_k > 1").select(F.col("dk").alias("_clash")), "clashes")
    n_clash = clash.count()
    if n_clash:  # different texts with one 64-bit hash go by their second hash
        other = lambda df: df.join(few(clash, n_clash), F.col("dk") == F.col("_clash"), "left").withColumn("dk", F.when(F.col("_clash").isNull(), F.col("dk")).otherwise(F.xxhash64("dk", "_d2"))).drop("_clash")
        rows, known = other(rows), other(known)
    long = rows.filter(n_bytes >= LENGTH)
    copied = stage(known.filter("n > 1").select("dk"), "copied")
    n_copied = copied.count()
    single = long.join(few(copied, n_copied), "dk", "left_anti").select("dk", "_t")
    copies = long.join(few(copied, n_copied), "dk", "left_semi").select("dk", "_t")
    ranges = repeated_ranges(single.union(copies.dropDuplicates(["dk"])))
    partly = stage(ranges.select("dk").join(copied, "dk", "left_anti"), "partly")
    n_partly = partly.count()
    gone = long.join(few(copied, n_copied), "dk", "left_semi").select("doc_id", n_bytes.alias("n_bytes"), n_bytes.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    whole = rows.join(few(partly, n_partly), "dk", "left_anti").join(few(copied, n_copied), "dk", "left_anti")
    whole = whole.select("doc_id", n_bytes.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("_t").cast("binary").alias("kept"))
    kind = dict(rows.dtypes)["doc_id"]
    cut = long.join(few(partly, n_partly), "dk", "left_semi").join(ranges, "dk").select("doc_id", "_t", "ranges").mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return whole.union(gone).union(cut)
