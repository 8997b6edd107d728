"""Near-duplicate lines by an exact set-similarity join.

Words of a line are a set; equal sets are one set, as old as their oldest line, before anything is joined. All sets are
ordered by one rarity order (the class of a word's count over the corpus, then its hash), so two sets of Jaccard
similarity t or more have their first common word among the first size - ceil(t * size) + 1 words of both. Sets meet
there. A word of one set only is never sent. A word that very many sets have is sent with each possible second common
word, so that its sets meet in small groups. Where sets meet, length and position (at the first common word, all
common words are still to come) and 128 parities of the set's words (they bound the symmetric difference from below)
rule pairs out. Each set sends its oldest possible matches on; these are verified on whole sets. A set that has more
of them and isn't matched yet meets all of them in a second round, so the join stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from geoloom.llm.shared import BROADCAST_ROWS, LOWER, NOT_BLANK, SPREAD, chunks, few, free_name, heavy_join, mix, powers, releasing, stage, text_bytes, unstage, whole_groups, word_bounds

CHUNK_BYTES = 1 << 20
SIMILARITY = 0.8
#: Corpus counts of words are kept in so many buckets, one byte each once they are classes, whatever the corpus.
BUCKETS = 1 << 24
#: Buckets of one row of counts.
SLICE = 1 << 12
#: A word in more sets than this is sent with a second word.
HOT_SETS = 2048
#: A group of more sets than this is cut into pairs of blocks.
GROUP_SETS = 1 << 16
#: Groups up to this size are compared by size, all at once; larger ones from the oldest set on.
SMALL_GROUP = 1024
#: Groups are compared together up to about so many pairs.
BLOCK_PAIRS = 1 << 20
#: Oldest possible matches that a set sends on from each group in the first round.
OLDEST = 2


#: Random values of the bytes once A-Z are lower-cased.
SPREAD_LOWER = SPREAD[LOWER]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = SPREAD) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial of the bytes' random values, mixed with the length."""
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class LineSets:
    """Word sets of all lines with a word of some texts: text, number (in its text), begin (of its words), size, lo and hi (128-bit hash) of each line.

    ``words`` are in order of line, class and hash; without ``classes``, of line and hash.
    """

    def __init__(self, column: pa.Array, classes: np.ndarray | None = None) -> None:
        raw, at = text_bytes(column)
        starts, ends, _ = word_bounds(raw, at, NOT_BLANK)
        breaks = np.flatnonzero(raw == 0x0A)
        # a line begins at each text and after each break
        begin = np.concatenate([at[:-1], breaks + 1])
        text = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, side="right") - 1])
        order = np.lexsort((begin, text))
        text = text[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(at) - 1))])[:-1]
        number = np.arange(len(order)) - first[text]
        line = np.searchsorted(begin[order], starts, side="right") - 1
        words = word_hashes(raw, starts, ends, SPREAD_LOWER)
        rarity = np.zeros(len(words), np.uint8) if classes is None else classes[(words % np.uint64(BUCKETS)).astype(np.int64)]
        by = None
        if len(number) < 1 << 20:  # line, class and hash fit one number to sort by, but for the hash's lowest bits
            whole = line.astype(np.uint64) << np.uint64(44) | rarity.astype(np.uint64) << np.uint64(36) | words >> np.uint64(28)
            by = np.argsort(whole)
            tie = whole[by[1:]] == whole[by[:-1]]
            if (words[by[1:]][tie] != words[by[:-1]][tie]).any():
                by = None
        if by is None:
            by = np.lexsort((words, rarity, line))
        line, words, rarity = line[by], words[by], rarity[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (words[1:] != words[:-1])
        line, self.words, self.rarity = line[new], words[new], rarity[new]
        self.begin = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.begin, len(line)))
        self.text, self.number = text[line[self.begin]], number[line[self.begin]]
        if len(self.begin):
            self.lo = np.add.reduceat(mix(self.words ^ np.uint64(0x51ED270B)), self.begin)
            self.hi = np.add.reduceat(mix(self.words * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x27D4EB2F)), self.begin)
        else:
            self.lo = self.hi = np.zeros(0, np.uint64)

    def first_seen(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lines, one of each set, whose set isn't among the sorted ``seen`` hashes; and ``seen`` with these."""
        lo, at = np.unique(self.lo, return_index=True)
        if len(seen):
            fresh = seen[np.minimum(np.searchsorted(seen, lo), len(seen) - 1)] != lo
            lo, at = lo[fresh], at[fresh]
        return np.sort(at), np.sort(np.concatenate([seen, lo]))

    def spread(self, lines: np.ndarray) -> np.ndarray:
        """Places in ``words`` of all words of the lines."""
        size = self.size[lines]
        return np.repeat(self.begin[lines] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _arrow(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _nulls(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind)


def line_table(rows: DataFrame) -> DataFrame:
    """Stored: a row (id, th, line, lo, hi) for each line with a word, and rows (part, offsets, counts) that count words by bucket.

    Words are counted once for each set, as far as one task sees its copies.
    """
    kind = rows.schema["id"].dataType.simpleString()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, id_type = np.zeros(BUCKETS, dtype=np.uint16), np.zeros(0, np.uint64), None
        for part in chunks(batches, "text", CHUNK_BYTES):
            sets = LineSets(part.column("text"))
            fresh, seen = sets.first_seen(seen)
            place, n = np.unique((sets.words[sets.spread(fresh)] % np.uint64(BUCKETS)).astype(np.int32), return_counts=True)
            total[place] = np.minimum(total[place] + n, 65535)
            take, n = pa.array(sets.text), len(sets.lo)
            id_type = part.column("id").type
            yield _arrow(id=part.column("id").take(take), th=part.column("th").take(take), line=sets.number, lo=sets.lo, hi=sets.hi, part=_nulls(n, pa.int32()), offsets=_nulls(n, pa.binary()), counts=_nulls(n, pa.binary()))
        used = np.flatnonzero(total)
        if len(used):
            edge = np.flatnonzero(np.append(True, used[1:] // SLICE != used[:-1] // SLICE))
            bounds = pa.py_buffer((2 * np.append(edge, len(used))).astype(np.int32))
            packed = [pa.Array.from_buffers(pa.binary(), len(edge), [None, bounds, pa.py_buffer(x.astype(np.uint16))]) for x in (used % SLICE, total[used])]
            long = _nulls(len(edge), pa.int64())
            yield _arrow(id=_nulls(len(edge), id_type), th=long, line=long, lo=long, hi=long, part=(used[edge] // SLICE).astype(np.int32), offsets=packed[0], counts=packed[1])

    return stage(rows.mapInArrow(run, f"id {kind}, th long, line long, lo long, hi long, part int, offsets binary, counts binary"), "line-sets")


#: Classes of counts: 1 to 32 are exact, then four to each doubling.
def classes_of(counts: np.ndarray) -> np.ndarray:
    logs = 32 + 4 * np.log2(np.maximum(counts, 32) / 32)
    return np.minimum(np.where(counts <= 32, counts, logs), 255).astype(np.uint8)


def most_of(classes: np.ndarray) -> np.ndarray:
    """The highest count of each class."""
    return np.where(classes <= 32, classes, np.ceil(32 * 2 ** ((classes.astype(np.float64) - 31) / 4))).astype(np.int64)


def rarity_classes(table: DataFrame) -> np.ndarray:
    """Class of each bucket's count: ``BUCKETS`` bytes."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(SLICE, dtype=np.int64)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([classes_of(total).tobytes()], pa.binary())], ["part", "classes"])
        for batch in batches:
            for part, offsets, counts in zip(batch.column("part").to_pylist(), batch.column("offsets"), batch.column("counts"), strict=True):
                if part != now:
                    if now is not None:
                        yield done()
                    now, total = part, np.zeros(SLICE, dtype=np.int64)
                total[np.frombuffer(offsets.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.uint16)
        if now is not None:
            yield done()

    out = np.zeros(BUCKETS, dtype=np.uint8)
    packed = table.filter("part is not null").select("part", "offsets", "counts").repartition("part").sortWithinPartitions("part")
    for r in packed.mapInArrow(run, "part int, classes binary").collect():  # BUCKETS bytes in all
        out[r.part * SLICE : (r.part + 1) * SLICE] = np.frombuffer(r.classes, np.uint8)
    return out


def with_ages(rows: DataFrame) -> DataFrame:
    """Adds age, a long that rises with the id, null first: whole ids themselves, of others the place in their order.

    Ids that aren't whole numbers take one more shuffle of the texts, by ranges of ids. Equal ids have equal ages or, in ranges, ages by hash of the text.
    """
    if rows.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return rows.withColumn("age", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))))
    return rows.repartitionByRange("id", "th").sortWithinPartitions("id", "th").withColumn("age", F.monotonically_increasing_id())


def prefix_rows(rows: DataFrame, classes, t: float) -> DataFrame:
    """(key, age, lo, size << 32 | room, parity, parity2) where sets can have their first common word; room: words that can still be common."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, oldest = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in chunks(batches, "text", CHUNK_BYTES):
            sets = LineSets(part.column("text"), classes.value)
            ages = part.column("age").to_numpy()[sets.text]
            order = np.lexsort((ages, sets.lo))
            lines = order[np.append(True, sets.lo[order[1:]] != sets.lo[order[:-1]])] if len(order) else order
            lines = lines[sets.size[lines] >= t * (sets.size[lines] + 1) - 1e-9]  # a smaller set is like no other
            if len(seen):  # a copy that isn't older says nothing new
                at = np.minimum(np.searchsorted(seen, sets.lo[lines]), len(seen) - 1)
                lines = lines[(seen[at] != sets.lo[lines]) | (ages[lines] < oldest[at])]
            both, both_age = np.concatenate([seen, sets.lo[lines]]), np.concatenate([oldest, ages[lines]])
            order = np.lexsort((both_age, both))
            order = order[np.append(True, both[order[1:]] != both[order[:-1]])] if len(order) else order
            seen, oldest = both[order], both_age[order]
            size = sets.size[lines]
            width = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
            of = np.repeat(np.arange(len(lines)), width)
            pos = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
            place = sets.begin[lines][of] + pos
            kind = sets.rarity[place]
            met = kind > 1
            of, pos, place, kind = of[met], pos[met], place[met], kind[met]
            most = most_of(kind)
            key, room = sets.words[place], size[of] - pos
            hot = np.flatnonzero(most > HOT_SETS)
            if len(hot):
                n = np.minimum(width[of[hot]], size[of[hot]] - 1) - pos[hot]
                source = np.repeat(hot, n)
                step = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + 1
                pair = mix(key[source] * np.uint64(0x9E3779B97F4A7C15) + sets.words[place[source] + step])
                wide = room[source] - step + 1
                cold = most <= HOT_SETS
                blocks = -(-most[source] // GROUP_SETS)
                if (blocks > 1).any():  # a block meets every block
                    copy = np.repeat(np.arange(len(source)), blocks)
                    other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    mine = (sets.lo[lines][of[source[copy]]] % blocks[copy].astype(np.uint64)).astype(np.int64)
                    cell = np.where(blocks[copy] > 1, np.minimum(mine, other) * 1_000_003 + np.maximum(mine, other) + 1, 0)
                    pair, wide, source = mix(pair[copy] + cell.astype(np.uint64)), wide[copy], source[copy]
                key, room, of = np.concatenate([key[cold], pair]), np.concatenate([room[cold], wide]), np.concatenate([of[cold], of[source]])
            words = sets.words[sets.spread(lines)]
            owner = np.repeat(np.arange(len(lines)), size) << 7 | (words >> np.uint64(57)).astype(np.int64)
            odd = (np.bincount(owner, minlength=128 * len(lines)) & 1).astype(np.uint8).reshape(-1, 128)
            parity = np.packbits(odd, axis=1, bitorder="little").view(np.uint64)
            yield _arrow(key=key, age=ages[lines][of], lo=sets.lo[lines][of], size=size[of] << 32 | room, parity=parity[of, 0], parity2=parity[of, 1])

    return rows.select("text", "age").mapInArrow(run, "key long, age long, lo long, size long, parity long, parity2 long")


class Met:
    """Sets that meet: one row for each set of a group, by group, size and hash."""

    def __init__(self, table: pa.Table, asked: bool) -> None:
        a = {c: table[c].to_numpy() for c in table.column_names}
        key = a["key"]
        group = np.cumsum(np.append(True, key[1:] != key[:-1]))
        size, lo = a["size"] >> 32, a["lo"]
        by = np.lexsort((lo, group << 32 | size))
        group, size, lo = group[by], size[by], lo[by]
        p, q, room = a["parity"].view(np.uint64)[by], a["parity2"].view(np.uint64)[by], (a["size"] & 0xFFFFFFFF)[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (lo[1:] != lo[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        at = np.flatnonzero(new)
        self.age = np.minimum.reduceat(a["age"][by], at) if len(at) else a["age"]
        self.key, self.group, self.size, self.lo, self.p, self.q, self.room = (x[at] for x in (key[by], group, size, lo, p, q, room))
        self.asked = a["asked"][by][at] if asked else None

    def possible(self, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
        """Whether rows i and j pass the length, position and parity filters."""
        x, y = self.size[i], self.size[j]
        need = np.ceil(t / (1 + t) * (x + y) - 1e-9).astype(np.int64)
        ok = np.flatnonzero((np.minimum(self.room[i], self.room[j]) >= need) & (np.minimum(x, y) >= t * np.maximum(x, y) - 1e-9))
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(self.p[i] ^ self.p[j]).astype(np.int64) + np.bitwise_count(self.q[i] ^ self.q[j])
        out = np.zeros(len(x), dtype=bool)
        out[ok[apart <= (x + y - 2 * need)[ok]]] = True
        return out

    def blocks(self) -> Iterator[np.ndarray]:
        """First rows of consecutive groups, of up to about ``BLOCK_PAIRS`` pairs together; large groups come alone."""
        edge = np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1])) if len(self.group) else np.zeros(0, np.int64)
        length = np.diff(np.append(edge, len(self.group)))
        edge, length = edge[length > 1], length[length > 1]
        for alone in edge[length > SMALL_GROUP]:
            yield np.array([alone])
        edge, length = edge[length <= SMALL_GROUP], length[length <= SMALL_GROUP]
        block = np.cumsum(length * length) // BLOCK_PAIRS
        at = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(edge) else edge
        yield from np.split(edge, at[1:]) if len(edge) else ()

    def asked_pairs(self, edge: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(younger, older) rows that are possible for the asked rows of one group, some ``BLOCK_PAIRS`` comparisons at a time."""
        s = int(edge[0])
        every = np.arange(s, int(np.searchsorted(self.group, self.group[s], side="right")))
        asked = every[self.asked[every]]
        step = max(1, BLOCK_PAIRS // len(every))
        for k in range(0, len(asked), step):
            new = np.repeat(asked[k : k + step], len(every))
            old = np.tile(every, len(asked[k : k + step]))
            may = (self.age[old] <= self.age[new]) & (old != new)
            new, old = new[may], old[may]
            ok = self.possible(new, old, t)
            yield new[ok], old[ok]

    def pairs(self, edge: np.ndarray, t: float, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(younger, older) rows that are possible, of the groups that start at ``edge``; of a group over ``SMALL_GROUP``, enough of the oldest for each younger row."""
        length = np.searchsorted(self.group, self.group[edge], side="right") - edge
        found = []
        if length[0] <= SMALL_GROUP:
            last = np.repeat(edge + length, length) - 1
            todo = np.arange(len(last)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(edge, length)
            lag = 0
            while len(todo):
                lag += 1
                inside = todo + lag <= last
                todo, last = todo[inside], last[inside]
                inside = self.size[todo] >= t * self.size[todo + lag] - 1e-9
                todo, last = todo[inside], last[inside]
                ok = todo[self.possible(todo, todo + lag, t)]
                if len(ok):
                    found.append((ok, ok + lag))
        else:
            s, n = int(edge[0]), int(length[0])
            rows = s + np.argsort(self.age[s : s + n], kind="stable")
            left, hits = np.arange(n), np.zeros(n, np.int64)
            for k in range(n - 1):
                left = left[(left > k) & ((hits[left] <= 2 * most) if most else True)]
                if not len(left):
                    break
                ok = left[self.possible(rows[left], np.full(len(left), rows[k]), t)]
                hits[ok] += 1
                if len(ok):
                    found.append((np.full(len(ok), rows[k]), rows[ok]))
        u, v = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        younger, same = np.where(self.age[u] > self.age[v], u, v), self.age[u] == self.age[v]
        older = np.where(younger == u, v, u)
        # equal codes: either may be the younger one
        return np.concatenate([younger, older[same]]), np.concatenate([older, younger[same]])


PAIR = "new long, old long, key long, age long, size long, parity long, parity2 long"


def meet(rows: DataFrame, t: float, most: int | None, asked: bool = False) -> DataFrame:
    """Possible matches (new, old, key): hashes of sets. With ``asked``, matches of the asked sets only.

    With ``most``, a set with over twice as many in a group sends the ``most`` oldest and the group's key,
    else key is null; groups with such sets also pass on their own rows, as (new: lo, old: null, key, age, size, parity, parity2).
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            met = Met(table, asked)
            for edge in met.blocks():
                if asked and len(edge) == 1:
                    for new, old in met.asked_pairs(edge, t):
                        yield from chosen(met, new, old)
                else:
                    yield from chosen(met, *met.pairs(edge, t, most))

    def chosen(met: Met, new: np.ndarray, old: np.ndarray) -> Iterator[pa.RecordBatch]:
        if asked:
            new, old = new[met.asked[new]], old[met.asked[new]]
        if not len(new):
            return
        by = np.lexsort((met.lo[old], met.age[old], new))
        new, old = new[by], old[by]
        at = np.flatnonzero(np.append(True, new[1:] != new[:-1]))
        n = np.diff(np.append(at, len(new)))
        rank = np.arange(len(new)) - np.repeat(at, n)
        many = np.repeat(n > 2 * most, n) if most else np.zeros(len(new), dtype=bool)
        keep = ~many | (rank < most) if most else ~many
        new, old, many = new[keep], old[keep], many[keep]
        long = pa.nulls(len(new), pa.int64())
        yield _arrow(new=met.lo[new], old=met.lo[old], key=pa.array(met.key[new], mask=~many), age=long, size=long, parity=long, parity2=long)
        if many.any():
            whole = np.flatnonzero(np.isin(met.group, met.group[new[many]]))
            yield _arrow(new=met.lo[whole], old=pa.nulls(len(whole), pa.int64()), key=met.key[whole], age=met.age[whole], size=met.size[whole] << 32 | met.room[whole], parity=met.p[whole], parity2=met.q[whole])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, PAIR)


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """(lo, hi) of the sets that an older set of their pairs matches. ``pairs``: (new, old), different."""
    wanted = pairs.select(F.col("new").alias("lo")).union(pairs.select(F.col("old").alias("lo"))).distinct()
    places = sets.join(wanted, "lo").groupBy("low.id", "low.th").agg(F.collect_list(F.struct("low.line", "lo", "hi")).alias("wanted"))
    places = stage(places.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "wanted"), "lines-wanted")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    n, n_sets = places.agg(F.count("*"), F.sum(F.size("wanted"))).first()
    found = docs.join(few(places.select("_id", "_th"), n), same, "left_semi").join(places, same).select("id", "th", "text", "wanted")
    kind = docs.schema["id"].dataType.simpleString()

    @releasing
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The wanted sets and their words."""
        for part in chunks(batches, "text", CHUNK_BYTES):
            sets = LineSets(part.column("text"))
            every = pa.ListArray.from_arrays(pa.array(np.append(sets.begin, len(sets.words)).astype(np.int32)), pa.array(sets.words.view(np.int64)))
            lists = part.column("wanted")
            asked = {f.name: c.to_numpy() for f, c in zip(lists.type.value_type, lists.flatten().flatten(), strict=True)}
            row = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(lists).to_numpy())
            place = np.searchsorted(sets.text << 40 | sets.number, row << 40 | asked["line"])
            take = pa.array(row)
            yield _arrow(lo=asked["lo"], hi=asked["hi"], id=part.column("id").take(take), th=part.column("th").take(take), line=asked["line"], words=every.take(pa.array(place)))

    stored = whole = stage(found.mapInArrow(read, f"lo long, hi long, id {kind}, th long, line long, words array<bigint>"), "sets-wanted")
    if n and whole.count() > n_sets:  # rows that repeat id and text
        whole = whole.dropDuplicates(["lo", "hi"])
    whole = whole.select("lo", "hi", F.struct("id", "th", "line").alias("low"), "words")
    named = lambda w: whole.select(*[F.col(c).alias(f"{w}_{c}") for c in whole.columns])
    young = pairs.join(named("new"), F.col("new") == F.col("new_lo")).drop("new_lo")
    count = stage(pairs.groupBy("old").agg(F.count("*").alias("n")), "old-counts")
    both = heavy_join(young, named("old").withColumnRenamed("old_lo", "old"), "old", count, "new")
    common = F.size(F.array_intersect("new_words", "old_words"))
    like = common >= t * (F.size("new_words") + F.size("old_words") - common) - 1e-9
    dead = stage(both.filter(F.col("old_low") < F.col("new_low")).filter(like).select(F.col("new").alias("lo"), F.col("new_hi").alias("hi")).distinct(), "sets-gone")
    for df in (stored, places, count):
        unstage(df)
    return dead


def similar_lines(docs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """(id, th, line): the lines to remove, from rows (id, th, text)."""
    table = line_table(docs)
    lines = table.filter("part is null").select("id", "th", "line", "lo", "hi")
    sets = stage(lines.groupBy("lo", "hi").agg(F.min(F.struct("id", "th", "line")).alias("low"), F.count("*").alias("n")), "line-set-ages")
    counted = rarity_classes(table)
    classes = docs.sparkSession.sparkContext.broadcast(counted)
    found = stage(meet(prefix_rows(with_ages(docs), classes, t), t, OLDEST), "line-pairs")
    classes.destroy()  # else driver and executors keep its BUCKETS bytes
    del counted, classes
    pairs = stage(found.filter("old is not null").select("new", "old").distinct(), "different-pairs")
    dead = verified(docs, sets, pairs, t)
    # sets with other possible matches than those that failed meet them all
    rest = found.filter("old is not null and key is not null").select("key", F.col("new").alias("lo")).distinct()
    rest = stage(rest.join(dead.select("lo"), "lo", "left_anti"), "sets-undecided")
    unstage(pairs)
    n = rest.count()
    if n:
        again = found.filter("old is null").select("key", "age", F.col("new").alias("lo"), "size", "parity", "parity2")
        again = again.join(few(rest.select("key").distinct(), n), "key", "left_semi")
        again = again.join(few(rest.withColumn("asked", F.lit(True)), n), ["key", "lo"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        others = stage(meet(again, t, None, asked=True).select("new", "old").distinct(), "line-pairs")
        dead = dead.union(verified(docs, sets, others, t)).distinct()
    unstage(found)
    gone = sets.select("lo", "hi", "low", "n").join(dead.withColumn("dead", F.lit(True)), ["lo", "hi"], "left").filter("n > 1 or dead")
    gone = stage(gone.select(F.struct("lo", "hi").alias("set"), "low", "n", F.coalesce("dead", F.lit(False)).alias("dead")), "sets-to-thin")
    lines = lines.select(F.struct("lo", "hi").alias("set"), "id", "th", "line")
    found = heavy_join(lines, gone.drop("n"), "set", gone.select("set", "n"), ["id", "th", "line"])
    out = stage(found.filter(F.col("dead") | (F.struct("id", "th", "line") > F.col("low"))).select("id", "th", "line").distinct(), "similar-lines")
    for df in (table, sets, rest, gone):
        unstage(df)
    return out


@F.arrow_udf(StringType())
def without_lines(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines of these numbers."""
    out = []
    for t, numbers in zip(text.to_pylist(), gone.to_pylist(), strict=True):
        drop = set(numbers or ())
        out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop) if drop else t)
    return pa.array(out, pa.string())


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: float = SIMILARITY, counts: tuple[str, str] | None = ("_n_lines", "_n_removed")) -> DataFrame:
    """All rows and columns of ``docs`` without the lines that an earlier line matches, plus the columns ``counts``: lines, and lines removed.

    Lines are cut at newlines, words at blanks, A-Z lower-cased. A line goes if it has a word and its
    Jaccard similarity with any earlier line is ``t`` or more, whether or not that line goes too; earlier
    means a lower id (null first; any type that can be ordered), then, for equal ids, a lower hash of the text, then a lower
    line number. Rows that repeat id and text are one document and get one answer. Lines without words stay. Null texts stay null, with no lines;
    an empty table gives an empty one. Other columns pass through, whatever their names; only a column named as in ``counts`` is
    replaced (``counts=None`` adds none).
    """
    th, gone_id, gone_th, gone_lines = (free_name(docs, x) for x in ("th", "gone_id", "gone_th", "gone_lines"))
    keyed = docs.withColumn(th, F.xxhash64(text_col))
    rows = keyed.select(F.col(id_col).alias("id"), F.col(th).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gone = similar_lines(rows, t).groupBy(F.col("id").alias(gone_id), F.col("th").alias(gone_th)).agg(F.collect_set("line").alias(gone_lines))
    gone = stage(gone, "lines-gone")
    n = gone.count()
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(th) == F.col(gone_th))
    names = counts or (gone_id, gone_th)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n"))).cast("long").alias(names[0])
    own = [c for c in docs.columns if c.lower() not in {x.lower() for x in names}]

    def shown(df: DataFrame, cut: bool) -> DataFrame:
        text = without_lines(text_col, gone_lines).alias(text_col) if cut else F.col(text_col)
        n_gone = F.coalesce(F.size(gone_lines), F.lit(0)) if cut else F.lit(0)
        return df.select(*[text if c == text_col else F.col(c) for c in own], n_lines, n_gone.cast("long").alias(names[1]))

    if n <= BROADCAST_ROWS:  # documents that lose nothing don't move
        ids = F.broadcast(gone.select(gone_id, gone_th))
        cut = keyed.join(ids, same, "left_semi").join(gone, same)
        out = shown(keyed.join(ids, same, "left_anti"), False).union(shown(cut, True))
    else:
        out = shown(keyed.join(gone, same, "left"), True)
    return out if counts else out.drop(*names)
