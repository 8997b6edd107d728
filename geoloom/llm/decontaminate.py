"""Benchmark decontamination over a stored positional inverted index of the training text.

The index is cut into segments of bounded text. A segment has one row for each of its terms, with
the term's word positions in the segment as a posting list, and one directory row naming its
documents. Windows of the items are rows too, their terms numbered. A window is joined to the segments that have its
rarest term, and travels to these only; there, lists shifted by each term's offset in the phrase are
intersected, from the rarest term of the whole corpus on. A rarest term that is in very many segments is
dealt out by segment. Nothing passes through the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.shared import LETTERS_DIGITS, LOWER, chunks, cut, extent, few, free_name, heavy_join, is_few, releasing, stage, text_bytes, unstage, word_bounds

SEGMENT_BYTES = 2 << 20
DIRECTORY, NO_TERM = "", -1
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def index_rows(ids: pa.Array, column: pa.Array, segment: int) -> pa.RecordBatch:
    """Rows of one segment."""
    raw, at = text_bytes(column)
    raw = LOWER[raw]
    starts, ends, n_words = word_bounds(raw, at, LETTERS_DIGITS)
    coded = cut(raw, starts, ends).dictionary_encode()
    codes = coded.indices.to_numpy()
    n_terms = len(coded.dictionary)
    offsets = np.zeros(n_terms + 2, dtype=np.int32)
    np.cumsum(4 * np.bincount(codes, minlength=n_terms), out=offsets[1:-1])
    offsets[-1] = offsets[-2]
    positions = np.argsort(codes, kind="stable").astype(np.int32)
    postings = pa.Array.from_buffers(pa.binary(), n_terms + 1, [None, pa.py_buffer(offsets), pa.py_buffer(positions)])
    terms = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([DIRECTORY])])
    listed = lambda values: pa.ListArray.from_arrays(pa.array(np.append(np.zeros(n_terms + 1, np.int32), np.int32(len(values)))), values)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n_terms + 1, segment)), terms, postings, listed(ids), listed(pa.array(n_words.astype(np.int64)))], ["segment", "term", "postings", "doc_ids", "doc_words"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents, stored in the shared folder: segment, term, postings, doc_ids, doc_words.

    Words are ``WORD`` after lower-casing A-Z. Null and empty texts are in the directory with no
    words. Ids may have any type; null and repeated ids are kept as they are. A segment is one task's own run of rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, part in enumerate(chunks(batches, "_t", SEGMENT_BYTES)):
            yield index_rows(part.column("doc_id"), part.column("_t"), first + k)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return stage(rows.mapInArrow(run, f"segment long, term string, postings binary, doc_ids array<{kind}>, doc_words array<bigint>"), "positions")


def _phrase(lists: dict[int, np.ndarray], order: list[tuple[int, int]]) -> np.ndarray:
    """Start positions of the phrase whose (offset, code) pairs come rarest first."""
    for _, term in order:
        if term not in lists:
            return np.zeros(0, np.int32)
    found = lists[order[0][1]] - np.int32(order[0][0])
    for offset, term in order[1:]:
        if not len(found):
            break
        have = lists[term]
        place = np.minimum(np.searchsorted(have, found + offset), len(have) - 1)
        found = found[have[place] == found + offset]
    return found


def _near(lists: dict[int, np.ndarray], terms: list[int], within: int) -> np.ndarray:
    """First positions of the spans of up to ``within`` words that have all terms, smallest span for each end."""
    if any(t not in lists for t in terms):
        return np.zeros((0, 2), np.int64)
    rare = min((lists[t] for t in terms), key=len).astype(np.int64)
    spans = []
    for p in rare:
        parts = [lists[t][np.searchsorted(lists[t], p - within + 1) : np.searchsorted(lists[t], p + within)] for t in terms]
        merged = sorted((int(x), k) for k, part in enumerate(parts) for x in part)
        last = [None] * len(terms)
        for x, k in merged:
            last[k] = x
            if None not in last and x - min(last) < within and min(last) <= p <= x:
                spans.append((min(last), x + 1))
    return np.array(sorted(set(spans)), dtype=np.int64).reshape(-1, 2)


def windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored: (wid, words), each different window once, and (wid, item): the items that have it.

    An item of fewer words than ``window``, but not none, is one window. Windows of items without an id count, but name no item.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, SMALL)
    words = items.select(F.col(id_col).cast("string").alias("item"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("all")).filter("size(all) > 0").distinct()
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - window + 1)))
    each = words.select("item", "all", at.alias("i")).select("item", F.slice("all", F.col("i"), F.lit(window)).alias("words")).distinct()
    named = stage(each.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return named, stage(each.filter("item is not null").join(named, "words").select("wid", "item"), "window-items")


def plans(named: DataFrame, counts: DataFrame, few_terms: bool) -> DataFrame:
    """(wid, rare, n, offsets, codes) of the windows whose terms all occur: the code of the rarest term, the window's length, offsets and codes rarest first."""
    placed = named.select("wid", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
    known = placed.join(F.broadcast(counts) if few_terms else counts, "term")
    steps = known.groupBy("wid", "n").agg(F.sort_array(F.collect_list(F.struct("count", "offset", "code"))).alias("steps"))
    return steps.filter("size(steps) = n").select("wid", F.col("steps")[0]["code"].alias("rare"), "n", F.col("steps.offset").alias("offsets"), F.col("steps.code").alias("codes"))


def search(index: DataFrame, named: DataFrame, within: int | None = None) -> DataFrame:
    """Stored: rows (segment, place, doc_id, n_words, n_hit), one for each document, and rows (segment, place, wid, start, end), one for each match.

    ``named``: windows (wid, words). By default a window matches as an exact phrase; with ``within``, it matches
    wherever all its words stand, in any order, inside ``within`` words. ``n_hit`` counts document
    words inside a match; start and end are words of the document. Matches cross no document. No windows, no matches.
    """
    terms = stage(named.select(F.explode("words").alias("term")).distinct().withColumn("code", F.monotonically_increasing_id()), "query-terms")
    few_terms = is_few(*extent(terms, F.length("term") + 48))
    # not a list of Python rows, for which each executor would start a second Python daemon with workers of its own
    directory = terms.sparkSession.range(1).select(F.lit(DIRECTORY).alias("term"), F.lit(NO_TERM).cast("long").alias("code"))
    wanted = terms.union(directory)
    lists = index.join(F.broadcast(wanted) if few_terms else wanted, "term").drop("term")
    held = lists.filter(F.col("code") != NO_TERM)
    sums = held.groupBy("code").agg(F.sum(F.length("postings") / 4).cast("long").alias("count"), F.count("*").alias("segments"))
    counts = stage(terms.join(sums, "code"), "term-counts")
    planned = stage(plans(named, counts, few_terms), "window-plans")
    # a window goes to the segments of its rarest term
    at, plan_size = held.select("segment", F.col("code").alias("rare")), extent(planned, 16 * F.col("n") + 128)
    if is_few(*plan_size):
        met = at.join(F.broadcast(planned), "rare")
    else:
        rarest = counts.select(F.col("code").alias("rare"), F.col("segments").alias("n")).join(planned.select("rare").distinct(), "rare", "left_semi")
        met = heavy_join(at, planned, "rare", rarest, "segment")
    asked = met.select("segment", "wid", "n", "offsets", "codes")
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    stored = lists.select("segment", F.lit(0).alias("what"), "code", "postings", "doc_ids", "doc_words", none("long").alias("wid"), none("int").alias("n"), none("array<int>").alias("offsets"), none("array<long>").alias("codes"))
    both = stored.union(asked.select("segment", F.lit(1), none("long"), none("binary"), none(f"array<{kind}>"), none("array<bigint>"), "wid", "n", "offsets", "codes"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have, ids, ends, step = None, {}, None, None, None
        names = ["segment", "place", "doc_id", "n_words", "n_hit", "wid", "start", "end"]

        def documents() -> pa.RecordBatch:
            """The documents of the segment that ends."""
            n = np.diff(np.append(0, ends))
            hit = np.append(0, np.cumsum(np.cumsum(step[:-1]) > 0))
            columns = [np.full(len(n), now), np.arange(len(n)), None, n, hit[ends] - hit[ends - n]]
            return pa.RecordBatch.from_arrays([ids if c is None else pa.array(c.astype(np.int64)) for c in columns] + [pa.nulls(len(n), pa.int64())] * 3, names)

        for batch in batches:
            segments = batch.column("segment").to_numpy()
            for s in np.flatnonzero(np.append(True, segments[1:] != segments[:-1])).tolist() if len(segments) else ():
                stop = int(np.searchsorted(segments, segments[s], side="right"))
                part = batch.slice(s, stop - s)
                if segments[s] != now:
                    if ids is not None:
                        yield documents()
                    now, have, ids = segments[s], {}, None
                table = part.filter(pa.compute.equal(part.column("what"), 0))
                for code, postings, doc_ids, n in zip(*[table.column(c) for c in ("code", "postings", "doc_ids", "doc_words")], strict=True):
                    if code.as_py() == NO_TERM:
                        ids, ends = doc_ids.values, np.cumsum(n.values.to_numpy())
                        step = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int32)
                    else:
                        have[code.as_py()] = np.frombuffer(postings.as_buffer(), dtype=np.int32)
                found = []
                asks = part.filter(pa.compute.equal(part.column("what"), 1))
                for wid, length, offsets, codes in zip(*[asks.column(c).to_pylist() for c in ("wid", "n", "offsets", "codes")], strict=True):
                    if within is None:
                        starts = _phrase(have, list(zip(offsets, codes, strict=True))).astype(np.int64)
                        spans = np.stack([starts, starts + length], axis=1)
                    else:
                        spans = _near(have, sorted(set(codes)), within)
                    if len(spans):
                        doc = np.searchsorted(ends, spans[:, 0], side="right")
                        inside = spans[:, 1] <= ends[np.minimum(doc, len(ends) - 1)]
                        found.append((np.full(int(inside.sum()), wid), doc[inside], spans[inside]))
                if found:
                    wid, doc, spans = (np.concatenate([f[k] for f in found]) for k in range(3))
                    np.add.at(step, spans[:, 0], 1)
                    np.add.at(step, spans[:, 1], -1)
                    begin = np.append(0, ends)[doc]
                    columns = [np.full(len(doc), now), doc, None, None, None, wid, spans[:, 0] - begin, spans[:, 1] - begin]
                    kinds = [pa.int64(), pa.int64(), ids.type, *[pa.int64()] * 5]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(doc), t) if c is None else pa.array(c.astype(np.int64)) for c, t in zip(columns, kinds, strict=True)], names)
        if ids is not None:
            yield documents()

    dealt = both.repartition("segment").sortWithinPartitions("segment", "what")
    found = stage(dealt.mapInArrow(run, f"segment long, place long, doc_id {kind}, n_words long, n_hit long, wid long, start long, end long"), "matches")
    for df in (terms, counts, planned):
        unstage(df)
    return found


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, within: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids of the items that match, sorted as strings), contaminated (hits are a twentieth of the words or more).

    One row for each row of ``docs``, repeated ones too. Null and empty texts have no words and are clean. Items without an id
    count as hits and are not listed; repeated items count once. An empty table of documents or items gives no row, or no hits. Other columns are ignored.
    """
    index = build_index(docs, id_col, text_col)
    named, of_items = windows(items, window, item_col, item_text_col)
    found = search(index, named, within)
    unstage(index)
    met = found.filter("wid is not null").select("segment", "place", "wid").distinct().join(of_items, "wid")
    listed = stage(met.groupBy("segment", "place").agg(F.sort_array(F.collect_set("item")).alias("items")), "document-items")
    out = found.filter("wid is null").join(few(listed, *extent(listed, F.length(F.array_join("items", ",")) + 16 * F.size("items") + 64)), ["segment", "place"], "left")
    items_of = F.coalesce("items", F.array().cast("array<string>")).alias("items")
    return out.select("doc_id", "n_words", "n_hit", items_of, ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns kept, whatever their names. Rows that repeat id and text go or stay together; null ids are ids like others."""
    key, bad = free_name(docs, "key"), free_name(docs, "bad")
    keyed = docs.withColumn(key, F.struct(F.col(id_col), F.xxhash64(text_col), F.length(text_col)))
    rejected = contamination(keyed, items, window, id_col=key, text_col=text_col).filter("contaminated").select(F.col("doc_id").alias(bad)).distinct()
    rejected = stage(rejected, "contaminated")
    return keyed.join(few(rejected, rejected.count()), F.col(key).eqNullSafe(F.col(bad)), "left_anti").select(*docs.columns)


ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '{WORD}') as w from documents),
b as (select distinct item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '{WORD}') as w from benchmark),
q as (select distinct item, least(13, len(w)) as n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as p from (select *, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0)),
n as (select distinct n from q),
s as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as p from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, n where len(w) >= n)),
m as (select s.r, s.i, s.n, q.item from s join q using (n, p)),
h as (select r, count(distinct x) as n_hit from (select r, unnest(range(i, i + n)) as x from m) group by r),
t as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join h using (r) left join t using (r)
"""
