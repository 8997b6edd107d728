"""Language of a text by one Bloom filter of n-grams for each language, sliced so that a look-up returns all languages at once.

Character n-grams of words (with the blanks around them) are counted by language over all labelled texts. A language contains the grams that
make up ``LEAST_RATE`` of its grams or more, unless another uses them far more, so its filter has at most 1 / ``LEAST_RATE`` grams, however large the
corpus is. A place of the filters holds one bit for each language; the bits of a gram's places, and-ed, are the languages that contain it.
A text's hits are counted by language, less those that the language's fill makes by chance, and the highest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.shared import ODD, chunks, cut, merged, mix, releasing, stage, text_bytes, unsliced, unstage

CHUNK_BYTES = 2 << 20
LONGEST_GRAM = 5
#: Share of a language's grams that makes one its own, and share of the highest rate of any language below which one is taken for foreign matter.
LEAST_RATE, LEAST_SHARE = 4e-6, 0.05
#: Places of a filter for each gram of the language that has the most, and places that a gram sets.
PLACES_PER_GRAM, HASHES = 12, 4
#: Places of the filters in one row while they are made.
BLOCK = 1 << 16
#: Different grams that a task counts before it sends them on.
HELD_GRAMS = 1 << 20
NONE = "und"


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point, whether it is a letter, and whether it is a letter or a mark, of which words are made."""
    every = "".join(map(chr, [*range(0xD800), *[0x20] * 0x800, *range(0xE000, 0x110000)]))
    out = np.zeros((2, 0x110000), bool)
    for k, pattern in enumerate((r"\p{L}+", r"[\p{L}\p{M}]+")):
        for m in regex.finditer(pattern, every):
            out[k, m.start() : m.end()] = True
    return out[0], out[1]


@dataclass
class Words:
    """Words of texts end to end: where each text's begin, each word's code, the different words, and whether a text has a letter."""

    at: np.ndarray
    codes: np.ndarray
    words: list[str]
    has_letter: np.ndarray


def words_of(column: pa.Array) -> Words:
    raw, at = text_bytes(pc.utf8_lower(unsliced(column)))
    place = np.flatnonzero((raw & 0xC0) != 0x80)  # of each character
    code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    letter, member = (table[code] for table in letters())
    text_at = np.searchsorted(place, at)
    edge = np.zeros(len(code) + 1, bool)
    edge[text_at] = True
    starts = np.flatnonzero(member & (edge[:-1] | ~np.append(False, member[:-1])))
    ends = np.flatnonzero(member & (edge[1:] | ~np.append(member[1:], False))) + 1
    limit = np.append(place, len(raw))
    coded = cut(raw, limit[starts], limit[ends]).dictionary_encode()
    n_letters = np.concatenate([[0], np.cumsum(letter)])[text_at]
    return Words(np.searchsorted(starts, text_at), coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), np.diff(n_letters) > 0)


def grams_of(words: list[str], longest: int = LONGEST_GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every gram of the words, and the word that each belongs to; single blanks are none."""
    code = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = code == 0x20
    word = np.cumsum(blank) - 1  # a blank belongs to the word after it
    last = np.append(np.flatnonzero(blank)[1:], -1)[word]  # the blank after the word
    h, hashes, of = np.full(len(code), np.uint64(ODD)), [], []
    for n in range(longest):
        at = np.flatnonzero(np.arange(len(code)) + n <= last)
        h = mix(h[: len(code) - n] * np.uint64(ODD) + code[n:]) if n < len(code) else h[:0]
        if n == 0:
            at = at[~blank[at]]
        hashes.append(h[at])
        of.append(word[at])
    return np.concatenate(hashes), np.concatenate(of)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of rows (lang, _t)."""

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def rows_of(sums: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for lang, (grams, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

        for part in chunks(batches, "_t", CHUNK_BYTES):
            for lang in part.column("lang").unique().to_pylist():
                found = words_of(part.column("_t").filter(pc.equal(part.column("lang"), lang)))
                grams, of = grams_of(found.words)
                held.setdefault(lang, []).append(merged([grams.view(np.int64)], [np.bincount(found.codes, minlength=len(found.words))[of]]))
                size += len(held[lang][-1][0])
            if size > HELD_GRAMS:
                sums = {lang: merged(*zip(*lists, strict=True)) for lang, lists in held.items()}
                held, size = {lang: [one] for lang, one in sums.items()}, sum(len(grams) for grams, _ in sums.values())
                if size > HELD_GRAMS // 2:
                    held, size = {}, 0
                    yield from rows_of(sums)
        yield from rows_of({lang: merged(*zip(*lists, strict=True)) for lang, lists in held.items()})

    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the rows of each segment between one place of ``at`` and the next."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return np.diff(total[at], axis=0)


@dataclass(frozen=True)
class Filters:
    """Names of the languages, and their filters: bytes of language bits for each place; chance of a false hit in each."""

    langs: list[str]
    bits: np.ndarray
    chance: np.ndarray

    def languages_of(self, grams: np.ndarray) -> np.ndarray:
        """(grams, languages): whether the language contains the gram."""
        found = np.bitwise_and.reduce([self.bits[at] for at in places(grams, len(self.bits))])
        return np.unpackbits(found, axis=1, count=len(self.langs), bitorder="little")


def places(grams: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of each gram among ``size``, a power of two."""
    step = mix(grams ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return [((grams + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


def learn(rows: DataFrame, least_rate: float = LEAST_RATE, least_share: float = LEAST_SHARE) -> Filters:
    """Filters of all languages in rows (lang, _t). The driver gets the names of the languages and the filters, whose size is bounded by ``least_rate``."""
    spark = rows.sparkSession
    counts = stage(gram_counts(rows), "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))  # one row for each language
    langs = sorted((lang, n) for lang, n in totals.collect())
    numbered = spark.createDataFrame([(lang, k, n) for k, (lang, n) in enumerate(langs)], "lang string, k int, all long")
    own = counts.join(F.broadcast(numbered), "lang").select("k", "gram", (F.col("n") / F.col("all")).alias("rate")).filter(F.col("rate") >= least_rate)
    by_gram = own.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("k", "rate")).alias("of"))  # a gram has a row for each language at most
    chosen = by_gram.select("gram", F.filter("of", lambda x: x["rate"] >= least_share * F.col("top"))["k"].alias("langs"))
    chosen = stage(chosen, "language-grams")
    unstage(counts)
    most = chosen.select(F.explode("langs").alias("k")).groupBy("k").count().agg(F.max("count")).first()[0] or 1
    size, width = max(BLOCK, 1 << (most * PLACES_PER_GRAM - 1).bit_length()), max(1, -(-len(langs) // 8))

    @releasing
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("langs")
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            lang = lists.flatten().to_numpy()
            for at in places(batch.column("gram").to_numpy().view(np.uint64)[of], size):
                # equal bits of a batch are sent once
                block, rest = np.divmod(np.unique(at * max(1, len(langs)) + lang), BLOCK * max(1, len(langs)))
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(rest)], ["block", "bit"])

    def fill(table: pa.Table) -> pa.Table:
        at, lang = np.divmod(table["bit"].to_numpy(), len(langs))
        bits = np.zeros((BLOCK, width), np.uint8)
        np.bitwise_or.at(bits, (at, lang >> 3), (1 << (lang & 7)).astype(np.uint8))
        return pa.table({"block": table["block"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    bits = np.zeros((size, width), np.uint8)
    for block, data in chosen.mapInArrow(place, "block long, bit long").groupBy("block").applyInArrow(fill, "block long, bits binary").collect():
        bits[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(data, np.uint8).reshape(BLOCK, width)
    unstage(chosen)
    full = sum(np.unpackbits(part, axis=1, count=len(langs), bitorder="little").sum(axis=0, dtype=np.int64) for part in np.split(bits, size // BLOCK)) / size
    return Filters([lang for lang, _ in langs], bits, full**HASHES)


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row. The score is the language's share of all languages' corrected hits.

    Texts that are null or have no letter are ``und`` with score 0, as are all if no language is known. Ties, and texts without any hit, go to the first language by name.
    """
    kind = dict(docs.dtypes)[id_col]
    known = docs.sparkSession.sparkContext.broadcast(filters)

    @releasing
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = known.value
        names = np.array([*f.langs, NONE], dtype=object)
        for part in chunks(batches, "_t", CHUNK_BYTES):
            found = words_of(part.column("_t"))
            grams, of = grams_of(found.words)
            by = np.argsort(of, kind="stable")
            edge = np.searchsorted(of[by], np.arange(len(found.words) + 1))
            hits = sums(f.languages_of(grams[by]), edge)  # by word
            n, hits = sums(np.diff(edge)[found.codes], found.at), sums(hits[found.codes], found.at)  # by text
            corrected = np.maximum(0, (hits - n[:, None] * f.chance) / (1 - f.chance))
            every, top = corrected.sum(axis=1), corrected.max(axis=1, initial=0)
            able = found.has_letter & (len(f.langs) > 0)
            best = corrected.argmax(axis=1) if len(f.langs) else 0
            score = np.where(able & (every > 0), top / np.where(every > 0, every, 1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[np.where(able, best, len(f.langs))], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")).mapInArrow(decide, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learnt from the labelled rows that aren't held out.

    Held out are ids whose CRC-32 as text leaves ``held_fold`` modulo ``folds``; a null id counts as an empty text. Rows whose label is null teach nothing and are judged like others. Repeated
    rows are rows of their own. An empty table gives an empty one. Other columns are ignored.
    """
    fold = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % folds == held_fold
    taught = docs.filter(~fold(id_col) & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("_t"))
    return predict(docs, learn(taught), id_col, text_col).select("doc_id", fold("doc_id").alias("held_out"), "lang_pred", "score")
