"""Importance resampling towards a target text, by hashed n-grams in Arrow kernels.

Words come from ``ascii_lower``, ``split_pattern_regex`` and ``list_flatten``; ``dictionary_encode`` numbers them, and again the pairs of
shifted numbers, so each different run of words of a chunk is hashed once, from its first word's or words' CRC on. ``take``
spreads bucket gains over the runs, and a segment sum adds them up by document. Two passes read the texts: one counts buckets, one scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.shared import chunks, releasing, stage, unsliced, unstage

CHUNK_BYTES = 4 << 20
BUCKETS, RUN = 10_000, 3
SEED, SHARE, LEAST_WORDS = 42, (5, 100), 20
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def run_buckets(column: pa.Array, buckets: int = BUCKETS, run: int = RUN) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each length of runs from 1 to ``run`` the bucket and the text of every run."""
    lists = pc.split_pattern_regex(pc.ascii_lower(unsliced(column)), NOT_WORDS)
    words = pc.list_flatten(lists)
    text = np.repeat(np.arange(len(column)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    there = pc.greater(pc.binary_length(words), 0)  # before a first and after a last separator
    words, text = words.filter(there), text[there.to_numpy(zero_copy_only=False)]
    coded = words.dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    tails = [b" " + w.encode() for w in coded.dictionary.to_pylist()]
    crc = np.fromiter((zlib.crc32(t[1:]) for t in tails), np.uint32, len(tails))
    code, found = word, [(crc[word] % buckets, text)]
    for k in range(1, run):
        # the run that starts one word earlier, and the word after it
        same = text[k:] == text[:-k] if len(text) > k else np.zeros(0, bool)
        pair = (code[: len(same)] * max(1, len(tails)) + word[k:])[same]
        coded = pa.array(pair).dictionary_encode()
        head, tail = np.divmod(coded.dictionary.to_numpy(), max(1, len(tails)))
        crc = np.fromiter((zlib.crc32(tails[t], h) for h, t in zip(crc[head].tolist(), tail.tolist(), strict=True)), np.uint32, len(head))
        mine = coded.indices.to_numpy().astype(np.int64)
        code = np.zeros(len(same), np.int64)
        code[same] = mine
        found.append((pc.take(pa.array(crc), pa.array(mine)).to_numpy() % buckets, text[: len(same)][same]))
    return np.bincount(text, minlength=len(column)), found


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Runs of all rows by bucket. A task sends one number for each bucket, the driver gets one row for each."""

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in chunks(batches, "_t", CHUNK_BYTES):
            for bucket, _ in run_buckets(part.column("_t"), buckets, run)[1]:
                total += np.bincount(bucket, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    counted = rows.select(F.col(text_col).alias("_t")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # up to ``buckets`` rows
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for each of B buckets."""
    n = len(corpus)
    all_s, all_t = float(corpus.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; ranks 1, 2, 3... go to the ``share`` of the highest scores among rows of enough words.

    Scores are weights with Gumbel noise that follows from the id, so that the highest are a sample without replacement in proportion to the weights' exponentials.
    Ties go to the smaller id (null ids first, their noise is that of an empty id); rows that repeat an id have its noise each. Null and empty
    texts have no features, weight 0 and no rank. Ids may be of any type that can be ordered. An empty table gives an empty one, an
    empty target gains that tell nothing of it. Other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    kind = dict(docs.dtypes)[id_col]

    @releasing
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = pa.array(gains)
        for part in chunks(batches, "_t", CHUNK_BYTES):
            n_words, found = run_buckets(part.column("_t"))
            features, weight = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
            for bucket, text in found:  # texts ascend
                total = np.concatenate([[0], np.cumsum(pc.take(by_bucket, pa.array(bucket.astype(np.int64))).to_numpy())])
                edge = np.searchsorted(text, np.arange(len(n_words) + 1))
                features += np.diff(edge)
                weight += np.diff(total[edge])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(features), pa.array(weight), pa.array(n_words >= least_words)], ["doc_id", "n_features", "weight", "enough"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")).mapInArrow(weigh, f"doc_id {kind}, n_features long, weight long, enough boolean")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    # written before they are ranged: a range partitioning reads its rows twice, once to find its bounds
    scored = stage(rows.withColumn("score", F.col("weight") + gumbel), "resample-scores")
    # ranges in the order of the ranks, written once so that a row keeps its place
    order = [F.desc("score"), F.asc("doc_id"), F.desc("weight")]
    ranges = scored.repartitionByRange(F.col("enough").desc(), *order).sortWithinPartitions(F.col("enough").desc(), *order)
    placed = stage(ranges.withColumn("_at", F.monotonically_increasing_id()), "resample-order")
    unstage(scored)
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.sum(F.col("enough").cast("long")).alias("n"))  # one row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", before.alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    drawn = F.floor(F.lit(share[0]) * F.col("all") / share[1])
    rank = F.col("before") + place + 1
    joined = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(parts), "_part")
    return joined.select("doc_id", "n_features", "weight", "score", F.when(F.col("enough") & (rank <= drawn), rank).cast("long").alias("rank"))
