"""Exact Jaccard similarity of sets of word shingles, for sets that are linked already.

What links connect is a family. Each set of a family goes to it once, and all its pairs (in blocks,
if it is large) are decided on whole sets there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.components import components
from geoloom.llm.line_dedup import word_hashes
from geoloom.llm.shared import LOWER, NOT_BLANK, ODD, chunks, few, mix, releasing, stage, text_bytes, whole_groups, word_bounds

CHUNK_BYTES = 1 << 20
#: Sets of a family that one comparison block holds at most; larger families are cut into pairs of blocks.
BLOCK = 1024


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of each text, as 64-bit hashes end to end, and how many each text has.

    Words are cut at blanks, A-Z lower-cased. A text of fewer than ``width`` words is one shingle, one without words none.
    """
    raw, at = text_bytes(column)
    raw = LOWER[raw]
    starts, ends, n_words = word_bounds(raw, at, NOT_BLANK)
    words = word_hashes(raw, starts, ends)
    n = np.where(n_words > 0, np.maximum(1, n_words - width + 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    lead = (np.cumsum(n_words) - n_words)[text] + np.arange(len(text)) - (np.cumsum(n) - n)[text]
    end = np.cumsum(n_words)[text]
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(width):
        inside = lead + k < end
        out[inside] = mix(out[inside] * np.uint64(ODD) + words[lead[inside] + k])
    by = np.lexsort((out, text))
    out, text = out[by], text[by]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[new], np.bincount(text[new], minlength=len(n))


def forest(flat: np.ndarray, size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the graph of similarity ``t`` or more between sets that lie end to end."""
    codes = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    begin = np.cumsum(size) - size
    mark = np.zeros(int(codes.max()) + 1, dtype=np.int8)
    open_, words, queue, found = np.arange(len(size)), codes, [], []
    while len(open_):
        if not queue:  # the next component's first set
            queue.append(int(open_[0]))
            words, open_ = words[size[open_[0]] :], open_[1:]
            continue
        i = queue.pop()
        mine = codes[begin[i] : begin[i] + size[i]]
        mark[mine] = 1
        common = np.add.reduceat(mark[words], np.cumsum(size[open_]) - size[open_], dtype=np.int32)
        mark[mine] = 0
        hit = common >= t * (size[open_] + size[i] - common) - 1e-9
        if hit.any():
            found.append((np.full(int(hit.sum()), i), open_[hit]))
            queue += open_[hit].tolist()
            words, open_ = words[np.repeat(~hit, size[open_])], open_[~hit]
    u, v = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
    return u, v


def similar_sets(rows: DataFrame, sets: DataFrame, links: DataFrame, width: int, t: float) -> DataFrame:
    """Links (u, v) between set_ids that span the pairs of similarity ``t`` or more inside each family of ``links``.

    ``rows`` has rk and text _t, ``sets`` has set_id and the rk of one of its rows.
    """
    family = stage(components(links).withColumnRenamed("node", "set_id"), "shingle-families")
    sizes = family.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = stage(sets.select("set_id", "rk").join(family, "set_id").join(sizes, "root"), "sets-wanted")
    found = rows.join(few(wanted, wanted.count()), "rk").select("set_id", "root", "blocks", "_t")

    @releasing
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_t", CHUNK_BYTES):
            shingles, n = shingle_sets(part.column("_t"), width)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(shingles.view(np.int64)))
            names = ["set_id", "root", "blocks"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], lists], [*names, "shingles"])

    @releasing
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            table = table.combine_chunks()
            cell, node, lists = table["cell"].to_numpy(), table["set_id"].to_numpy(), table["shingles"].chunk(0)
            flat, size = lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
            edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            begin = np.append(0, np.cumsum(size))
            for s, e in zip(edge.tolist(), np.append(edge[1:], len(cell)).tolist(), strict=True):
                if e - s > 1:
                    u, v = forest(flat[begin[s] : begin[e]], size[s:e], t)
                    yield pa.RecordBatch.from_arrays([pa.array(node[s:e][u]), pa.array(node[s:e][v])], ["u", "v"])

    whole = found.mapInArrow(read, "set_id long, root long, blocks int, shingles array<bigint>").withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = whole.select("set_id", "root", "block", "shingles", other).select(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "set_id", "shingles")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "u long, v long")
