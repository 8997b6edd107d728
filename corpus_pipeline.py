"""From raw documents to checked token digests, in five stages; each stage's rows are written and read again.

Every stage takes null and empty texts, null and repeated ids, repeated rows, further columns of any name and empty tables; each
docstring says what becomes of them. All but the last return the columns that they were given. A stage may be run alone, so each ships the package
and keeps Arrow batches small: by Spark's own limit a task takes texts by 64 MB, in the executor and again in its Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import byte_bpe, decontaminate, line_dedup, rule_ensemble, simhash
from geoloom.llm.shared import ship_package, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts. Null and empty texts are scored like others; repeated rows share their fate."""
    ship_package(spark)
    return rule_ensemble.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line of the corpus matches; n_chars follows the text.

    Earlier is by doc_id, null first. Null texts stay null; rows that repeat id and text lose the same lines. Documents may become empty, none goes.
    """
    ship_package(spark)
    left = line_dedup.remove_lines(docs, counts=None)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each group of near-duplicates: Jaccard similarity of 0.8 or more on shingles of five words.

    Rows are judged, not ids: rows that share an id but not the text may both stay, of equal rows one stays. Null ids come last. Texts without
    words, null ones too, are one group.
    """
    ship_package(spark)
    return simhash.remove_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark. Null and empty texts have no words and stay; rows that repeat id and text go together."""
    ship_package(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text that they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256. Null texts have no ids; each row has its own answer."""
    ship_package(spark)
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("clean", clean),
    ("tokens", tokens),
]

#: The classifier and the joins of near-duplicates are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
