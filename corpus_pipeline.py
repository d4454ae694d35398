"""The corpus pipeline: five stages over documents, each written and read again.

toxicity (6), line dedup (3), MinHash near-dedup (7), benchmark decontamination (8),
BPE encoding and decoding (2). Each stage works on all that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import bpe, decontam, lines, minhash, toxicity
from geoloom.llm.common import scratch
from geoloom.llm.queries import tokenizer_path

#: Similarity of word shingles, in hundredths, from which documents are near duplicates; op7_minhash has its own.
NEAR_PERCENT = 80


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain rejects."""
    return toxicity.apply(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document only."""
    return lines.apply(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, linked from ``NEAR_PERCENT`` on."""
    return minhash.apply(docs, NEAR_PERCENT)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap with the benchmark."""
    return decontam.apply(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document that is left."""
    return bpe.digests(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _toxicity),
    ("line_dedup", _line_dedup),
    ("near_dedup", _near_dedup),
    ("decontamination", _decontamination),
    ("bpe", _bpe),
]

#: A trained classifier and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each stage's output is written as Parquet and reread."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{out}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
