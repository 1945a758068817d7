"""Documents to training data: five stages, each working on all rows its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatspark.llm.common import settled, table
from threatspark.llm.decontaminate import without_contaminated
from threatspark.llm.exact import without_exact_duplicates
from threatspark.llm.pieces import encode_and_decode
from threatspark.llm.quality import good_documents
from threatspark.llm.simhash import without_near_duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by importance for the texts labelled good stay."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space the longest stays."""
    return without_exact_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints stays, that with the smallest id."""
    return without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents but for the text, then its ids, their number and the text decoded from them.

    Columns of documents that are called like these three are left out.
    """
    keep = [c for c in docs.columns if c not in ("doc_id", "text", "ids", "n_tokens", "decoded")]
    coded = encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=keep)
    return coded.select("doc_id", *keep, "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("quality_classifier", quality_classifier), ("exact_dedup", exact_dedup), ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination), ("sentencepiece", sentencepiece),
]

#: The fitted model, fingerprints, the benchmark index and the tokenizer are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the table ``documents`` on, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
    return docs
