"""The corpus pipeline: quality rules, near-duplicates, decontamination, secret scans, encoding.

Every stage gets what the one before kept, written as Parquet and read again, so a lost executor
costs at most the current stage. Stages 1 and 2 drop rows; 3 and 4 rewrite texts (benchmark words
are cut out, secrets masked) and drop none; the last returns token counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, neardup, quality, secrets
from tidemark.llm.tables import Scratch, read

#: Similarity from which documents are near duplicates here; op4's own links begin at neardup.PERCENT.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the outlier rule reject."""
    return quality.keep_good(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; documents from a similarity of 0.8 on are linked."""
    return neardup.keep_one(spark, docs, NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of benchmark windows."""
    return decontaminate.remove(spark, docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked."""
    return secrets.redact(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each document."""
    return bpe.digests(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("bpe encoding", bpe_encoding),
]
#: Approximate quantiles, secret novelty and tokenization have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, str(k))
    return docs
