"""Corpus pipeline: raw documents to packed training sequences.

Each stage is an operator of the subpackage and works on everything that the stage before it kept:

1. quality_classifier: documents that score below the classifier's cut go.
2. minhash_near_dedup: of each group of near copies the document with the least doc_id stays.
3. benchmark_decontamination: documents that hold a benchmark item go.
4. secret_scans: each reported secret is replaced by a mark in the text.
5. packing: the texts that remain become token sequences along a space-filling curve.

The first four return the columns of documents; the last returns one row per piece.
"""

from pyspark.sql import DataFrame, SparkSession

from vaultframe.llm import decontaminate, near_text, packing, quality, secrets
from vaultframe.llm.common import read, settle


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_only(docs, read(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_text.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", packed),
]
#: A trained score cannot be expressed in SQL; tests compare the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each is read several times by the next, so it is settled in the shared folder first."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
