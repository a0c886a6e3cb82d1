"""A corpus pipeline of five stages over the table of documents.

Toxic documents go, then copies, then near copies but one of each group, then
documents that hold a benchmark passage; what stays is encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import decontamination, exact_dedup, near_dedup, sentencepiece_codec, toxicity
from tesserae.llm.common import stored


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that the trained network rejects; the labels are the only thing learnt from.

    Null and empty texts are clean; repeated rows have one verdict; an empty table stays empty; all columns stay.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the longest row, then the one of the least id; all columns stay.

    Null texts are empty and so equal to each other; of rows that tie the first stays; an empty table stays empty.
    """
    return exact_dedup.without_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one of the least id; all columns stay.

    Texts without words are linked with nothing and stay; of repeated rows the first stays; an empty table stays empty.
    """
    return near_dedup.one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that hold a window of a benchmark item; all columns stay.

    Null and empty texts hold none; an empty table, and an empty benchmark, leave all rows that there are.
    """
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that is left; null and empty texts have no tokens."""
    return sentencepiece_codec.digests(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("near_dedup", remove_near_copies),
    ("decontamination", remove_contaminated),
    ("sentencepiece", encode),
]

#: SQL can express neither the trained network nor the library's encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
