"""The corpus pipeline: stages over `documents`, each reading what the one before it wrote.

Every stage handles nulls, empty texts, repeated rows, further columns and
empty tables as the operator it calls says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_filings.llm.common import discard, shared_folder, table
from spark_filings.llm.line_dedup import dedup_lines
from spark_filings.llm.minhash import keep_one_of_each
from spark_filings.llm.mixing import mix_rows
from spark_filings.llm.quality_rules import keep_good
from spark_filings.llm.sentencepiece import encode_samples


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; one that is left without a word goes."""
    return dedup_lines(docs, drop_bare=True).withColumn("n_chars", F.length("text").cast("long"))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more)."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_rows(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document as token ids."""
    return encode_samples(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash", minhash),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Learned rules, clusters and seeded samples: no SQL states these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`, each written to the shared folder and read again.

    What a stage has read is deleted when its result is written, and all of it
    if one fails; the last result stays, as the rows that are returned are
    read from it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    try:
        for k, (name, stage) in enumerate(STAGES):
            written = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(written)
            docs = spark.read.parquet(written)
            if before:
                discard(spark, before)
            before = written
    except BaseException:
        discard(spark, folder)
        raise
    return docs
