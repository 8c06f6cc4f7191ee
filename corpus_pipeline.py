"""Corpus pipeline: five of the training-data operators, one after the other.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. :func:`run` writes each
stage's rows as Parquet into the shared checkpoint folder and reads them again for the next one,
so a lost executor costs at most the stage it was lost in. Once a stage's rows are written, those of
the stage before it are deleted. Stages hand rows to Python :data:`BATCH_ROWS` at a time, a setting of the
session that their plans read when they run, so it stays set.

Null ids, texts, languages and sources, empty and very long texts, repeated rows and ties are treated
as each operator's module says; in short: a document without text or letters goes in the first stage, rows
that repeat an id and a text become one in the second, and documents with a null id are kept like
others. Further columns of the documents are carried through the first four stages, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from setlist.llm import langid, neardup, packing, secret_scan, substring
from setlist.llm.common import discard, shared_folder, swept


#: Rows of a batch between Spark and Python. Documents are long, stages hand them over one after
#: the other in the same executors: small batches keep what both sides hold at a time small.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the labelled ones speak go; a missing or contradicted ``lang``
    becomes the predicted one, which the secret scan takes for part of the repository."""
    _small_batches(spark)
    return langid.reject(docs)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    _small_batches(spark)
    return neardup.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too go from the text."""
    _small_batches(spark)
    return substring.dedup(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked in the text."""
    _small_batches(spark)
    return secret_scan.redact(docs)


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of training sequences."""
    _small_batches(spark)
    return packing.pack(docs, temperature=packing.TEMPERATURE)


STAGES = [
    ("language_id", language_id),
    ("minhash_neardup", minhash_neardup),
    ("suffix_dedup", suffix_dedup),
    ("secret_scan", secret_scans),
    ("packing", mixture_packing),
]

#: No stage but the fourth can be written as SQL over these tables; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}_{name}"
        with swept(spark):  # what the stage has made on its way goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
