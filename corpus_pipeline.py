"""A corpus from raw documents to token ids: five stages, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import byte_pairs, decontamination, languages, near_duplicates, quality
from plumbline.llm.queries import tokenizer_path
from plumbline.session import cut
from plumbline.sources.tables import load


#: Rows that travel to a Python worker, and are decoded by the file reader, at a time: whole texts are long, and the stages
#: share the memory of the same executors. Settings that the session has of its own stay.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def _bounded(spark: SparkSession) -> None:
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    _bounded(spark)
    return languages.keep_identified(docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    _bounded(spark)
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    _bounded(spark)
    return near_duplicates.keep_one(docs, words=5, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    _bounded(spark)
    return decontamination.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of each document."""
    _bounded(spark)
    return byte_pairs.encode_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("byte_pairs", encode),
]

#: Trained models and hashed signatures decide; tests hold the result against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
