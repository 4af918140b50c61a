"""Corpus pipeline: from raw documents to token files.

Each stage is written as Parquet and read again by the next. All stages but the last return the columns of
``documents``; the last returns what the token files hold of each document. Empty tables, nulls
and repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import jaccard, pareto, quality, templates, wavelet
from furrow.session import configure, written

WORDS_KEPT = 50_000  # of a worker: executors that ran the other stages have less memory to spare
ORACLE_SQL = None  # tokenizer and components are beyond SQL; tests/llm compares with brute force


def keep_sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    configure(spark)
    return quality.sound_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of least id."""
    configure(spark)
    return jaccard.first_of_each_class(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whatever its numbers and names."""
    configure(spark)
    return templates.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    configure(spark)
    return pareto.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; per document its place, length and checksum as read back from them."""
    configure(spark)
    return wavelet.encoded_documents(docs, words_kept=WORDS_KEPT)


STAGES = [
    ("quality rules", keep_sound),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("token ids", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
