"""A corpus pipeline: raw documents to token files, each stage one operator of ``streetweave.llm``.

Every stage gets what its predecessor kept, written as Parquet and read again, and returns the columns
of ``documents``, but for the last, which returns the documents of the token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.llm.decontamination import drop_contaminated
from streetweave.llm.mixing import sampled
from streetweave.llm.quality_rules import keep_good
from streetweave.llm.shared import land
from streetweave.llm.simhash_dedup import keep_one
from streetweave.llm.token_files import encoded


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints or of shingle sets that are 0.8 similar."""
    return keep_one(docs, words_per_shingle=5, least_jaccard=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with tempered shares of source, language and topic (the label of the embedding)."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    topics = vectors.groupBy(F.col("vec_id").alias("doc_id")).agg(F.min("label").alias("topic"))
    return sampled(docs, topics)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents, read back from their token files."""
    return encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: SQL expresses neither zstandard ratios nor SimHash components nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
