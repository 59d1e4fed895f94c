"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.llm import decontamination, lexical_search, license_scan, line_dedup, mixing, personal_data, recompression_dedup, url_filter, whitening
from streetweave.llm.quality_rules import judged
from streetweave.llm.recompression_dedup import remove_repeated_passages
from streetweave.llm.simhash_dedup import labelled
from streetweave.llm.suffix_dedup import remove_repeated_bytes
from streetweave.llm.token_files import encoded

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents"), TOKENIZER, end_id=1)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(license_scan.document_paths(_table(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents"), digest=True)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(_table(spark, sf_dir, "documents"), min_docs=10)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filtered(pages, url_filter.rule_table(spark), url_filter.default_labelled(spark))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = _table(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.min("label").alias("topic"))
    return mixing.mixed(_table(spark, sf_dir, "documents"), topics)


def op10_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(_table(spark, sf_dir, "documents"), digest=True)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(_table(spark, sf_dir, "embeddings"), k=32)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.found(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"), k=50)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_license_scan,
        op3_suffix_dedup,
        op4_simhash_dedup,
        op5_line_dedup,
        op6_quality_rules,
        op7_decontamination,
        op8_url_filter,
        op9_mixing,
        op10_recompression_dedup,
        op11_whitening,
        op12_personal_data,
        op13_lexical_search,
    )
}
ORACLES: dict[str, str] = {
    "op2_license_scan": license_scan.oracle_sql(),
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op7_decontamination": decontamination.ORACLE_SQL,
    "op9_mixing": mixing.oracle_sql(),
    "op10_recompression_dedup": recompression_dedup.ORACLE_SQL,
    "op13_lexical_search": lexical_search.ORACLE_SQL,
}
