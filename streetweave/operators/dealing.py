"""Rows over all tasks, for steps whose time their bytes don't tell."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by key over a number of partitions that adaptive execution leaves alone; it would put what is few
    bytes but long work into one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *(keys or ("image_id",)))
