"""Row numbers within groups of any size: no group has to fit one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, group: list[str], order: list[Column], land: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with rn, the row number from 1 within ``group`` in ``order``.

    Rows are dealt to tasks by ranges of group and order, so a large group goes to many; each task numbers
    its own rows of a group, and the sizes of the parts before are added. ``land`` writes the dealt rows
    and reads them back, since parts must not change between counting and numbering."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = land(rows.repartitionByRange(n, *group, *order).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy(*group, "__part").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__part").alias("__p"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    own = dealt.withColumn("__rn", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order)))
    same = reduce(lambda a, g: a & F.col(g).eqNullSafe(F.col(f"__{g}")), group, F.col("__part") == F.col("__p"))
    return own.join(parts, same).select(*rows.columns, (F.col("__rn") + F.col("__before")).alias("rn"))
