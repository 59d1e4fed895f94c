"""The shared folder in which operators land intermediate tables.

A landed table cuts lineage: a lost executor costs a re-read, not a re-run. The folder is the
one that the cluster names in ``spark.checkpoint.dir`` (:mod:`streetweave.sources.landing`).

Results of operators read what they have landed, so that stays until someone removes it::

    with scratch():
        remove_repeated_bytes(docs).write.parquet(out)

removes tables, their entries in the catalog and their files once the result is written.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from streetweave.sources.landing import remove, shared_dir

#: While a table is landed: shuffle files go with their job, and Arrow batches hold so many rows at most.
_LANDING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

_NOTED: ContextVar[list[DataFrame] | None] = ContextVar("noted", default=None)


@contextmanager
def scratch():
    """Within, what operators land is noted, and removed at the end, also after an error. Results of these
    operators must have been written by then. Runs of lines in a folder of the caller's are not touched."""
    noted: list[DataFrame] = []
    before = _NOTED.set(noted)
    try:
        yield
    finally:
        _NOTED.reset(before)
        for landed in noted:
            discard(landed)


def note(landed: DataFrame) -> None:
    """Leave ``landed`` to the :func:`scratch` around, if there is one."""
    if (noted := _NOTED.get()) is not None:
        noted.append(landed)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def landing_conf(spark: SparkSession):
    """Within, the shuffle files of a finished job are removed at once instead of at some later
    garbage collection, and Python workers hold a bounded number of rows."""
    old = {k: spark.conf.get(k, None) for k in _LANDING}
    for k, v in _LANDING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def land(df: DataFrame, name: str, compression: str = "zstd", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return it as read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with landing_conf(spark):
        writer.parquet(path)
    landed = spark.read.schema(df.schema).parquet(path)
    landed._landed_at = path
    note(landed)
    return landed


def land_bucketed(
    df: DataFrame, name: str, n: int, keys: str | list[str], partition: str | None = None, sort: list[str] | None = None, compression: str = "uncompressed", path: str | None = None
) -> DataFrame:
    """Write ``df``, whose tasks hold whole buckets of ``keys``, to the shared folder (or ``path``) as a table
    of ``n`` buckets, and return it as read back: grouping and joining it by ``keys`` needs no exchange."""
    spark = df.sparkSession
    keys = [keys] if isinstance(keys, str) else keys
    own = path is None
    table, path = f"{name}_{uuid.uuid4().hex}".replace("-", "_"), path or new_path(spark, name)
    writer = df.write.bucketBy(n, *keys).option("path", path).option("compression", compression)
    if sort:
        writer = writer.sortBy(*sort)
    if partition:
        writer = writer.partitionBy(partition)
    with landing_conf(spark):
        writer.saveAsTable(table)
    landed = spark.table(table)
    landed._landed_at, landed._landed_as = path, table
    if own:
        note(landed)
    return landed


def open_bucketed(spark: SparkSession, name: str, path: str, columns: str, n: int, keys: list[str]) -> DataFrame:
    """A table of :func:`land_bucketed` that another session has written."""
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    by = ", ".join(keys)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}'")
    landed = spark.table(table)
    landed._landed_at, landed._landed_as = path, table
    return landed


def discard(landed: DataFrame, part: str = "") -> None:
    """Remove a landed table, or a part of a partitioned one, that nothing reads any more."""
    spark = landed.sparkSession
    if not part and (table := getattr(landed, "_landed_as", None)):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    remove(spark, f"{landed._landed_at}/{part}".rstrip("/"))
