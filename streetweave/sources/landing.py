"""Intermediate tables of iterative operators, written to the shared folder and read back.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset and Spark runs in
this process alone, as in tests, a folder of this machine is made and set; on a cluster it is an error,
since executors would each write to a disk of their own."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a landed table, which nothing may read any more."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{path} is not in the shared folder")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def landing(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table and returns it as read back, which cuts its lineage."""
    base = shared_dir(spark)

    def land(df: DataFrame) -> DataFrame:
        path = f"{base}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return land
