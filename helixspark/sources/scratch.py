"""Paths for intermediate files that all executors can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_tables: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; only where that is unset and the master is local, in a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="helixspark-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = _own[0]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def frozen(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it again, so that later steps see the same rows whatever happens to executors.

    The table is deleted when the driver's process ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if not _tables:
        atexit.register(_clear, spark)
    _tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clear(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return  # the session is gone: the folder's owner clears it
    for path in _tables:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
