"""Tables that are replaced as a whole: versions in folders of their own, and a pointer that names the one that counts.

A reader sees either all of the old version or all of the new one. A job that fails on its way leaves the pointer as it
was; its folder is cleared by the next write that succeeds, and running it again gives the same table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.operators.experiments import upsert

_POINTER = "_current"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_state(spark: SparkSession, path: str) -> dict | None:
    """What the pointer of a folder says; None before the first commit."""
    fs, where = _fs(spark, f"{path}/{_POINTER}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, state: dict, before: dict | None) -> None:
    """Point to a new state in one step, if the pointer still says what it said before; else the other writer counts."""
    if read_state(spark, path) != before:
        raise RuntimeError(f"{path} was changed by another writer")
    sc = spark.sparkContext
    fs, draft = _fs(spark, f"{path}/{_POINTER}-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(json.dumps(state).encode())
    out.close()
    rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.valueOf("OVERWRITE")
    files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), sc._jsc.hadoopConfiguration())
    files.rename(files.makeQualified(draft), files.makeQualified(sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{_POINTER}")), how)


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that the pointer names; None before the first commit."""
    state = read_state(spark, path)
    return None if state is None else spark.read.schema(state["schema"]).parquet(f"{path}/{state['version']}")


def replace(df: DataFrame, path: str, before: dict | None) -> None:
    """Write df as the next version of a folder and point to it. Of older versions the last one stays, for its readers."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    commit(spark, path, {"version": version, "schema": schema}, before)
    fs, where = _fs(spark, path)
    keep = {version, (before or {}).get("version")}
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.startswith(("v-", f"{_POINTER}-")) and name not in keep:
            fs.delete(status.getPath(), True)


def upsert_table(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Put rows into the table of a folder: rows of keys that it has take their place, others are added.

    Rows must differ in their keys; columns are those of the table. The first call makes the table.
    """
    spark = rows.sparkSession
    twice = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"rows repeat a key: {twice[0].asDict()}")
    before = read_state(spark, path)
    table = read_version(spark, path)
    replace(rows if table is None else upsert(table, rows.select(*table.columns), keys), path, before)
