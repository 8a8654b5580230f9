"""What the operators ask of the session: a shared folder for intermediate tables, partition counts, column names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MOST_PARTITIONS = 50_000
_own: list[str] = []
_tables: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and the master is local, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="helixspark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: later steps do not depend on lost executors.

    Tables that are not discarded before are deleted when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(lambda: [_delete(spark, p) for p in list(_tables)])
    _tables.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    _tables.discard(path)
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return  # the session is gone: the folder's owner clears it
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.scratch_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(spark: SparkSession, n_bytes: int, each: int = 8 << 20) -> int:
    """A number of partitions for a table of so many bytes: the session's, or more where its tasks would exceed ``each``
    (up to ``MOST_PARTITIONS``, beyond which tasks grow instead of the shuffle's bookkeeping)."""
    return max(partitions(spark), min(MOST_PARTITIONS, -(-n_bytes // each)))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, under fixed names, so that other columns cannot clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def others(df: DataFrame, *added: str) -> list[str]:
    """The columns of a table but those that an operator's own replace."""
    taken = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in taken]


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text", longest: int | None = None) -> DataFrame:
    """(h, doc_id, text, y): at most ``most`` labelled texts of each class, by the hash h of their ids.

    The ids are chosen before any text is read, and are what is broadcast: 2 x most of them. Texts of more than
    ``longest`` bytes are left out.
    """
    ids = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("doc_id is not null and y is not null")
    ids = ids.withColumn("h", F.xxhash64("doc_id"))
    picked = [ids.where(F.col("y") == y).orderBy("h", "doc_id").limit(most) for y in (0, 1)]
    rows = id_text(docs, id_col, text_col)
    if longest is not None:
        rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    return rows.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("h", "doc_id", "text", "y")
