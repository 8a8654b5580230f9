"""Clusters that arrive as files: local guides of each batch. Context needs all guides, so decoding stays a batch job."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixspark.operators.reconstruct import local_guides
from helixspark.sources.text import SEPARATOR, cluster_blocks
from helixspark.sources.versioned import commit, read_state


def stream_guides(spark: SparkSession, source: str, out: str, checkpoint: str, length: int) -> StreamingQuery:
    """Read Parquet files of (cluster_id, reads array<string>) as they come and append their guides; ends when none is left."""
    clusters = spark.readStream.schema("cluster_id long, reads array<string>").parquet(source)
    return local_guides(clusters, length).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _number(path: str) -> int:
    """The last number in a file's name is its place among the files."""
    found = re.findall(r"\d+", path.rsplit("/", 1)[-1])
    if not found:
        raise ValueError(f"no number in the name of {path}")
    return int(found[-1])


def _ordered_batch(out: str, state: str, first: int, separator: str, each: Callable[[DataFrame], DataFrame]):
    """One micro-batch: its files' clusters are staged, those whose turn it is get their numbers and are written.

    The state is what was committed last: the next file's number, the clusters before it, and the files that wait, with
    the batch that staged them and how many clusters they have. A batch that is run again finds its number in the state
    and does nothing, or writes the same folders again.
    """
    def run(lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        before = read_state(spark, state)
        now = before or {"batch": -1, "file": first, "clusters": 0, "waiting": {}}
        if batch <= now["batch"]:
            return
        staged = f"{state}/staged/batch={batch}"
        blocks = cluster_blocks(lines, separator).select("file", "place", F.col("tokens").alias("reads"))
        blocks.write.mode("overwrite").parquet(staged)
        counts = spark.read.parquet(staged).groupBy("file").agg(F.max("place").alias("n"))
        counts = lines.select("file").distinct().join(counts, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("n")).collect()  # a row a file
        waiting = {int(k): v for k, v in now["waiting"].items()}
        for row in counts:
            number = _number(row.file)
            if number < now["file"] or number in waiting:
                raise ValueError(f"there are two files of number {number}: {row.file}")
            waiting[number] = [batch, row.file, row.n]
        ready, number, base = [], now["file"], now["clusters"]
        while number in waiting:
            at, file, n = waiting.pop(number)
            ready.append((at, file, base))
            base, number = base + n, number + 1
        if ready:
            turn = spark.createDataFrame(ready, "batch long, file string, base long")
            own = [f"{state}/staged/batch={b}" for b in sorted({r[0] for r in ready})]
            rows = spark.read.parquet(*own).join(F.broadcast(turn), "file")  # a row a file of those whose turn it is
            rows = rows.select((F.col("base") + F.col("place")).alias("cluster_id"), "reads")
            each(rows).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        commit(spark, state, {"batch": batch, "file": number, "clusters": base, "waiting": {str(k): v for k, v in waiting.items()}}, before)

    return run


def stream_text_clusters(spark: SparkSession, source: str, out: str, checkpoint: str, state: str, separator: str = SEPARATOR, first: int = 1, each: Callable[[DataFrame], DataFrame] = lambda rows: rows, files_a_batch: int = 1000) -> StreamingQuery:
    """Read files of clusters between separator lines as they come, and append (cluster_id, reads) to out/batch=...

    Clusters are numbered from 1 without gaps, in the order of the numbers in the files' names (from ``first`` on) and of
    their places there, empty ones too, in whatever order the files arrive: a file that comes early waits until all before
    it are there. Ends when no new file is left. Numbers and waiting files are committed to ``state`` in one step after a
    batch's rows are written, so no number is given twice. Files must each begin with a separator or a cluster.

    ``each`` is applied to the rows before they are written.
    """
    lines = spark.readStream.option("lineSep", f"{separator}\n").option("maxFilesPerTrigger", files_a_batch).text(source)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.writeStream.foreachBatch(_ordered_batch(out, state, first, separator, each)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_text_guides(spark: SparkSession, source: str, out: str, checkpoint: str, state: str, length: int, separator: str = SEPARATOR, first: int = 1) -> StreamingQuery:
    """As ``stream_guides``, from numbered files of the text format; empty clusters have empty guides."""
    return stream_text_clusters(spark, source, out, checkpoint, state, separator, first, lambda rows: local_guides(rows, length))
