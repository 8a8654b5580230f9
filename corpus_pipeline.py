"""A training corpus from raw documents: classify, deduplicate lines and documents, decontaminate, pack.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``, whatever others there are.

Rows of one doc_id stand or fall together, as do rows without an id: a stage keeps them if it keeps one of them (the
benchmark stage: if it hits none of them). Null and empty texts are judged as empty documents. An empty table passes
through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm.decontaminate import decontaminate
from helixspark.llm.jaccard import near_duplicates
from helixspark.llm.lines import dedup_lines
from helixspark.llm.packing import pack
from helixspark.llm.quality import classify_quality
from helixspark.llm.runtime import discard, written


def _of_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose id is (left_semi) or is not (left_anti) among ids; no id is an id of its own."""
    other = ids.select(F.col("doc_id").alias("__id"))
    return docs.join(other, F.col("doc_id").eqNullSafe(F.col("__id")), how).select(*(F.col(f"`{c}`") for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return _of_ids(docs, classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep"), "left_semi")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines and of long single lines go; a document that consists of nothing else goes with them."""
    stats = next(f"stats_{i}" for i in range(99) if f"stats_{i}" not in {c.lower() for c in docs.columns})
    out = dedup_lines(docs, stats_col=stats)
    left = out.where((F.col(f"{stats}.n_removed") == 0) | (F.col(f"{stats}.n_removed") < F.col(f"{stats}.n_lines")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id stays (all of a group in which none has an id)."""
    return _of_ids(docs, near_duplicates(docs).where("doc_id <=> component_id"), "left_semi")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark's word window go."""
    return _of_ids(docs, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("hit_words") > 0), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as sequences of at most 1,024 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", packing)]

#: Near copies and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        kept.append(docs)
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written before it returns
    discard(*kept)
    return packed
