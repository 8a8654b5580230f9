"""Experiment tables: grids, resuming, merging, upserts, deltas, paired advantages and robustness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """The product of axes, which are lists of settings."""
    parts = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in axes.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Settings that have no result yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def merge_last_wins(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of tables; of rows with equal keys that of the last table stays."""
    union = reduce(lambda a, b: a.unionByName(b), (t.withColumn("_p", F.lit(i)) for i, t in enumerate(tables)))
    rest = [c for c in tables[0].columns if c not in keys]
    return union.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_p").alias("r")).select(*keys, "r.*")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table without the keys of rows, and rows."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def paired_advantage(rows: DataFrame, ours: str, others: list[str], keys: list[str]) -> DataFrame:
    """Our success less the best other's, and the least other error less ours, where all methods have a row."""
    wide = rows.groupBy(*keys).pivot("method", [ours, *others]).agg(F.max("success").alias("success"), F.max("mean_ed").alias("mean_ed"))
    best, least = (F.greatest, F.least) if len(others) > 1 else (lambda x: x, lambda x: x)
    out = wide.dropna(subset=[f"{m}_success" for m in (ours, *others)])
    return out.select(*keys, (F.col(f"{ours}_success") - best(*(F.col(f"{m}_success") for m in others))).alias("success_gain"), (least(*(F.col(f"{m}_mean_ed") for m in others)) - F.col(f"{ours}_mean_ed")).alias("ed_gain"))


def delta_vs_baseline(rows: DataFrame, key: str, variant: str, baseline: str, values: list[str]) -> DataFrame:
    """rows with the difference and the ratio of values to the baseline variant of their key."""
    base = rows.where(F.col(variant) == baseline).select(key, *(F.col(v).alias(f"_{v}") for v in values))
    out = rows.join(base, key)
    return out.select(key, variant, *values, *((F.col(v) - F.col(f"_{v}")).alias(f"{v}_delta") for v in values), *(F.try_divide(v, f"_{v}").alias(f"{v}_ratio") for v in values))


def advantage_matrix(rows: DataFrame, row: str, column: str, columns: list, value: str) -> DataFrame:
    """The mean of a value by row and column; NaN where there is none."""
    wide = rows.groupBy(row).pivot(column, columns).agg(F.avg(value))
    return wide.select(row, *(F.coalesce(F.col(f"`{c}`"), F.lit(float("nan"))).alias(f"c{c}") for c in columns))


def robustness(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The largest change of success, and the range of time, over the settings of a parameter."""
    return rows.groupBy(*keys).agg(F.max(F.abs("success_delta")).alias("max_abs_success_delta"), F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds"))


def ordered(rows: DataFrame, column: str, order: list[str], *then: str) -> DataFrame:
    """Rows by a given order of values; others last."""
    rank = F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0).cast("long"))
    return rows.orderBy(F.coalesce(rank, F.lit(99)), *then)

