"""Evaluation: reconstruction metrics, summaries, rank statistics and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions.distance import edit_distance
from helixspark.functions.ranges import ranged
from helixspark.functions.sequence import hamming, safe_percent


def join_positional(predictions: DataFrame, centers: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Predictions with their centers; fails at a key that only one of both has."""
    one = predictions.withColumn("_p", F.lit(True)).join(centers.withColumn("_c", F.lit(True)), key, "full_outer")
    ok = F.when(F.col("_p") & F.col("_c"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a prediction and a center are needed for key "), F.col(key).cast("string"))))
    return one.where(ok).drop("_p", "_c")


def evaluate(pairs: DataFrame, predicted: str = "sequence", center: str = "center") -> DataFrame:
    """One row of metrics over pairs; reconstruction is 1 - edits / letters of the centers."""
    d, h = edit_distance(F.col(predicted), F.col(center)), hamming(F.col(predicted), F.col(center))
    p = pairs.select(d.alias("d"), h.alias("h"), F.length(center).alias("l"), (F.col(predicted) == F.col(center)).alias("e"))
    return p.agg(
        F.count("*").alias("clusters"), F.count_if("e").alias("exact"), F.sum("d").cast("long").alias("total_ed"), F.max("d").alias("max_ed"), F.avg("d").alias("mean_ed"),
        F.avg("h").alias("mean_hamming"), F.avg(F.col("d") / F.col("l")).alias("normalised_ed"), (1 - F.sum("d") / F.sum("l")).alias("reconstruction"), (100.0 * F.count_if("e") / F.count("*")).alias("success_percent"),
    )


def summary_stats(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean, sample standard deviation (0 for one row), standard error and median of values by keys."""
    out = [F.count("*").alias("n")]
    for v in values:
        sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
        out += [F.avg(v).alias(f"{v}_mean"), sd.alias(f"{v}_sd"), (sd / F.sqrt(F.count("*"))).alias(f"{v}_sem"), F.percentile(v, 0.5).alias(f"{v}_median")]
    return rows.groupBy(*keys).agg(*out)


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the probability that a positive outranks a negative, ties counting half.

    Rows are counted by score first; sums below each score are cumulated in ranges of scores.
    """
    c = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("n"))
    c = ranged(c, "s", "g")
    g = c.groupBy("g").agg(F.sum("n").alias("gn"))
    g = g.select("g", F.coalesce(F.sum("gn").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    own = Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    u = c.join(F.broadcast(g), "g").withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(own), F.lit(0)))
    return u.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p").cast("double") * F.sum("n")).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def mcnemar(rows: DataFrame, first: str, second: str) -> DataFrame:
    """One row: rows right in both, one or none, and the exact two-sided p of the discordant ones.

    Terms of the binomial sum come from one another, so no factorial is needed.
    """
    a, b = F.col(first), F.col(second)
    t = rows.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("harmed"), F.count_if(~a & b).alias("rescued"), F.count_if(~a & ~b).alias("neither"))
    n, k = F.col("harmed") + F.col("rescued"), F.least("harmed", "rescued")
    init = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    step = lambda acc, i: F.struct((acc["term"] + F.log((n - i + 1) / i.cast("double"))).alias("term"), (acc["sum"] + F.exp(acc["term"] + F.log((n - i + 1) / i.cast("double")))).alias("sum"))
    p = F.aggregate(F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), k)), init, step, lambda acc: acc["sum"])
    return t.withColumn("p_value", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * p)))


def ed_histogram(distances: DataFrame, d: str = "d") -> DataFrame:
    """(d, n, cumulative) for each distance from 0 to the largest; the number of distances is bounded by the strands."""
    counts = distances.groupBy(F.col(d).cast("int").alias("d")).agg(F.count("*").alias("n"))
    dense = counts.agg(F.max("d").alias("m")).select(F.explode(F.sequence(F.lit(0), "m")).alias("d"))
    return dense.join(counts, "d", "left").select("d", F.coalesce("n", F.lit(0)).alias("n")).withColumn("cumulative", F.sum("n").over(Window.orderBy("d")))


def gate_by_decile(rows: DataFrame) -> DataFrame:
    """rows(decile, failed, active) by decile: failed guides, and the share of structured decoding, in percent."""
    n, f, a = F.count("*"), F.count_if("failed"), F.count_if("active")
    return rows.groupBy("decile").agg(n.alias("clusters"), f.alias("failed"), a.alias("active"), safe_percent(f, n).alias("failed_percent"), safe_percent(a, n).alias("active_percent"), safe_percent(F.count_if(F.col("failed") & F.col("active")), f).alias("failed_active_percent"))


def phase_summary(rows: DataFrame) -> DataFrame:
    """rows(error_type, outcome, guide_ed, final_ed) by error type: shares, outcomes in percent, and edits removed."""
    total = rows.agg(F.count("*").alias("total"))
    n = F.count("*")
    by = rows.groupBy("error_type").agg(n.alias("clusters"), *(safe_percent(F.count_if(F.col("outcome") == x), n).alias(f"{x}_percent") for x in ("exact", "partial", "unchanged", "worsened")), safe_percent(F.sum("guide_ed") - F.sum("final_ed"), F.sum("guide_ed")).alias("ed_reduction_percent"))
    return by.crossJoin(F.broadcast(total)).withColumn("share_percent", safe_percent(F.col("clusters"), F.col("total"))).drop("total")


def linear_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def nondeterministic(rows: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """The keys whose repeats differ."""
    return rows.groupBy(*keys).agg(F.count_distinct(digest).alias("digests")).where("digests > 1")
