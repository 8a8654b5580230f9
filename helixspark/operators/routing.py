"""Gates and routes: exact top-K, medians and quartiles by rank, deciles, samples, splits and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions.ranges import ranged
from helixspark.functions.sequence import stable_hash
from helixspark.operators.clusters import by_hash, together


def value_at(values: DataFrame, value: str, index) -> DataFrame:
    """One row (gate): the value at an index from 0 of the sorted values, found by counting; index is a function of their
    number (a column).

    Equal values are counted before the exchange, and cumulated in ranges of about equal size, so no task sorts them all.
    """
    counts = ranged(values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")), "v", "g")
    groups = counts.groupBy("g").agg(F.sum("n").alias("gn"))
    upto = Window.orderBy("g")
    groups = groups.withColumn("before", F.sum("gn").over(upto) - F.col("gn")).withColumn("total", F.sum("gn").over(Window.partitionBy(F.lit(0))))
    target = index(F.col("total"))
    group = groups.where((target >= F.col("before")) & (target < F.col("before") + F.col("gn")))
    within = counts.join(F.broadcast(group), "g")
    own = Window.partitionBy("g").orderBy("v")
    return within.withColumn("cum", F.col("before") + F.sum("n").over(own)).where(target < F.col("cum")).groupBy().agg(F.min("v").alias("gate")).where("gate is not null")


def rank_at(values: DataFrame, value: str, num: int, den: int) -> DataFrame:
    """One row (gate): the value at index n * num // den of the sorted values."""
    return value_at(values, value, lambda n: F.floor(n * num / den))


def topk(scores: DataFrame, k: int, score: str = "score", key: str = "cluster_id") -> DataFrame:
    """The k rows of the highest score, ties by the lowest key: exactly k, all if there are no more. Keys are unique.

    The score at rank k is found by counting, and the last key among its ties in the same way, so nothing is sorted as a
    whole and k may grow with the rows.
    """
    if k <= 0:
        return scores.limit(0)
    found = value_at(scores, score, lambda n: F.greatest(n - k, F.lit(0))).first()
    if found is None:
        return scores.limit(0)
    above, tied = F.col(score) > F.lit(found.gate), F.col(score) == F.lit(found.gate)
    more = scores.where(above).count()
    last = value_at(scores.where(tied), key, lambda n: F.least(F.lit(k - more), n) - 1).first()
    return scores.where(above | (tied & (F.col(key) <= F.lit(last.gate))))


def gate(rows: DataFrame, value: str, num: int, den: int) -> DataFrame:
    """rows with ``active``: value >= the one at index n * num // den, so ties may exceed the share."""
    return rows.crossJoin(F.broadcast(rank_at(rows, value, num, den))).withColumn("active", F.col(value) >= F.col("gate"))


def global_rank(rows: DataFrame, value: str, key: str) -> DataFrame:
    """rows with ``rank`` from 0 by (value, key), numbered in ranges and not in one task.

    Ranges hold about as many rows each; the rows of a value that many have are cut by the ranges of their keys as well.
    """
    placed = ranged(rows, value, "_g")
    # only a bound's own range can be large
    placed = ranged(placed, key, "_k").withColumn("_k", F.when(F.col("_g") % 3 == 1, F.col("_k")).otherwise(0))
    sizes = placed.groupBy("_g", "_k").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_g", "_k").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_g", "_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    own = Window.partitionBy("_g", "_k").orderBy(value, key)
    return placed.withColumn("_r", F.row_number().over(own)).join(sizes, ["_g", "_k"]).withColumn("rank", F.col("_r") - 1 + F.col("_b")).drop("_g", "_k", "_r", "_b")


def rank_decile(rows: DataFrame, value: str, key: str, bins: int = 10) -> DataFrame:
    """rows with ``decile`` from 1: rank * bins // n + 1 (not ntile, whose first bins are the larger ones)."""
    n = rows.count()
    return global_rank(rows, value, key).withColumn("decile", F.least(F.lit(bins), (F.floor(F.col("rank") * bins / F.lit(max(1, n))) + 1).cast("int"))).drop("rank")


def systematic_sample(rows: DataFrame, index: str, most: int) -> DataFrame:
    """The rows at floor(s * n / most) of an index from 0 to n - 1: evenly spaced, all if there are no more than most."""
    n = rows.count()
    if n <= most:
        return rows
    # index i is taken when some s has floor(s * n / most) = i
    s = F.ceil(F.col(index) * F.lit(most) / F.lit(n))
    return rows.where((s < most) & (F.floor(s * F.lit(n) / F.lit(most)) == F.col(index)))


def nested_samples(reads: DataFrame, seeds: list[int], coverages: list[int]) -> DataFrame:
    """(seed, coverage, cluster_id, rank, read_idx, read): the first ``coverage`` reads of one permutation for each seed and cluster.

    Only clusters with the largest coverage's reads take part, so smaller samples are beginnings of larger ones.
    """
    each = together(reads).where(F.size("r") >= max(coverages)).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    ranked = each.select("seed", "cluster_id", F.posexplode(F.slice(by_hash(F.col("seed")), 1, max(coverages))).alias("rank", "x")).withColumn("rank", F.col("rank") + 1)
    return ranked.withColumn("coverage", F.explode(F.array(*map(F.lit, coverages)))).where(F.col("rank") <= F.col("coverage")).select("seed", "coverage", "cluster_id", "rank", "x.read_idx", "x.read")


def nested_violations(samples: DataFrame) -> DataFrame:
    """(seed, small, large, missing): reads of a sample that the next larger one lacks; all should be 0."""
    levels = samples.select("coverage").distinct()
    nxt = levels.join(levels.withColumnRenamed("coverage", "large"), F.col("coverage") < F.col("large")).groupBy("coverage").agg(F.min("large").alias("large"))
    keys = ["seed", "cluster_id", "rank", "read_idx"]
    # a read's samples meet in one row, so samples are exchanged once and not joined with themselves
    of = samples.groupBy(*keys).agg(F.collect_list("coverage").alias("all")).select("seed", "all", F.explode("all").alias("coverage"))
    small = of.join(F.broadcast(nxt), "coverage")
    return small.groupBy("seed", F.col("coverage").alias("small"), "large").agg(F.count_if(~F.array_contains("all", F.col("large"))).alias("missing"))


def nested_report(samples: DataFrame, reads: DataFrame) -> DataFrame:
    """(rule, seed, coverage, violations) of samples against the reads they were drawn from; all should be 0.

    Rules: ``reads`` (a read that the cluster has not at that place), ``cohort`` (a cluster of enough reads that has no
    sample, or the other way round), ``order`` (ranks that are not 1 to coverage, once each).
    """
    most = samples.agg(F.max("coverage").alias("most"))
    rich = reads.groupBy("cluster_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(most)).where("n >= most").select("cluster_id")
    levels = samples.select("seed", "coverage").distinct()
    foreign = samples.join(reads, ["cluster_id", "read_idx", "read"], "left_anti").groupBy("seed", "coverage").agg(F.count("*").alias("v"))
    per = samples.groupBy("seed", "coverage", "cluster_id").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    order = per.groupBy("seed", "coverage").agg(F.count_if((F.col("n") != F.col("coverage")) | (F.col("d") != F.col("coverage")) | (F.col("lo") != 1) | (F.col("hi") != F.col("coverage"))).alias("v"))
    wanted = rich.join(F.broadcast(levels)).withColumn("w", F.lit(1))
    cohort = per.select("seed", "coverage", "cluster_id", F.lit(1).alias("h")).join(wanted, ["seed", "coverage", "cluster_id"], "full_outer").groupBy("seed", "coverage").agg(F.count_if(F.col("h").isNull() | F.col("w").isNull()).alias("v"))
    out = None
    for name, found in (("reads", foreign), ("cohort", cohort), ("order", order)):
        part = levels.join(found, ["seed", "coverage"], "left").select(F.lit(name).alias("rule"), "seed", "coverage", F.coalesce("v", F.lit(0)).alias("violations"))
        out = part if out is None else out.unionByName(part)
    return out


def split_assign(rows: DataFrame, key: str, seed: int, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """rows with ``split``: the first int(train * n) by hash are train, the next int(val * n) val, the rest test."""
    n = rows.count()
    ranked = global_rank(rows.withColumn("_h", stable_hash(F.lit(seed), F.col(key))), "_h", key)
    a, b = int(train * n), int(train * n) + int(val * n)
    return ranked.withColumn("split", F.when(F.col("rank") < a, "train").when(F.col("rank") < b, "val").otherwise("test")).drop("_h", "rank")


def split_overlap(rows: DataFrame, value: str, split: str = "split") -> DataFrame:
    """(split_a, split_b, shared): how many different values two splits share."""
    of = rows.groupBy(value).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pair = of.select(F.explode("s").alias("split_a"), "s").select("split_a", F.explode("s").alias("split_b")).where("split_a < split_b")
    return pair.groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


def context_budget(reads: DataFrame, most: int = 10, budget: int = 1500, seed: int = 7) -> DataFrame:
    """Up to ``most`` reads of each cluster of two or more, by hash, as long as they and a sign between them fit the budget."""
    kept = together(reads).where(F.size("r") >= 2).withColumn("x", F.slice(by_hash(F.lit(seed)), 1, most))
    upto = lambda i: F.aggregate(F.slice("x", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + F.length(x["read"]) + 1) - 1
    rows = F.transform("x", lambda x, i: F.struct(x["read_idx"].alias("read_idx"), (i + 1).alias("rank"), upto(i).alias("used")))
    return kept.select("cluster_id", F.inline(rows)).where(F.col("used") <= budget)
