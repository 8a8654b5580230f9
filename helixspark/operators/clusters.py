"""Per-cluster statistics of reads: coverage, seeds, medians, coherent cores, subsets and consensus columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions.distance import center_distances, distance_sums, kmer_centrality, pair_distances
from helixspark.functions.sequence import stable_hash

KEY = "cluster_id"


def coverage(reads: DataFrame) -> DataFrame:
    return reads.groupBy(KEY).agg(F.count("*").alias("num_reads"), F.sum((F.length("read") > 0).cast("long")).alias("used_reads"))


def together(reads: DataFrame) -> DataFrame:
    """(cluster_id, r): one row a cluster with its reads (read_idx, read) in order, dealt to tasks by cluster_id.

    The one exchange of the statistics below. Few bytes but much work: a given number of partitions is not coalesced. A
    cluster is what one strand was read as, so its size follows the sequencing depth and not the data set. Rows that are
    together already, as clusters are stored, stay as they are.
    """
    if "r" in reads.columns:
        return reads
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reads.repartition(n, KEY).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("read_idx", "read"))).alias("r"))


def pairwise_distances(reads: DataFrame) -> DataFrame:
    """(cluster_id, i, j, distance) for the pairs i < j of reads of a cluster."""
    pairs = together(reads).select(KEY, F.col("r.read_idx").alias("x"), F.inline(pair_distances(F.col("r.read")))).where("i < j")
    return pairs.select(KEY, F.get("x", F.col("i")).alias("i"), F.get("x", F.col("j")).alias("j"), F.col("d").alias("distance"))


def guess_distances(guesses: DataFrame, reads: DataFrame) -> DataFrame:
    """(cluster_id, guess, distance) of each different guess of a cluster to each of its reads."""
    once = guesses.select(KEY, "guess").distinct()
    return together(reads).join(once, KEY).select(KEY, "guess", F.explode(center_distances(F.col("r.read"), F.col("guess"))).alias("distance"))


def medoid_seed(reads: DataFrame, target: int, cap: float = 0.32) -> DataFrame:
    """(cluster_id, seed, cost, seed_read): the read closest to the others, each distance capped; longer or shorter reads
    pay a hundredth a base."""
    return with_seeds(reads, target, cap).drop("r")


def with_seeds(reads: DataFrame, target: int, cap: float = 0.32) -> DataFrame:
    """(cluster_id, r, seed, cost, seed_read): the rows of ``together`` with their medoids."""
    rows = together(reads).withColumn("d", distance_sums(F.col("r.read"), F.lit(cap)))
    cost = lambda x, d: F.struct(F.round(d + 0.010 * F.abs(F.length(x["read"]) - target), 9).alias("cost"), x["read_idx"].alias("seed"), x["read"].alias("read"))
    return rows.select(KEY, "r", F.array_min(F.zip_with("r", "d", cost)).alias("m")).select(KEY, "r", "m.seed", "m.cost", F.col("m.read").alias("seed_read"))


def centrality_seed(reads: DataFrame, target: int, k: int = 5) -> DataFrame:
    """(cluster_id, seed): the read whose k-mers most others have (support up to 12), less .055 for each base of length."""
    rows = together(reads).withColumn("c", kmer_centrality(k, 12)(F.col("r.read")))
    score = lambda x, c: F.struct(F.round(F.coalesce(c, F.lit(0.0)) - 0.055 * F.abs(F.length(x["read"]) - target), 9).alias("score"), (-x["read_idx"]).alias("r"))
    return rows.select(KEY, F.array_max(F.zip_with("r", "c", score)).alias("m")).select(KEY, (-F.col("m.r")).alias("seed"), F.col("m.score").alias("score"))


def upper_median(x):
    """The element at n // 2 of the sorted values."""
    return F.element_at(F.array_sort(F.collect_list(x)), (F.count(x) / 2).cast("int") + 1)


def median_mad(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median, upper_median, mad): the mean of the middle two, the upper one, and the median distance from the first."""
    med = values.groupBy(key).agg(F.percentile(value, 0.5).alias("median"), upper_median(F.col(value)).alias("upper_median"))
    return values.join(med, key).groupBy(key).agg(F.first("median").alias("median"), F.first("upper_median").alias("upper_median"), F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))


def coherent_core(reads: DataFrame, seeds: DataFrame | None = None, low: float = 0.16, high: float = 0.28, scale: float = 3.0) -> DataFrame:
    """(cluster_id, read_idx, read) of the reads within a robust distance of the seed; seeds as of ``medoid_seed``, or none
    if reads are rows of ``with_seeds``.

    Clusters of up to four reads stay whole, as do those whose core would be under half of them or under three. A
    cluster's medians are taken within its row.
    """
    rows = reads if seeds is None else together(reads).join(seeds.select(KEY, "seed", "seed_read"), KEY)
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    upper = lambda x: F.get(F.array_sort(x), (F.size(x) / 2).cast("int"))
    norm = lambda d, x: F.round(d / F.greatest(F.length(x["read"]), F.length("seed_read"), F.lit(1)), 12)
    far = F.zip_with(center_distances(F.col("r.read"), F.col("seed_read")), "r", norm)
    bound = lambda center, mad: F.greatest(F.lit(low), F.least(F.lit(high), center + scale * F.greatest(F.lit(0.012), mad))) + 1e-12

    # each value is bound once a cluster: a column that a lambda names would be computed anew for each of its reads
    def chosen(d, threshold):
        core = F.filter("r", lambda x, i: (x["read_idx"] == F.col("seed")) | (F.get(d, i) <= threshold))
        n = F.size("r")
        return once(core, lambda c: F.when((n <= 4) | (F.size(c) * 2 < n) | (F.size(c) < 3), F.col("r")).otherwise(c))

    within = lambda d: once(upper(d), lambda center: once(bound(center, upper(F.transform(d, lambda x: F.round(F.abs(x - center), 12)))), lambda t: chosen(d, t)))
    return rows.select(KEY, F.inline(once(far, within)))


def max_copies(reads: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` reads of each cluster, drawn by a hash of seed, cluster and read."""
    return together(reads).select(KEY, F.inline(F.slice(by_hash(F.lit(seed)), 1, most))).drop("_h")


def by_hash(seed: Column) -> Column:
    """Of rows of ``together``: the reads (_h, read_idx, read) in the order of a hash of seed, cluster and read."""
    return F.array_sort(F.transform("r", lambda x: F.struct(stable_hash(seed, F.col(KEY), x["read_idx"]).alias("_h"), x["read_idx"].alias("read_idx"), x["read"].alias("read"))))


def limit_clusters(reads: DataFrame, most: int) -> DataFrame:
    """The reads of the first ``most`` clusters; clusters are numbered from 1 without gaps, so no sort is needed."""
    return reads.where(F.col(KEY) <= most)


def read_subset(reads: DataFrame, seeds: DataFrame, target: int, most: int = 36) -> DataFrame:
    """The seed and the reads nearest to the target length, ``most`` in all; equal ones by index."""
    order = Window.partitionBy(KEY).orderBy(F.desc(F.col("read_idx") == F.col("seed")), F.abs(F.length("read") - target), "read_idx")
    return reads.join(seeds.select(KEY, "seed"), KEY).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(KEY, "read_idx", "rank")


def majority_consensus(aligned: DataFrame, seq: str = "row") -> DataFrame:
    """(cluster_id, consensus) of rows of one length: a column's best base (ties A, C, G, T), or nothing where gaps reach it."""
    cols = aligned.select(KEY, F.posexplode(F.split(seq, "")).alias("pos", "base")).where("base <> ''")
    counts = cols.groupBy(KEY, "pos").agg(*(F.count_if(F.col("base") == b).alias(b) for b in "ACGT"), F.count_if(F.col("base") == "-").alias("gap"))
    best = F.greatest(*"ACGT")
    letter = F.when(F.col("gap") >= best, "").when(F.col("A") == best, "A").when(F.col("C") == best, "C").when(F.col("G") == best, "G").otherwise("T")
    return counts.select(KEY, "pos", letter.alias("b")).groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "").alias("consensus"))
