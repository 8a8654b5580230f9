"""k-mer explosion, support, Markov models, leave-one-out probabilities and positional evidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from helixspark.functions.distance import CODED, coded_windows, layered_windows, local_surprise, loo_chances, own_windows, surprise_scores, window_counts, window_totals
from helixspark.functions.sequence import kmers
from helixspark.operators.clusters import together

#: Counts of edges stop here.
SATURATION = 65535


def explode_kmers(seqs: DataFrame, k: int, seq: str = "seq", pad: str = "") -> DataFrame:
    """A row for each k-mer of ``seq`` with its position from 0; the other columns stay."""
    return seqs.select(*(c for c in seqs.columns if c != seq), F.posexplode(kmers(F.col(seq), k, pad)).alias("pos", "kmer"))


def code_counts(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(code, n, sequences) of k-mers of A, C, G and T, which are counted within the tasks' batches before the exchange."""
    def count(batches):
        for batch in batches:
            for found in coded_windows(batch.column(0), k):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["code", "n", "sequences"])

    found = seqs.select(seq).mapInArrow(count, "code long, n long, sequences long")
    return found.groupBy("code").agg(F.sum("n").alias("n"), F.sum("sequences").alias("sequences"))


def kmer_counts(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, n, sequences): how often each k-mer occurs, and how many sequences have it.

    K-mers of A, C, G and T are counted by code within the tasks' batches before the exchange, and written out after it;
    longer ones and those of other letters are exploded.
    """
    own = seqs.select(F.col(seq).alias("seq"))
    if k <= CODED:
        coded = code_counts(own, k, "seq")
        coded = coded.select(F.translate(F.lpad(F.conv(F.col("code").cast("string"), 10, 4), k, "0"), "0123", "ACGT").alias("kmer"), "n", "sequences")
        own = own.where(F.col("seq").rlike("[^ACGT]"))
    windows = own.select(kmers(F.col("seq"), k).alias("all"))
    if k <= CODED:
        windows = windows.select(F.filter("all", lambda x: x.rlike("[^ACGT]")).alias("all"))
    once = F.transform(F.array_distinct("all"), lambda x: F.struct(x.alias("kmer"), F.size(F.filter("all", lambda y: y == x)).cast("long").alias("n")))
    other = windows.select(F.inline(once)).groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("sequences"))
    return coded.unionByName(other) if k <= CODED else other


def support(seqs: DataFrame, k: int = 12, key: str = "cluster_id", seq: str = "seq") -> DataFrame:
    """(kmer, support): how many sequences have the k-mer; each votes once. Votes are counted before the exchange."""
    return kmer_counts(seqs, k, seq).select("kmer", F.least("sequences", F.lit(SATURATION)).cast("long").alias("support"))


def reuse_fraction(seqs: DataFrame, k: int = 12, seq: str = "seq") -> DataFrame:
    """One row: windows, and those whose k-mer two sequences or more have.

    Windows and sequences are counted by k-mer together, so windows never meet the supports.
    """
    shared = F.sum(F.when(F.col("sequences") >= 2, F.col("n")))
    out = kmer_counts(seqs, k, seq).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("windows"), F.coalesce(shared, F.lit(0)).cast("long").alias("shared"))
    return out.withColumn("fraction", F.coalesce(F.try_divide("shared", "windows"), F.lit(0.0)))


def reuse_by_sequence(seqs: DataFrame, k: int = 12, key: str = "cluster_id", seq: str = "seq") -> DataFrame:
    """(key, windows, shared): a sequence's windows, and those whose k-mer two sequences or more have.

    Supports follow the data up to 4^k rows, but their size is estimated from the sequences' files, which hold their
    windows once over: the join is told to exchange both sides, so that supports never pass through the driver.
    """
    own = seqs.select(key, F.explode(kmers(F.col(seq), k)).alias("kmer"))
    both = own.join(support(seqs, k, key, seq).hint("merge"), "kmer")
    return both.groupBy(key).agg(F.count("*").alias("windows"), F.count_if(F.col("support") >= 2).alias("shared"))


def markov_model(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kind, kmer, n): every occurrence of (k+1)-mers as edges, of their first k letters as nodes, of their last k as suffixes."""
    edges = kmer_counts(seqs, k + 1, seq).select("kmer", "n")
    parts = edges.select(F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), v.alias("kmer")) for kind, v in (("edge", F.col("kmer")), ("node", F.substring("kmer", 1, k)), ("suffix", F.substring("kmer", 2, k)))))).alias("x"), "n").select("x.*", "n")
    out = parts.groupBy("kind", "kmer").agg(F.sum("n").alias("n"))
    return out.withColumn("n", F.when(F.col("kind") == "edge", F.least("n", F.lit(SATURATION))).otherwise(F.col("n")).cast("long"))


#: Counts of up to 4^10 windows (some 25 MB) are broadcast; longer ones are joined by an exchange.
BROADCAST_K = 9


def _totals(seqs: DataFrame, k: int, seq: str):
    return seqs.sparkSession.sparkContext.broadcast(window_totals(seqs, seq, k + 1))


def loo_transitions(seqs: DataFrame, k: int, key: str = "cluster_id", seq: str = "seq", only: Column | None = None) -> DataFrame:
    """(key, pos, edge, forward, reverse) of each window, from the counts of all other sequences; edge is its code.

    A window's own counts are those of its whole sequence, and are taken within it; probabilities are smoothed by a half,
    over four bases. Counts of all sequences are aggregated by code, prefixes and suffixes from those of the edges. Where
    4^k bounds them they are broadcast as arrays, and windows neither meet a table nor an exchange. Of sequences that are
    not ``only`` wanted just the counts are taken.
    """
    wanted = F.lit(True) if only is None else only
    n = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if k <= BROADCAST_K:
        chances = loo_chances(k + 1, _totals(seqs, k, seq))
        return seqs.where(wanted).repartition(n, key).select(key, F.inline(chances(F.col(seq))))
    windows = seqs.where(wanted).repartition(n, key).select(key, F.inline(window_counts(k + 1)(F.col(seq))))
    totals = code_counts(seqs, k + 1, seq).select(F.col("code").alias("edge"), F.col("n").alias("all_e"))
    # sums of prefixes and suffixes go to the edges first, of which there are 4^(k + 1) at most, so windows meet one table
    for kind, code in (("p", F.shiftright("edge", 2)), ("s", F.col("edge").bitwiseAND((1 << 2 * k) - 1))):
        totals = totals.withColumn(f"all_{kind}", F.sum("all_e").over(Window.partitionBy(code)))
    windows = windows.join(totals, "edge")
    rest = {x: F.greatest(F.col(f"all_{x}") - F.col(x), F.lit(0)) for x in "eps"}
    return windows.select(key, "pos", "edge", ((rest["e"] + 0.5) / (rest["p"] + 2)).alias("forward"), ((rest["e"] + 0.5) / (rest["s"] + 2)).alias("reverse"))


def _own_windows(reads: DataFrame, key: str, seq: str, columns: list[tuple[str, object]], count) -> DataFrame:
    """What count(lists of reads) returns of clusters' rows: the row, and the columns. Reads may be rows of ``together``; else
    they meet in their cluster's row, the one exchange."""
    if "r" in reads.columns:
        rows = reads.select(key, F.col("r.read").alias("reads"))
    else:
        n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = reads.repartition(n, key).groupBy(key).agg(F.collect_list(seq).alias("reads"))
    kinds = StructType([rows.schema[key]])
    for name, kind in columns:
        kinds.add(name, kind)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                row, *found = count(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *found], names=kinds.names)

    return rows.mapInArrow(run, kinds)


def local_markov(reads: DataFrame, k: int = 5, key: str = "cluster_id", seq: str = "read") -> DataFrame:
    """(key, edge, n, forward, reverse) of each cluster's own reads, counted within its row. Reads may be rows of ``together``."""
    def count(lists: pa.Array) -> tuple:
        row, window, n, windows = own_windows(lists, k + 1)
        share = []
        for own in ([x[:k] for x in windows], [x[1:] for x in windows]):
            part, number = np.unique(np.array(own, dtype=f"<U{k}"), return_inverse=True)
            _, group = np.unique(row * max(1, len(part)) + number[window], return_inverse=True)
            share.append(pa.array((n + 0.5) / (np.bincount(group, n)[group] + 2)))
        return row, pa.array(windows, pa.string()).take(pa.array(window)), pa.array(n), *share

    return _own_windows(reads, key, seq, [("edge", StringType()), ("n", LongType()), ("forward", DoubleType()), ("reverse", DoubleType())], count)


def cluster_windows(reads: DataFrame, k: int, pad: str = "", key: str = "cluster_id", seq: str = "read") -> DataFrame:
    """(key, kmer, n) of each cluster's reads, ``pad`` before and after each. Reads may be rows of ``together``."""
    def count(lists: pa.Array) -> tuple:
        row, window, n, windows = own_windows(lists, k, pad)
        return row, pa.array(windows, pa.string()).take(pa.array(window)), pa.array(n)

    return _own_windows(reads, key, seq, [("kmer", StringType()), ("n", LongType())], count)


def positional_kmers(reads: DataFrame, length: int, k: int = 7, radius: int = 2, key: str = "cluster_id", seq: str = "read") -> DataFrame:
    """(key, layer, kmer, evidence): read k-mers at the strand layers they project to, spread over neighbours.

    A read of one window projects to layer 0. The weight falls by one with each layer away. A cluster's windows are added up
    within its row, some clusters at a time, so windows are neither rows nor exchanged. Reads may be rows of ``together``.
    """
    layers = length - k + 1
    if "r" in reads.columns:
        rows = reads.select(key, F.col("r.read").alias("reads"))
    else:
        n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = reads.repartition(n, key).groupBy(key).agg(F.collect_list(seq).alias("reads"))
    names = [key, "layer", "kmer", "evidence"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                row, layer, window, evidence, windows = layered_windows(part.column(1), k, layers, radius)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(layer), pa.array(windows, pa.string()).take(pa.array(window)), pa.array(evidence)], names=names)

    kinds = StructType([rows.schema[key]]).add("layer", LongType()).add("kmer", StringType()).add("evidence", LongType())
    return rows.mapInArrow(run, kinds)


def anomaly_scores(guides: DataFrame, reads: DataFrame, k: int, local_k: int = 5, local_weight: float = 0.4, top: int = 24, key: str = "cluster_id") -> DataFrame:
    """(key, score): the mean of a guide's most surprising positions.

    A position's surprise is the largest of the global windows over it (leave one out, both directions) and
    ``local_weight`` times that of the windows of its own reads. Guides without a global window have no score. Guides
    and reads are dealt to tasks by key once; all else happens within a guide's row.
    """
    if k <= BROADCAST_K:
        n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        seqs = guides.select(key, "seq").repartition(n, key)
        rows = seqs.join(together(reads).select(key, F.col("r.read").alias("reads")), key, "left")
        rows = rows.withColumn("l", local_surprise(local_k + 1)(F.coalesce("reads", F.array().cast("array<string>")), F.col("seq")))
        score = surprise_scores(k + 1, _totals(guides, k, "seq"), local_weight, top)
        return rows.select(key, score("seq", "l", F.lit(local_k + 1)).alias("score")).where("score is not null")
    surprise = -(F.log("forward") + F.log("reverse"))
    across = loo_transitions(guides, k, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", surprise.alias("s")))).alias("g"))
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = together(reads).select(key, F.col("r.read").alias("reads"))
    rows = across.join(guides.select(key, "seq").repartition(n, key), key).join(own, key, "left")
    rows = rows.withColumn("l", local_surprise(local_k + 1)(F.coalesce("reads", F.array().cast("array<string>")), F.col("seq")))

    def over(values, at, width: int):
        """The largest value of the windows over a position."""
        first = F.greatest(at - (width - 1), F.lit(0))
        return F.array_max(F.slice(values, first + 1, F.greatest(F.least(at + 1, F.size(values)) - first, F.lit(0))))

    at = F.sequence(F.lit(0), F.size("g") + k - 1)
    both = F.transform(at, lambda i: over(F.col("g.s"), i, k + 1) + local_weight * F.coalesce(over(F.col("l"), i, local_k + 1), F.lit(0.0)))
    best = rows.select(key, F.slice(F.sort_array(both, asc=False), 1, top).alias("b"))
    return best.select(key, (F.aggregate("b", F.lit(0.0), lambda a, x: a + x) / F.size("b")).alias("score"))


def conserved_anchors(guides: DataFrame, share: float = 0.985, least: int = 8, seq: str = "seq") -> DataFrame:
    """One row (left_anchor, right_anchor): the letters that nearly all guides agree on from each end, up to a third; '' if under ``least``."""
    n = F.length(seq)
    per = guides.select(n.alias("len"), F.posexplode(F.split(seq, "")).alias("pos", "base"), F.lit(1).alias("one")).where("base <> ''")
    counts = per.groupBy("len", "pos", "base").agg(F.count("*").alias("n"))
    top = counts.groupBy("len", "pos").agg(F.max(F.struct(F.col("n"), F.col("base"))).alias("m"), F.sum("n").alias("all")).select("len", "pos", F.col("m.base").alias("base"), (F.col("m.n") >= share * F.col("all")).alias("ok"))
    left = Window.partitionBy("len").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy("len").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    runs = top.withColumns({"l": F.min(F.col("ok").cast("int")).over(left), "r": F.min(F.col("ok").cast("int")).over(right)})
    third = F.floor(F.col("len") / 3)

    def anchor(cond):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "base")))), lambda x: x["base"]), "")
        return F.when(F.length(joined) >= least, joined).otherwise("")

    return runs.groupBy("len").agg(anchor((F.col("l") == 1) & (F.col("pos") < third)).alias("left_anchor"), anchor((F.col("r") == 1) & (F.col("pos") >= F.col("len") - third)).alias("right_anchor"))
