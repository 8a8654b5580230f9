"""Statistics of aligned reads: pileups, inserted strings, channel counts, edit vectors and their conditional frequencies.

An aligned read is two rows of one length, the reference's letters and the read's, with ``-`` where one has none:
aligned(cluster_id, read_idx, ref_row, read_row). Everything here happens within a read's row up to one aggregation by
cluster, whose partial sums are taken before the exchange; a deep cluster is no hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from helixspark.functions.sequence import read_weight
from helixspark.functions.slots import followers, inserted, offered, states

KEY = "cluster_id"
#: Log probabilities are whole billionths, so that sums and ties do not depend on the order of additions.
MICRO = 1e9
#: Fixed value: the weight of a read whose distance does not matter.
FULL_VOTE = 256


def micro(x: Column) -> Column:
    return F.round(x * MICRO).cast("long")


def _pieces(ref_row: Column, read_row: Column) -> Column:
    """The columns cut before each slot: what stands in columns without a reference letter, then that letter's own column.

    One piece more than there are letters: the last has only the columns after the last letter.
    """
    columns = F.array_join(F.zip_with(F.split(ref_row, ""), F.split(read_row, ""), lambda a, b: F.concat(a, b)), "")
    letters = F.length(F.replace(ref_row, F.lit("-"), F.lit("")))
    return F.slice(F.regexp_extract_all(columns, F.lit(r"(?:-.)*(?:[^-].|\z)"), F.lit(0)), F.lit(1), letters + 1)


def _inserted(piece: Column, last: Column) -> Column:
    own = F.when(last, piece).otherwise(F.left(piece, F.length(piece) - 2))
    return F.replace(own, F.lit("-"), F.lit(""))


def slots(aligned: DataFrame) -> DataFrame:
    """(cluster_id, read_idx, slot, inserted, state): what a read has before the reference's letter ``slot`` (from 0), and
    in its place (``-`` for none). The slot after the last letter has no state. Rows of no letters have the slot 0."""
    rows = aligned.select(KEY, "read_idx", _pieces(F.col("ref_row"), F.col("read_row")).alias("p"))
    rows = rows.select(KEY, "read_idx", (F.size("p") - 1).alias("m"), F.posexplode("p").alias("slot", "piece"))
    last = F.col("slot") == F.col("m")
    return rows.select(KEY, "read_idx", "slot", _inserted(F.col("piece"), last).alias("inserted"), F.when(~last, F.right("piece", F.lit(1))).alias("state"))


def _counted(aligned: DataFrame, columns: list[tuple[str, object]], count) -> DataFrame:
    """What count(reference rows, read rows) returns of clusters' rows: the row, and the columns. Nothing is exploded, and rows
    that are together already, as clusters are stored, need no exchange."""
    rows = by_cluster(aligned)
    kinds = StructType([rows.schema[KEY]])
    for name, kind in columns:
        kinds.add(name, kind)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                row, *found = count(part.column(1), part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *found], names=kinds.names)

    return rows.mapInArrow(run, kinds)


def pileup(aligned: DataFrame) -> DataFrame:
    """(cluster_id, pos, a, c, g, t, gap): how many reads have what at each letter of the reference; anything else is a gap."""
    def count(refs, reads):
        row, pos, n = states(refs, reads)
        return row, pa.array(pos.astype(np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in n.T)

    return _counted(aligned, [("pos", IntegerType()), *((x, LongType()) for x in ("a", "c", "g", "t", "gap"))], count)


def insertions(aligned: DataFrame, most: int = 5) -> DataFrame:
    """(cluster_id, slot, inserted, n): the strings of up to ``most`` letters that reads insert at each slot, '' for none."""
    def count(refs, reads):
        row, slot, text, n, texts = inserted(refs, reads, most)
        return row, pa.array(slot.astype(np.int32)), pa.array(texts, pa.string()).take(pa.array(text)), pa.array(n)

    return _counted(aligned, [("slot", IntegerType()), ("inserted", StringType()), ("n", LongType())], count)


def options_of_reads(aligned: DataFrame, most: int = 5, choices: int = 2) -> DataFrame:
    """``insertion_options`` of aligned reads, within a cluster's row."""
    def count(refs, reads):
        row, slot, rank, text, n, total, kinds, texts = offered(*inserted(refs, reads, most), choices)
        return row, pa.array(slot.astype(np.int32)), pa.array(rank.astype(np.int32)), pa.array(texts, pa.string()).take(pa.array(text)), *(pa.array(x.astype(np.int64)) for x in (n, total, kinds))

    return _counted(aligned, [("slot", IntegerType()), ("rank", IntegerType()), ("inserted", StringType()), ("n", LongType()), ("total", LongType()), ("kinds", LongType())], count)


def insertion_options(found: DataFrame, choices: int = 2) -> DataFrame:
    """(cluster_id, slot, rank, inserted, n, total, kinds) of what ``insertions`` found: nothing inserted has rank 0 (n is 0
    if every read inserts), then come the ``choices`` most frequent strings, shorter ones and then A to Z on ties."""
    best = F.slice(F.array_sort(F.filter(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.length("inserted").alias("len"), F.col("inserted").alias("inserted"))), lambda x: x["inserted"] != "")), 1, choices)
    own = found.groupBy(KEY, "slot").agg(best.alias("best"), F.coalesce(F.sum(F.when(F.col("inserted") == "", F.col("n"))), F.lit(0)).alias("none"), F.sum("n").alias("total"), F.count("*").alias("kinds"))
    empty = F.array(F.struct((-F.col("none")).alias("neg"), F.lit(0).alias("len"), F.lit("").alias("inserted")))
    rows = own.select(KEY, "slot", "total", "kinds", F.posexplode(F.concat(empty, "best")).alias("rank", "o"))
    return rows.select(KEY, "slot", "rank", "o.inserted", (-F.col("o.neg")).alias("n"), "total", "kinds")


def operations(ref_row: Column, read_row: Column) -> Column:
    """An alignment as a string of M, S, I and D."""
    kind = lambda a, b: F.when(a == "-", F.when(b == "-", "").otherwise("I")).when(b == "-", "D").when(a == b, "M").otherwise("S")
    return F.array_join(F.zip_with(F.split(ref_row, ""), F.split(read_row, ""), kind), "")


def read_channels(aligned: DataFrame) -> DataFrame:
    """(cluster_id, read_idx, m, s, i, d): matches, substitutions, insertions and deletions of each read."""
    ops = aligned.select(KEY, "read_idx", operations(F.col("ref_row"), F.col("read_row")).alias("ops"))
    return ops.select(KEY, "read_idx", *((F.length("ops") - F.length(F.replace("ops", F.lit(x.upper()), F.lit("")))).cast("long").alias(x) for x in "msid"))


def error_type(substitutions: Column, insertions: Column, deletions: Column) -> Column:
    """The kind of a read's errors: none, substitutions only, no substitution, or both."""
    gaps = insertions + deletions
    return F.when(substitutions + gaps == 0, "None").when(gaps == 0, "Substitution-only").when(substitutions == 0, "Paired indel").otherwise("Mixed")


def channel_counts(aligned: DataFrame, length: int, most: int = 24, delta: int = 35, reject: float = 0.42) -> DataFrame:
    """(cluster_id, reads, used, m, s, i, d): the counts of each cluster's reads that lie close to its reference.

    ``most`` reads at even distances are looked at (a feature: a cluster's depth must not weigh on the channel), of those
    the ones within ``delta`` of the length, and of those the ones whose normalised distance is at most the median and
    three median deviations (1 / length at least), and at most ``reject``. Clusters without such reads have zeros. The
    rows may be those of ``read_channels``.
    """
    rows = read_channels(aligned) if "ref_row" in aligned.columns else aligned
    rank, n = F.row_number().over(Window.partitionBy(KEY).orderBy("read_idx")) - 1, F.count("*").over(Window.partitionBy(KEY))
    even = F.ceil(F.col("rank") * most / F.col("n")) * F.col("n")
    picked = (F.col("n") <= most) | ((F.floor(even / most) == F.col("rank")) & (even < most * F.col("n")))
    rows = rows.withColumns({"rank": rank, "n": n}).where(picked)
    size, distance, letters = F.col("m") + F.col("s") + F.col("i"), F.col("s") + F.col("i") + F.col("d"), F.col("m") + F.col("s") + F.col("d")
    near = F.when((F.abs(size - length) <= delta) & (size > 0), F.struct((distance / F.greatest(size, letters, F.lit(1))).alias("x"), *"msid"))
    # at most ``most`` structs a cluster, and medians of those
    by = rows.groupBy(KEY).agg(F.first("n").alias("reads"), F.collect_list(near).alias("r"))
    half = lambda v: F.when(F.size(v) > 0, 0.5 * (F.get(v, F.floor(F.size(v) / 2).cast("int")) + F.get(v, F.floor((F.size(v) - 1) / 2).cast("int"))))
    by = by.withColumn("med", half(F.array_sort("r.x")))
    by = by.withColumn("mad", half(F.array_sort(F.transform("r.x", lambda x: F.abs(x - F.col("med"))))))
    by = by.withColumn("limit", F.least(F.lit(reject), F.col("med") + 3.0 * F.greatest("mad", F.lit(1.0 / max(1, length)))))
    by = by.withColumn("r", F.filter("r", lambda x: x["x"] <= F.col("limit")))
    return by.select(KEY, "reads", F.size("r").cast("long").alias("used"), *(F.aggregate(f"r.{x}", F.lit(0).cast("long"), lambda a, v: a + v).alias(x) for x in "msid"))


def _entries(pieces: Column) -> Column:
    entry = lambda x, i: F.when(i == F.size(pieces) - 1, F.array(_inserted(x, F.lit(True)))).otherwise(F.array(_inserted(x, F.lit(False)), F.replace(F.right(x, F.lit(1)), F.lit("-"), F.lit(""))))
    return F.flatten(F.transform(pieces, entry))


def edit_vectors(aligned: DataFrame, *others: str) -> DataFrame:
    """(cluster_id, read_idx, v): 2m + 1 entries for a reference of m letters; entry 2s is what the read has before letter
    s, entry 2s + 1 what it has in its place ('' for nothing), the last one what follows. ``others`` are kept beside them."""
    rows = aligned.select(KEY, "read_idx", *others, _pieces(F.col("ref_row"), F.col("read_row")).alias("p"))
    return rows.select(KEY, "read_idx", *others, _entries(F.col("p")).alias("v"))


def votes(aligned: DataFrame, length: int, uniform: bool = True, delta: int = 35, reject: float = 0.42) -> DataFrame:
    """The rows with norm, the normalised distance of each read to its reference, and vote, a read's weight in a consensus:
    null for reads that are not within ``delta`` of the length or whose distance is over ``reject``."""
    without = lambda o, x: F.length(F.replace(o, F.lit(x), F.lit("")))
    sizes = lambda o: F.struct(without(o, "D").alias("size"), (without(o, "M") / F.greatest(without(o, "D"), without(o, "I"), F.lit(1))).alias("norm"))
    # a generator, so that operations are found once a read and not for each condition
    rows = aligned.select(KEY, "read_idx", "ref_row", "read_row", F.inline(F.transform(F.array(operations(F.col("ref_row"), F.col("read_row"))), sizes)))
    near = (F.abs(F.col("size") - length) <= delta) & (F.col("norm") <= reject)
    vote = F.lit(FULL_VOTE) if uniform else read_weight(F.col("norm"))
    return rows.withColumn("vote", F.when(near, vote)).drop("size")


def by_cluster(aligned: DataFrame) -> DataFrame:
    """(cluster_id, ref_row, read_row): one row a cluster with the rows of its reads as lists, dealt to tasks by cluster_id.

    Rows that are together already, as clusters are stored, need no exchange. A cluster is what one strand was read as, so
    its size follows the sequencing depth and not the data set.
    """
    if "r" not in aligned.columns:
        n = int(aligned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        aligned = aligned.repartition(n, KEY).groupBy(KEY).agg(F.collect_list(F.struct("ref_row", "read_row")).alias("r"))
    return aligned.select(KEY, "r.ref_row", "r.read_row")


def conditional_frequencies(aligned: DataFrame) -> DataFrame:
    """(cluster_id, slot, a, b, n, total, weight): how often entry b follows entry a from a slot of the edit vectors to the
    next, out of how many, and the log of that share in billionths. From the first slot it is the share of all reads, so
    that the weights of a path add up to its log probability. Of the first slot all reads count, of others those with the
    same entry.

    Entries are counted within a cluster's row, some clusters at a time, so they are neither rows nor exchanged. Reads may
    be rows (cluster_id, r) of whole clusters.
    """
    rows = by_cluster(aligned)
    names = [KEY, "slot", "a", "b", "n", "total"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                row, slot, a, b, n, total, texts = followers(part.column(1), part.column(2))
                text = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(slot.astype(np.int32)), text.take(pa.array(a)), text.take(pa.array(b)), pa.array(n), pa.array(total)], names=names)

    kinds = StructType([rows.schema[KEY]]).add("slot", IntegerType()).add("a", StringType()).add("b", StringType()).add("n", LongType()).add("total", LongType())
    edges = rows.mapInArrow(run, kinds)
    return edges.withColumn("weight", micro(F.log(F.col("n") / F.col("total"))))
