"""Column functions over strands: normalising, k-mers, distances, weights and signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from helixspark.functions.draws import fitted

def normalize_seq(s: Column) -> Column:
    """Only A, C, G and T, in upper case."""
    return F.upper(F.regexp_replace(s, "[^ACGTacgt]", ""))


def clean_seq(s: Column) -> Column:
    """As normalize_seq, but N stays."""
    return F.upper(F.regexp_replace(s, "[^ACGTNacgtn]", ""))


def kmers(s: Column, k: int, pad: str = "") -> Column:
    """The k-mers of s in order; pad is put before and after it. Shorter strings have none."""
    s = F.concat(F.lit(pad), s, F.lit(pad)) if pad else s
    return F.when(F.length(s) < k, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k))))


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, the first base highest: A 0, C 1, G 2, T 3."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def base_id(base: Column) -> Column:
    """A 0, C 1, G 2, T 3; anything else -1."""
    return F.instr(F.lit("ACGT"), base) - 1


def hamming(a: Column, b: Column) -> Column:
    """Mismatches on the common length and the difference of lengths."""
    return _mismatches(a, b)


@F.arrow_udf(IntegerType())
def _mismatches(a: pa.Array, b: pa.Array) -> pa.Array:
    def one(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        n = min(len(x), len(y))
        u, v = (np.frombuffer(s[:n].encode("utf-32-le"), np.uint32) for s in (x, y))
        return int(np.count_nonzero(u != v)) + abs(len(x) - len(y))

    return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def normalized_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


#: Weight of a read by its normalised distance to the guide (upper bounds, weights; last beyond all).
READ_WEIGHTS = ((0.075, 256), (0.115, 224), (0.165, 176), (0.225, 112), (0.300, 56))
READ_WEIGHT_REST = 20


def read_weight(norm: Column) -> Column:
    out = F.lit(READ_WEIGHT_REST)
    for bound, weight in reversed(READ_WEIGHTS):
        out = F.when(norm <= bound, weight).otherwise(out)
    return out


def length_ok(s: Column, target: int, delta: int = 35) -> Column:
    return F.abs(F.length(s) - target) <= delta


def outcome(guide_ed: Column, final_ed: Column) -> Column:
    """What decoding did to a guide that was wrong."""
    return F.when(final_ed == 0, "exact").when(final_ed < guide_ed, "partial").when(final_ed == guide_ed, "unchanged").otherwise("worsened")


def safe_percent(part: Column, whole: Column) -> Column:
    return F.coalesce(100.0 * F.try_divide(part.cast("double"), whole.cast("double")), F.lit(float("nan")))


def phred_prob(quality: Column) -> Column:
    """The probability that each base of a Phred+33 string is right."""
    return F.transform(F.split(quality, ""), lambda q: 1 - F.pow(F.lit(10.0), -(F.ascii(q) - 33) / 10.0))


def rolling_prob(quality: Column, k: int) -> Column:
    """The probability that all bases of each window of k of a Phred+33 string are right; none for shorter strings."""
    p = phred_prob(quality)
    each = F.transform(F.sequence(F.lit(1), F.length(quality) - (k - 1)), lambda i: F.aggregate(F.slice(p, i, F.lit(k)), F.lit(1.0), lambda a, x: a * x))
    return F.when(F.length(quality) < k, F.array().cast("array<double>")).otherwise(each)


def fit_length(read: Column, key: Column, length: int, drift: int) -> Column:
    """The read with as many letters as length +- drift allows: of a longer one letters go, and a shorter one gets an A
    before letters (or at its end, where it has not enough), at places drawn by a hash of key and position."""
    return fitted(length - drift, length + drift)(read, key)


def boundary_signature(seq: Column, left: str | Column, right: str | Column, target: Column) -> Column:
    """Where a strand lost its frame at a conserved end: 0 (left anchor one later), L - 1 (right anchor one earlier), -1."""
    left = F.lit(left) if isinstance(left, str) else left
    right = F.lit(right) if isinstance(right, str) else right
    nl, nr = F.length(left), F.length(right)
    usable = (nl >= 8) & (nr >= 8) & (nl + nr + 4 < target) & (F.length(seq) == target)
    at_left, left_later = F.substring(seq, F.lit(1), nl) == left, F.substring(seq, F.lit(2), nl) == left
    at_right, right_earlier = F.substring(seq, target - nr + 1, nr) == right, F.substring(seq, target - nr, nr) == right
    return F.when(~usable, -1).when(~at_left & left_later & at_right, 0).when(at_left & ~at_right & right_earlier, target - 1).otherwise(-1)


def stable_hash(*cols: Column) -> Column:
    """The first 15 hexadecimal digits of the SHA-256 of the columns joined by colons, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *(c.cast("string") for c in cols)), 256), 1, 15), 16, 10).cast("long")


def seconds(text: Column) -> Column:
    """``m:ss.xx`` or ``h:mm:ss`` as seconds."""
    parts = F.split(text, ":")
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x.try_cast("double"))


def sizes_before(df, key: str, size: str, out: str, each: int = 64):
    """df with the sum of ``size`` over all rows of smaller whole-number keys, without gathering them in one task.

    As ``dense_index``, with ranges of the key that have some ``each`` rows; rows are dealt evenly to tasks by range.
    """
    from pyspark.sql import Window

    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n:
        return df.withColumn(out, F.lit(None).cast("long"))
    width = max(1, (high - low + 1) * each // n)
    ranged = df.withColumn("_range", F.floor((F.col(key) - low) / width))
    counts = ranged.groupBy("_range").agg(F.sum(size).alias("_n")).withColumn("_group", F.floor(F.col("_range") / 4096))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_m")).select("_group", before(Window.orderBy("_group"), "_m").alias("_above"))
    counts = counts.select("_range", "_group", before(Window.partitionBy("_group").orderBy("_range"), "_n").alias("_before"))
    counts = counts.join(groups, "_group").select("_range", (F.col("_before") + F.col("_above")).alias("_before"))
    # a given number of partitions is not coalesced, whatever few bytes the rows have
    dealt = ranged.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_range")
    within = before(Window.partitionBy("_range").orderBy(key), size)
    return dealt.withColumn("_own", within).join(counts, "_range").withColumn(out, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")


def dense_index(df, key: str, out: str):
    """Number the rows 1, 2, ... by a unique whole-number key, without gathering them in one task.

    Rows are counted in ranges of the key, and numbered within each; ranges follow the count, so none grows with it. What
    comes before a range is added up in two levels, so a task has the counts of 4,096 ranges, or one sum of each such group.
    """
    from pyspark.sql import Window

    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n:
        return df.withColumn(out, F.lit(None).cast("long"))
    width = max(1, (high - low + 1) * 4096 // n)
    ranged = df.withColumn("_range", F.floor((F.col(key) - low) / width))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_group", F.floor(F.col("_range") / 4096))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_m")).select("_group", before(Window.orderBy("_group"), "_m").alias("_above"))
    counts = counts.select("_range", "_group", before(Window.partitionBy("_group").orderBy("_range"), "_n").alias("_before"))
    counts = counts.join(groups, "_group").select("_range", (F.col("_before") + F.col("_above")).alias("_before"))
    within = Window.partitionBy("_range").orderBy(key)
    return ranged.withColumn("_row", F.row_number().over(within)).join(counts, "_range").withColumn(out, (F.col("_row") + F.col("_before")).cast("long")).drop("_range", "_row", "_before")
