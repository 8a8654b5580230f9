"""Best-fit packing by minimum bin slack over the exact histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.llm.runtime import id_text, partitions, written
from helixspark.llm.tokens import VOCABULARY, encoder

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def fullest(counts: dict[int, int], room: int) -> Counter:
    """The multiset of available lengths with the largest sum up to ``room``: subset sums as bits of one integer."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:  # multiplicities by powers of two
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] += take
            at -= length * take
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, pieces a sequence, offset) for all pieces of the histogram.

    Each bin takes the longest piece left and the fullest combination beside it; the same combination fills bins for as
    long as its lengths last, so the work follows the number of lengths and not the number of pieces.
    """
    counts = {k: v for k, v in histogram.items() if v}
    used: Counter = Counter()
    slots, sequence = [], 0
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        bin_ = fullest(rest, capacity - longest)
        bin_[longest] += 1
        bins = min(counts[x] // n for x, n in bin_.items())
        offset = 0
        for length, n in sorted(bin_.items(), reverse=True):
            slots.append((length, used[length], used[length] + bins * n, sequence, n, offset))
            used[length] += bins * n
            counts[length] -= bins * n
            if not counts[length]:
                del counts[length]
            offset += length * n
        sequence += bins
    return slots


def _pieces(capacity: int, eos: int, vocabulary: str):
    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            docs, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text).astype("<u4"), np.uint32(eos)) if text else np.array([eos], "<u4")
                # whole pieces at the end: the first one takes what is left over
                cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    docs.append(doc), piece.append(i), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((docs, piece, start, length, crc), _PIECES, strict=True)], schema=_PIECES)

    return run


def pack(docs: DataFrame, capacity: int = 1024, eos: int = 2, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as minimum bin slack finds.

    A document is its ids and then ``eos``; only a longer one is cut, into pieces of ``capacity`` tokens, of which the
    first may be shorter. The driver sees the histogram alone (at most ``capacity`` rows) and plans slots for each
    length; a piece finds its slot by its rank among the pieces of its length. Ranks are counted in salted groups of a
    length, so a length that most pieces have is spread over all tasks.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is
    one piece of ``eos``; repeated doc_ids are packed as they come; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = written(id_text(docs, id_col, text_col).mapInArrow(_pieces(capacity, eos, vocabulary), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    salts = 4 * partitions(spark)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {x.length: x.n for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, capacity), "length long, lo long, hi long, first long, per long, at long")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(own) - 1).join(groups, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    # the slots are bounded by the number of lengths
    found = ranked.join(F.broadcast(slots), (ranked.length == slots.length) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(slots.length)
    k = F.col("rank") - F.col("lo")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.expr("(rank - lo) div per")).alias("sequence_id"), (F.col("at") + k % F.col("per") * F.col("length")).alias("offset"))


def op3_query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
