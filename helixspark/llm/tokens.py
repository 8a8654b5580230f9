"""Token ids of whole texts inside Spark tasks, and the exact histogram of encoded lengths."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.llm.runtime import written

VOCABULARY = "byte_bpe_50k"


@functools.cache
def encoder(vocabulary: str = VOCABULARY):
    """A function from a text to its ids as little-endian unsigned 32-bit integers, those of the ``tokenizers`` file
    (``add_special_tokens=False``).

    The merge ranks of a byte-level vocabulary give the same ids in less time. Texts that hold the string of an added
    token, which the file takes as that token, go to the file, as do texts that the rank encoder gives up on (runs of a
    million equal characters).
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    added = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if not any(t in text for t in added):
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # the encoder's own panic is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def _lengths(vocabulary: str):
    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            n = [len(encode(x)) if x else 0 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["length"])

    return run


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The exact histogram of encoded lengths, with what its suffix sums answer at each length as a context limit.

    Returns for each length that occurs: length, n_docs, n_longer (documents longer than it), tokens_longer,
    n_shorter_equal, share (of documents up to it, so the q-quantile is the first length with share >= q),
    total_tokens and truncated_tokens (the total if each document is cut to this length). Null and empty texts have
    length 0; an empty table gives an empty histogram.

    Sums run in two levels (within 1,024 neighbouring lengths, then over these groups), so no task gets all lengths.
    """
    # counting before the exchange: a task sends each length once, so a common length is no hot key
    hist = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_lengths(vocabulary), "length long").groupBy("length").agg(F.count("*").alias("n_docs"))
    hist = written(hist, "lengths")  # it is used twice; texts are encoded once
    hist = hist.withColumn("g", F.expr("length div 1024"))
    own = Window.partitionBy("g").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("n_in", F.sum("n_docs").over(own)).withColumn("t_in", F.sum(F.col("n_docs") * F.col("length")).over(own))
    groups = hist.groupBy("g").agg(F.sum("n_docs").alias("gn"), F.sum(F.col("n_docs") * F.col("length")).alias("gt"))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    groups = groups.select("g", F.coalesce(F.sum("gn").over(before), F.lit(0)).alias("bn"), F.coalesce(F.sum("gt").over(before), F.lit(0)).alias("bt"), F.sum("gn").over(whole).alias("all_n"), F.sum("gt").over(whole).alias("all_t"))
    out = hist.join(groups, "g")
    up_to, t_up_to = F.col("n_in") + F.col("bn"), F.col("t_in") + F.col("bt")
    longer = F.col("all_n") - up_to
    return out.select("length", "n_docs", longer.alias("n_longer"), (F.col("all_t") - t_up_to).alias("tokens_longer"), up_to.alias("n_shorter_equal"), (up_to / F.col("all_n")).alias("share"), F.col("all_t").alias("total_tokens"), (t_up_to + longer * F.col("length")).alias("truncated_tokens"))


def op8_query(spark, sf_dir: str) -> DataFrame:
    return length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"))
