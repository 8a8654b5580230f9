"""Clusters of noisy reads derived from ``documents``: centers are the A, C, G and T letters of whole texts, in strands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions.draws import noisy, noisy_aligned, noisy_clusters, strands_in
from helixspark.functions.sequence import sizes_before
from helixspark.sources.scratch import frozen


@dataclass(frozen=True)
class Channel:
    """Thresholds of 65,536 for a base's deletion, substitution and insertion."""

    deletion: int = 1245
    substitution: int = 1376
    insertion: int = 1048

    def scaled(self, x: float) -> Channel:
        return Channel(int(self.deletion * x), int(self.substitution * x), int(self.insertion * x))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of this process by application, folder and settings: queries share them as they would share tables of a lake.
_stored: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, key: tuple, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, *key)
    if key not in _stored:
        _stored[key] = frozen(make(), key[1])
    return _stored[key]


def strands_of(texts: DataFrame, length: int) -> DataFrame:
    """(cluster_id, doc_id, piece, center) of texts(doc_id, text): the letters of each whole text in strands of ``length``.

    The last strand of a text goes on with the text's letters from its start until it is full; texts without letters have
    no strand.
    """
    # the letters are taken once; strands are numbered by the texts before theirs, so texts are dealt and no strand is
    cut = texts.select("doc_id", strands_in(length)(F.col("text")).alias("s")).where(F.size("s") > 0)
    cut = frozen(cut.withColumn("n", F.size("s").cast("long")), "strands")
    strands = sizes_before(cut, "doc_id", "n", "before").select("before", "doc_id", F.posexplode("s").alias("piece", "center"))
    return strands.select((F.col("before") + F.col("piece") + 1).alias("cluster_id"), "doc_id", "piece", "center")


def centers(spark: SparkSession, sf_dir: str, length: int = 110) -> DataFrame:
    """The strands of ``documents``."""
    return stored(spark, ("centers", sf_dir, length), lambda: strands_of(table(spark, sf_dir, "documents"), length))


def other_strands(spark: SparkSession, sf_dir: str, length: int = 110) -> DataFrame:
    """Strands of another data set: those of the texts of ``conversations``."""
    number = F.shiftleft(F.col("conv_id").cast("long"), 12) + F.col("turn")
    return stored(spark, ("other", sf_dir, length), lambda: strands_of(table(spark, sf_dir, "conversations").select(number.alias("doc_id"), "text"), length))


def mutate(strand: Column, key: Column, channel: Channel) -> Column:
    """A noisy copy of a strand."""
    return noisy(channel.deletion, channel.substitution, channel.insertion)(strand, key)


def _copies(strands: DataFrame, copies: Column) -> tuple[DataFrame, Column]:
    # few bytes but much work: a given number of partitions is not coalesced
    n = int(strands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = strands.repartition(n, "cluster_id").withColumn("read_idx", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)))
    return each, F.concat(F.col("cluster_id").cast("string"), F.lit(":"), F.col("read_idx").cast("string"))


def simulate_reads(strands: DataFrame, copies: Column, channel: Channel = Channel()) -> DataFrame:
    """(cluster_id, read_idx, read) for strands(cluster_id, center, ...); the first copies of more copies are the same."""
    each, key = _copies(strands, copies)
    return each.select("cluster_id", "read_idx", mutate(F.col("center"), key, channel).alias("read"))


def simulate_aligned(strands: DataFrame, copies: Column, channel: Channel = Channel()) -> DataFrame:
    """(cluster_id, read_idx, ref_row, read_row): the same reads with their strand, gaps where one of them has no letter."""
    each, key = _copies(strands, copies)
    rows = noisy_aligned(channel.deletion, channel.substitution, channel.insertion)(F.col("center"), key)
    return each.select("cluster_id", "read_idx", rows.alias("_rows")).select("cluster_id", "read_idx", "_rows.ref_row", "_rows.read_row")


def simulate_clusters(strands: DataFrame, copies: Column, channel: Channel = Channel(), aligned: bool = False) -> DataFrame:
    """(cluster_id, r): one row a cluster with the reads (``aligned``: rows) that ``simulate_reads`` makes one by one."""
    n = int(strands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draw = noisy_clusters(channel.deletion, channel.substitution, channel.insertion, aligned)
    return strands.repartition(n, "cluster_id").select("cluster_id", draw(F.col("center"), F.col("cluster_id"), copies.cast("int")).alias("r"))


def _drawn(spark: SparkSession, sf_dir: str, channel: Channel, aligned: bool) -> DataFrame:
    return simulate_clusters(centers(spark, sf_dir), 5 + F.col("cluster_id") % 12, channel, aligned)


def clusters(spark: SparkSession, sf_dir: str, channel: Channel = Channel()) -> DataFrame:
    """(cluster_id, r): 5 to 16 reads of each center, drawn once for all queries and stored by cluster, in order, so that
    statistics of clusters need no exchange."""
    return stored(spark, ("reads", sf_dir, channel), lambda: _drawn(spark, sf_dir, channel, False))


def reads(spark: SparkSession, sf_dir: str, channel: Channel = Channel()) -> DataFrame:
    """(cluster_id, read_idx, read) of ``clusters``."""
    return clusters(spark, sf_dir, channel).select("cluster_id", F.inline("r"))


def aligned_clusters(spark: SparkSession, sf_dir: str, channel: Channel = Channel()) -> DataFrame:
    """(cluster_id, r): the reads of ``clusters`` in rows with their strands, drawn once for all queries."""
    return stored(spark, ("aligned", sf_dir, channel), lambda: _drawn(spark, sf_dir, channel, True))


def aligned_reads(spark: SparkSession, sf_dir: str, channel: Channel = Channel()) -> DataFrame:
    """(cluster_id, read_idx, ref_row, read_row) of ``aligned_clusters``."""
    return aligned_clusters(spark, sf_dir, channel).select("cluster_id", F.inline("r"))


CENTERS_SQL = """centers AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, piece) cluster_id, doc_id, piece, rpad(substr(s, piece * 110 + 1, 110), 110, s) center
  FROM (SELECT doc_id, s, CAST(unnest(range(0, (length(s) - 1) // 110 + 1)) AS INT) piece FROM (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) s FROM documents) WHERE length(s) > 0))"""
READS_SQL = CENTERS_SQL + """,
draws AS (SELECT cluster_id, read_idx, p, substr(center, p, 1) b, md5(cluster_id || ':' || read_idx || ':' || p) h
  FROM (SELECT cluster_id, center, CAST(unnest(range(0, 5 + cluster_id % 12)) AS INT) read_idx FROM centers), LATERAL (SELECT CAST(unnest(range(1, 111)) AS INT) p)),
pieces AS (SELECT cluster_id, read_idx, p, b, CASE WHEN ('0x' || substr(h, 1, 4))::INT < 1245 THEN '' WHEN ('0x' || substr(h, 5, 4))::INT < 1376
   THEN substr('ACGT', CAST((instr('ACGT', b) - 1 + 1 + ('0x' || substr(h, 14, 1))::INT % 3) % 4 + 1 AS INT), 1) ELSE b END kept,
   CASE WHEN ('0x' || substr(h, 9, 4))::INT < 1048 THEN substr('ACGT', ('0x' || substr(h, 13, 1))::INT % 4 + 1, 1) ELSE '' END more FROM draws)"""
#: In DuckDB: pieces(cluster_id, read_idx, p, b, kept, more), each base with what stands for it and is inserted after it.
PIECES_SQL = READS_SQL
READS_SQL += """,
reads AS MATERIALIZED (SELECT cluster_id, read_idx, string_agg(kept || more, '' ORDER BY p) read FROM pieces GROUP BY cluster_id, read_idx)"""
