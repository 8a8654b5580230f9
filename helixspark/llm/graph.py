"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.runtime import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:  # every neighbour that is larger than the node goes to the smallest neighbour
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # the neighbours that are smaller than the node
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = both.join(low, "a")
    if large:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    moved = moved.where(F.col("a") != F.col("b"))
    return moved if large else moved.distinct()  # the small step meets repeats of an edge in one place anyway


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); component is the component's smallest node.

    Each step is written to the shared folder, so lineage stays short and a lost executor costs one step. The number of
    steps grows with the logarithm of the largest component; the loop ends when a step changes nothing.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    while True:
        last, now = now, written(_star(_star(now, True), False), "cc")
        discard(last)
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == mark:
            break
        mark = (row.n, row.s)
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())


def merged(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, component) with more edges (a, b): only components that the edges join are worked on."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = written(comp.join(ends, "node", "full_outer").select("node", F.coalesce("component", "node").alias("component")), "cc")
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    joined = edges.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    top = components(joined).select(F.col("node").alias("component"), F.col("component").alias("top"))
    return written(nodes.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "cc")
