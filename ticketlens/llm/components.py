"""Connected components of a table of links, in Spark."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges of a partition, where there are so many.
PART_EDGES = 200_000


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """node, root (the smallest node of its component) for links (a, b) of long nodes.

    Large-star and small-star steps in turn: every node hands its smallest
    neighbour to the others, so depths shrink by half or better each time.  Only
    minima are gathered, never a node's neighbours.  A round is written in as many
    partitions as the edges before it need; parts: partitions of the first edges at most.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, parts)
    before, parts = None, max(1, -(-edges.count() // PART_EDGES))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), parts)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            break
        before, parts = tuple(state), max(1, -(-state[0] // PART_EDGES))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().coalesce(parts))
