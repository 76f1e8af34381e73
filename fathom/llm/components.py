"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, component), the component being its least node; nodes without other nodes don't appear.
    A written table.

    Each round only takes minima by node (combined before the shuffle) and joins them back on the node; no neighbourhood
    is gathered. Up to a fixed number of nodes the minima are sent to all executors, so that a round shuffles three times. Rounds
    grow with the logarithm of the longest path, and end once each node has one neighbour below it at most, and none above it
    then: its least neighbour is its component. Each round's edges and nodes are written to the shared folder.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "edges")
    while True:
        ends = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        nodes = materialise(ends.select("u", F.least("u", "low").alias("m"), F.expr("low < u and low <> high").alias("amid")), "nodes")
        n, amid = nodes.agg(F.count("*"), F.count_if("amid")).first()
        if not amid:
            return nodes.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = joined(e, nodes.select(F.col("u").alias("v"), "m"), "v", "inner", n).select("u", F.col("m").alias("v"))
        met = joined(large, large.groupBy("u").agg(F.min("v").alias("m")), "u", "inner", n)
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = materialise(small.where("u <> v").distinct(), "edges")


def joined(large: DataFrame, small: DataFrame, on: str, how: str, rows: int, limit: int = 400_000) -> DataFrame:
    """large joined with small, whose number of narrow rows has been counted: sent to all executors up to limit rows, else shuffled."""
    return large.join(F.broadcast(small) if rows <= limit else small, on, how)
