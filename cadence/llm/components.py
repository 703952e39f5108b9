"""Connected components as joins: alternating large-star and small-star rounds, no edge or label on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.shared import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round on edges (a, b) with a > b: links neighbours to the least of their neighbourhood.

    Large: of every node the neighbours above it. Small: the node and its neighbours below it.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        new = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        new = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return new.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of the edges (a, b); component is the least node that is reachable.

    Loops and edges with a null end count for nothing; repeated and reversed
    edges count once; no edges give no rows. Rounds grow with the logarithm of
    the longest path, and each is written to the shared folder.
    """
    edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        edges = keep(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
