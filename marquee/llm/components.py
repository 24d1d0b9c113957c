"""Connected components of a graph that no one machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b); a component is named by its least node.

    Alternates two steps until nothing changes: every node links its larger neighbours to the
    least node next to it, then its smaller neighbours. Both need one aggregation and one join
    by node, whatever the degree; the number of rounds grows with the logarithm of the size.
    Links with nulls and links of a node to itself are left out.
    """
    tidy = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    edges = store(tidy.distinct(), "components")
    before = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).union(
            joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        edges = store(small.distinct(), "components")
        after = _mark(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b").distinct()
            )
        before = after


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a hash of their set: equal marks, equal sets (128 bits)."""
    hashes = F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))
    return tuple(edges.agg(F.count("*"), *hashes).first())
