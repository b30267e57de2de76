"""Connected components over tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """`node, root` for every node of the edges `a, b`; the root is the smallest node that can be reached.

    Every step is a partially aggregated minimum and a join that adaptive execution can split at a hot node; the
    tables between steps are written, so neither lineage nor a single task grows with the graph.
    """
    edges = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first())
    before = sign(edges)
    while before[0]:
        # stars of their least nodes are components: every node has one edge, and no end of an edge begins another
        if before[0] == before[2] and edges.join(edges.select(F.col("a").alias("b")).hint("merge"), "b", "left_semi").isEmpty():
            break
        least = scratch.table(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        up = least.select(F.col("a").alias("b"), "m").hint("merge")
        large = scratch.table(edges.join(up, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct(), "large")
        lower = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.table(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        scratch.drop(edges, least, large, lower)
        edges, after = new, sign(new)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
