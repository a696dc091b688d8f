"""Connected components of an edge table, by stars that grow and shrink until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.scratch import staged_with


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written once, and what tells one set of edges from another."""
    mark = F.xxhash64("a", "b")
    out, seen = staged_with(edges.where("a <> b").distinct(), "edges", n=F.count(F.lit(1)), xor=F.bit_xor(mark), top=F.max(mark))
    return out, (seen["n"], seen["xor"], seen["top"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of an edge table (a, b) of longs but the smallest of its component.

    The component is named by its smallest node; that node, and nodes without
    edges, are not listed. Large-star: each node hands its larger neighbours
    to its smallest one. Small-star: each node hands its smaller neighbours,
    and itself, to the smallest. The rounds grow with the logarithm of the
    longest path. Every round is a partial minimum per node and one join,
    which Spark splits for a node with very many edges; each round is written
    once and compared with the one before by sums taken in that write.
    """
    edges, after = _kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = None
    while after[0] and after != before:
        before = after
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # least is dealt anew, so that Spark can split the join at a node of very many edges
        large = both.join(least.repartition("a"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges, after = _kept(small)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
