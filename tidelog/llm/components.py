"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs under one node that itself hangs under none."""
    under = edges.groupBy(F.col("a").alias("n")).agg(F.count("*").alias("k"), F.lit(0).alias("over"))
    over = edges.groupBy(F.col("b").alias("n")).agg(F.lit(0).alias("k"), F.lit(1).alias("over"))
    both = under.unionByName(over).groupBy("n").agg(F.sum("k").alias("k"), F.sum("over").alias("over"))
    return not both.where("k > 1 or (k > 0 and over > 0)").limit(1).count()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Each round hangs the larger neighbours of a node under its smallest neighbour,
    then its smaller ones; rounds needed grow with the logarithm of the longest path.
    Every round is written to the shared folder, and only whether it was the last reaches
    the driver. Self edges name single nodes; edges with a null end are ignored. An empty table gives an empty table.
    """
    start = materialize(edges.where("a is not null and b is not null").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    now = start.where("a <> b")
    while not _settled(now):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.where("m < a")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = materialize(small.union(low).distinct(), label)
    labelled = now.groupBy("a").agg(F.min("b").alias("component"))
    every = start.select(F.col("a").alias("node")).union(start.select("b")).distinct()
    return every.join(labelled.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))
