"""Sorts, heads, level order and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import dimension


def level_of(column: str, levels: Sequence[str]) -> Column:
    """0-based position in a given level order; NULL for an unknown level."""
    pairs = [F.when(F.col(column) == v, F.lit(i)) for i, v in enumerate(levels)]
    return F.coalesce(*pairs)


def sort_levels(df: DataFrame, column: str, levels: Sequence[str], *then: str) -> DataFrame:
    return df.orderBy(level_of(column, levels), *then)


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of a total order (a distributed top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)


def relevel(df: DataFrame, column: str, levels: Sequence[str], out: str) -> DataFrame:
    """1-based index over the levels that occur, in the given order; rows of unlisted levels are dropped.

    The distinct levels number at most ``len(levels)``, so the window over them is bounded.
    """
    from pyspark.sql import Window

    d = dimension(df.sparkSession, list(enumerate(levels)), ["_o", "_level"])
    used = df.select(column).distinct().join(d, F.col(column) == F.col("_level")).drop("_level")
    index = used.select(
        F.col(column).alias("_c"), F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("_o")).cast("int").alias(out)
    )
    joined = df.join(index, F.col(column) == F.col("_c"))
    return joined.select(column, out, *[c for c in df.columns if c != column])


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables; a column missing in one of them is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_tagged(frames: dict[str, DataFrame], tag: str = "variable") -> DataFrame:
    return union_by_name([f.withColumn(tag, F.lit(name)) for name, f in frames.items()])
