"""Exact ranks, quantiles and shortest intervals for groups of any size.

A group's values are range-partitioned, ranked inside each block, and shifted by
the counts of the blocks before it. No task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import hand_back, key_join


BLOCK_ROWS = 1_000_000  # distinct values that one task ranks together


@dataclass
class Ranked:
    """``rows``: one per distinct value with ranks ``lo..hi``, dense rank, block and group size ``n``.
    ``blocks``: one per (keys, block)."""

    rows: DataFrame
    blocks: DataFrame
    keys: list[str]
    parts: int


def rank_values(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Ranked:
    keys, order = list(keys), list(order)
    # Equal values collapse first, so a value repeated a billion times is one row.
    distinct = df.filter(F.col(order[-1]).isNotNull()).groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("c"))
    distinct = materialize(distinct, "rank")
    parts = 1 + distinct.count() // BLOCK_ROWS
    if parts > 1:
        # The block numbers come from sampling: fix them in a written table before using them twice.
        ranged = distinct.repartitionByRange(parts, *keys, *order).withColumn("_block", F.spark_partition_id())
        fixed = materialize(ranged, "rank")
    else:
        fixed = distinct.withColumn("_block", F.lit(0))
    fixed = fixed.withColumn("_g", F.lit(1))
    counts = fixed.groupBy("_g", *keys, "_block").agg(F.sum("c").alias("_c"), F.count(F.lit(1)).alias("_d"))
    # At most `parts` rows per group from here on.
    group = Window.partitionBy("_g", *keys)
    before = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.select(
        *keys, "_block",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_dense_before"),
        F.sum("_c").over(group).alias("n"),
    )
    on = keys + ["_block"]
    joined = key_join(fixed, blocks, on)
    inside = Window.partitionBy(*on).orderBy(*order)
    rows = joined.select(
        *keys, *order, "c", "_block", "n",
        (F.col("_before") + F.sum("c").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("hi"),
        (F.col("_dense_before") + F.row_number().over(inside)).alias("dense"),
    ).withColumn("lo", F.col("hi") - F.col("c") + 1)
    return Ranked(rows, blocks, keys, parts)


def quantiles(ranked: Ranked, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics."""
    aggs = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        for tag, at in (("f", F.floor(pos) + 1), ("c", F.ceil(pos) + 1)):
            aggs.append(F.max(F.when(F.lit(at).between(F.col("lo"), F.col("hi")), F.col(value))).alias(f"_{tag}_{name}"))
    keys = ranked.keys or [F.lit(1).alias("_all")]
    out = ranked.rows.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    cols = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        f, c = F.col(f"_f_{name}"), F.col(f"_c_{name}")
        cols.append((f + (c - f) * (pos - F.floor(pos))).alias(name))
    return out.select(*ranked.keys, "n", *cols)


def box_stats(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends (last values within ``reach`` x IQR) and outlier count."""
    ranked = rank_values(df, keys, [value])
    q = quantiles(ranked, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    # Bounds travel to the rows by (group, block): a big group has many blocks.
    marked = key_join(ranked.blocks.select(*ranked.keys, "_block"), q.drop("n"), ranked.keys)
    j = key_join(ranked.rows.select(*ranked.keys, "_block", value, "c"), marked, ranked.keys + ["_block"])
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - reach * iqr, F.col("q3") + reach * iqr)
    return j.groupBy(*ranked.keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("c"))).alias("n_outliers"),
        F.sum("c").alias("n"),
    )


def dense_index(df: DataFrame, column: str, out: str, spread_by: Sequence[str]) -> DataFrame:
    """1-based position of each value among the sorted distinct values; NULL stays NULL."""
    ranks = rank_values(df, [], [column]).rows.select(column, F.col("dense").cast("int").alias(out), "c")
    return hand_back(df, ranks, [column], "c", spread_by)


def shortest_interval(df: DataFrame, keys: Sequence[str], value: str, mass: float = 0.8) -> DataFrame:
    """Highest-density interval: the narrowest [v(i), v(i+gap)], gap = round(mass x n), first one on ties."""
    ranked = rank_values(df, keys, [value])
    keys = ranked.keys
    gap = F.least(F.greatest(F.round(F.col("n") * mass).cast("bigint"), F.lit(1)), F.col("n") - 1)
    base = ranked.rows.select(
        *keys, F.col(value).alias("v"), "lo", "hi", "n",
        F.greatest(F.ceil(F.col("n") / ranked.parts), F.lit(1)).cast("bigint").alias("_step"),
    ).filter(F.col("n") > 1)

    def block(rank):
        return F.floor((rank - 1) / F.col("_step")).cast("bigint")

    # A value fills every rank block it spans, so each block starts with a known value.
    entries = base.withColumn("_b", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi"))))).select(
        *keys, "_b",
        F.greatest(F.col("lo"), F.col("_b") * F.col("_step") + 1).alias("_at"),
        F.lit(0).alias("_kind"), F.col("v").alias("_known"),
        F.lit(None).cast("double").alias("start"), F.lit(None).cast("bigint").alias("rank"),
    )
    target = F.col("lo") + gap
    targets = base.filter(target <= F.col("n")).select(
        *keys, block(target).alias("_b"), target.alias("_at"),
        F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_known"),
        F.col("v").alias("start"), F.col("lo").alias("rank"),
    )
    w = Window.partitionBy(*keys, "_b").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        entries.unionByName(targets)
        .withColumn("end", F.last("_known", ignorenulls=True).over(w))
        .filter(F.col("_kind") == 1)
    )
    best = found.groupBy(*keys).agg(
        F.min(F.struct((F.col("end") - F.col("start")).alias("width"), "rank", "start", "end")).alias("b")
    )
    return best.select(*keys, F.col("b.start").alias("hdi_low"), F.col("b.end").alias("hdi_high"))
