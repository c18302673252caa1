"""Results that compare a row with its group, and deterministic group samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import hand_back, key_join


def subtract_group_min(df: DataFrame, keys: Sequence[str], value: str, spread_by: Sequence[str]) -> DataFrame:
    """Sensor offset removal: value minus the group minimum."""
    low = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.count(F.lit(1)).alias("_n"))
    out = hand_back(df, low, keys, "_n", spread_by)
    return out.withColumn(value, F.col(value) - F.col("_low")).drop("_low")


def first_in_year_labels(df: DataFrame, day: str, suffix: tuple[str, str] = ("月", "年")) -> DataFrame:
    """Axis label of each distinct day: month, with the year added on the first day of a year."""
    days = df.select(F.to_date(day).alias(day)).distinct()
    # A year has at most 366 distinct days, whatever the row count.
    first = F.row_number().over(Window.partitionBy(F.year(day)).orderBy(day)) == 1
    month = F.concat(F.date_format(day, "MM"), F.lit(suffix[0]))
    year = F.concat(F.lit("\n"), F.date_format(day, "yyyy"), F.lit(suffix[1]))
    return days.select(day, F.when(first, F.concat(month, year)).otherwise(month).alias("label"))


def sample_groups(
    df: DataFrame, stratum: str, group: str, size: int, seed: int, spread_by: Sequence[str]
) -> DataFrame:
    """``size`` groups (days) per stratum (month) with all their rows, chosen by a seeded hash of the group.

    The verdict goes back to the rows through hand_back.
    """
    groups = df.groupBy(stratum, group).agg(F.count(F.lit(1)).alias("_n"))
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(order, group))
    # The limit on the rank is applied before the shuffle too: at most `size` groups per task and stratum travel.
    taken = groups.select(stratum, group).withColumn("_rank", rank).filter(F.col("_rank") <= size)
    chosen = key_join(groups, taken.select(stratum, group, F.lit(True).alias("_take")), [stratum, group], "left")
    return hand_back(df, chosen, [stratum, group], "_n", spread_by).filter("_take").drop("_take")


def first_groups(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """All rows of the first ``n`` groups in key order; Catalyst broadcasts the list of keys if it is small enough."""
    keys = list(keys)
    chosen = df.select(*keys).distinct().orderBy(*keys).limit(n)
    return key_join(df, chosen, keys, "left_semi")


def neighbour_pairs(df: DataFrame, name: str, estimate: str) -> DataFrame:
    """Pairs of neighbours when levels are ordered by falling estimate."""
    from .ranking import rank_values

    ranked = rank_values(df.withColumn("_neg", -F.col(estimate)), [], ["_neg", name]).rows
    a = ranked.select(F.col("dense").alias("_at"), F.col(name).alias("upper"), (-F.col("_neg")).alias("upper_estimate"))
    b = ranked.select((F.col("dense") - 1).alias("_at"), F.col(name).alias("lower"), (-F.col("_neg")).alias("lower_estimate"))
    return a.join(b, "_at").select(
        F.col("_at").cast("int").alias("pair"), "upper", "lower",
        (F.col("upper_estimate") - F.col("lower_estimate")).alias("difference"),
    )
