"""Row filters, flags, completeness and duplicate rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import near
from .joins import hand_back, key_join


def select_by_name(df: DataFrame, wanted: dict[str, str], how: str = "prefix") -> DataFrame:
    """``wanted`` maps a new name to the prefix or substring of exactly one column."""
    test = str.startswith if how == "prefix" else str.__contains__
    picked = []
    for new, text in wanted.items():
        hits = [c for c in df.columns if test(c, text)]
        if len(hits) != 1:
            raise ValueError(f"{text!r} matches {hits}")
        picked.append(F.col(f"`{hits[0]}`").alias(new))
    return df.select(*picked)


def select_range(df: DataFrame, first: str, last: str) -> DataFrame:
    names = df.columns
    return df.select(*names[names.index(first) : names.index(last) + 1])


def in_range(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def matching(df: DataFrame, column: str, pattern: str, keep: bool = True) -> DataFrame:
    """Rows whose text matches (or does not match) the pattern; NULL is dropped either way."""
    hit = F.col(column).rlike(pattern)
    return df.filter(hit if keep else ~hit)


def exclude_pairs(df: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows listed in an exclusion table."""
    return key_join(df, pairs, keys, "left_anti")


def day_night(df: DataFrame, light: str, out: str = "light_group", dark_below: float = 1.0) -> DataFrame:
    """True by day. Readings under ``dark_below`` are set to zero first."""
    clean = F.when(F.col(light) < dark_below, F.lit(0.0)).otherwise(F.col(light))
    df = df.withColumn(light, clean)
    return df.withColumn(out, ~near(light, 0.0))


def half_day(df: DataFrame, hour: str, out: str = "half") -> DataFrame:
    return df.withColumn(out, F.when(F.col(hour) < 12, "AM").when(F.col(hour) >= 12, "PM"))


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL or NaN in any of the columns."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def attach_count(df: DataFrame, keys: Sequence[str], out: str, spread_by: Sequence[str]) -> DataFrame:
    """Row count of each row's group, with map-side counting and no per-group window."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return hand_back(df, counts.withColumn("_n", F.col(out)), keys, "_n", spread_by)


def complete_groups(df: DataFrame, keys: Sequence[str], expected: int, spread_by: Sequence[str]) -> DataFrame:
    """Rows of the groups that hold exactly ``expected`` rows."""
    counted = attach_count(df, keys, "_size", spread_by)
    return counted.filter(near(F.col("_size").cast("double"), float(expected))).drop("_size")


def incomplete_groups(df: DataFrame, keys: Sequence[str], expected: int, out: str = "n") -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return counts.filter(~near(F.col(out).cast("double"), float(expected)))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates collapse map-side before the shuffle. The grouping columns are part
    of the row, so distinct within each group equals distinct overall."""
    return df.dropDuplicates()
