"""Joins: key joins, interval matching, lookups and group results handed back to rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

PIECE_ROWS = 2_000_000  # rows of one group that are joined together; larger groups are cut
BROADCAST_ROWS = 20_000  # a counted table of at most this many narrow rows may be broadcast


def dimension(spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str]) -> DataFrame:
    """Small literal table. It is a local relation, so Catalyst knows its size and
    broadcasts it only below the session's threshold."""
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table({n: list(c) for n, c in zip(names, columns)}))


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where missing keys match each other and each key appears once in the result.

    The right keys are renamed first, so both sides may come from the same table.
    """
    keys = list(keys)
    r = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(r, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    rest = [c for c in right.columns if c not in keys]
    if how == "full_outer":
        merged = [F.coalesce(k, f"_r_{k}").alias(k) for k in keys]
        return joined.select(*merged, *[c for c in left.columns if c not in keys], *rest)
    return joined.select(*left.columns, *rest)


def inner_on_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Inner join; other columns of equal name get suffixes."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    a = left.select([F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in left.columns])
    b = right.select([F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in right.columns])
    return key_join(a, b, keys)


def full_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return key_join(left, right, keys, "full_outer")


def full_chain(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: full_on_keys(a, b, keys), frames)


def within_intervals(
    readings: DataFrame,
    intervals: DataFrame,
    site: str = "location",
    ts: str = "datetime",
    start: str = "start_date",
    end: str = "end_date",
) -> DataFrame:
    """Readings inside any interval of their site, both ends included, each kept once.

    Intervals are cut into calendar days so the match is an equi-join on (site, day)
    with the exact range test on top: a busy site is spread over its days, and the
    interval table may be of any size. A missing end means that the logger is still out, a
    missing start that it was out before the first reading; days without readings are not made.
    """
    span = readings.agg(F.struct(F.min(ts).alias("first"), F.max(ts).alias("last"))).scalar()
    days = (
        intervals.select(F.col(site).alias("_site"), F.col(start).alias("_start"), F.col(end).alias("_end"), span.alias("_span"))
        .withColumns({"_start": F.coalesce("_start", "_span.first"), "_end": F.coalesce("_end", "_span.last")})
        .withColumns({"_low": F.to_date(F.greatest("_start", "_span.first")), "_high": F.to_date(F.least("_end", "_span.last"))})
        .filter("_start <= _end AND _low <= _high")
        .withColumn("_date", F.explode(F.sequence("_low", "_high"))).drop("_span", "_low", "_high")
    )
    match = (
        F.col(site).eqNullSafe(F.col("_site"))
        & (F.col("_day") == F.col("_date"))
        & F.col(ts).between(F.col("_start"), F.col("_end"))
    )
    return readings.withColumn("_day", F.to_date(ts)).join(days, match, "left_semi").drop("_day")


def hand_back(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    size: str,
    spread_by: Sequence[str],
    known_rows: int | None = None,
) -> DataFrame:
    """Left join one-row-per-group results onto rows without piling a hot group on one task.

    ``groups`` holds the row count of each group in ``size`` and is written once, so the rows
    behind it are aggregated once. Groups of more than PIECE_ROWS rows are cut into pieces of about
    that size by a hash of ``spread_by``; they number fewer than (all rows / PIECE_ROWS), a list
    that is safe to broadcast. The join itself is Catalyst's choice by the written size.
    When the caller has counted ``groups`` and they are few, they are broadcast whole.
    """
    keys = list(keys)
    if known_rows is not None and known_rows <= BROADCAST_ROWS:
        return key_join(rows, F.broadcast(groups.drop(size)), keys, "left")
    groups = materialize(groups, "groups")
    hot = groups.filter(F.col(size) > PIECE_ROWS).select(*keys, F.ceil(F.col(size) / PIECE_ROWS).cast("int").alias("_pieces"))
    if not hot.limit(1).count():
        return key_join(rows, groups.drop(size), keys, "left")
    left = key_join(rows, F.broadcast(hot), keys, "left")
    left = left.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_pieces")).cast("int"), F.lit(0))).drop("_pieces")
    right = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.ceil(F.col(size) / PIECE_ROWS).cast("int") - 1))).drop(size)
    return key_join(left, right, keys + ["_part"], "left").drop("_part")


def apply_factor(
    rows: DataFrame, factors: DataFrame, key: str, value: str, factor: str, out: str
) -> DataFrame:
    """Multiply a reading by the coefficient of its logger; unknown loggers give NULL.

    A factor table that has been counted and is small is broadcast. A larger one is sorted and merged
    with the readings, never gathered in one place; a logger with very many readings is split by
    the session's skew handling.
    """
    f = factors.select(F.col(key).alias("_fkey"), F.col(factor).alias("_factor"))
    small = f.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(f) if small else f.hint("merge"), F.col(key) == F.col("_fkey"), "left")
    return joined.withColumn(out, F.col(value) * F.col("_factor")).drop("_fkey", "_factor")


def alias_sites(df: DataFrame, site: str, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Repeat the records of a site under each of its further names."""
    extra = F.lit(None).cast("array<string>")
    for code, names in aliases.items():
        extra = F.when(F.col(site) == code, F.array(*[F.lit(n) for n in names])).otherwise(extra)
    every = F.concat(F.array(F.col(site)), F.coalesce(extra, F.array().cast("array<string>")))
    return df.withColumn(site, F.explode(every))


def label_sites(
    df: DataFrame, sites: DataFrame, code: str = "location", index: str = "site_idx", label: str = "site_label"
) -> DataFrame:
    """Ordered index and display label of each site code; unknown codes keep NULL."""
    d = sites.select(F.col("code").alias("_code"), F.col("idx").alias(index), F.col("label").alias(label))
    return df.join(d, F.col(code) == F.col("_code"), "left").drop("_code")


def linear_grid(df: DataFrame, column: str, low, high, points: int, closed: bool = True) -> DataFrame:
    """Each row repeated over ``points`` equally spaced values of ``column``.

    ``closed=False`` leaves out the upper end (step = range / points).
    """
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    steps = points - 1 if closed else points
    out = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return out.withColumn(column, low + F.col("_i") * ((high - low) / F.lit(float(steps)))).drop("_i")


def grid_by_level(df: DataFrame, level: str, column: str, low, high, points: int) -> DataFrame:
    """Every grid point for every distinct level."""
    return linear_grid(df.select(level).distinct(), column, low, high, points)
