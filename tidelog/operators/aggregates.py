"""Grouped summaries and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import floor_minutes
from ..functions.values import mean_of, sd_of, standard_error, sum_of

LIGHT_SECONDS = 600  # seconds one 10-minute reading stands for


def minute_stats(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, minutes: int = 1, na_rm: bool = False
) -> DataFrame:
    slot = floor_minutes(ts, minutes).alias(ts)
    return df.groupBy(*keys, slot).agg(
        mean_of(value, na_rm).alias(f"mean_{value}"), sd_of(value, na_rm).alias(f"sd_{value}")
    )


def daily_dose(
    df: DataFrame, keys: Sequence[str], flux: str, seconds_per_sample: float = LIGHT_SECONDS, na_rm: bool = False
) -> DataFrame:
    """Light sum in mol per m2: negative flux counts as zero, micromol per second x seconds / 1e6.

    600 is right for 10-minute readings; other callers used 60 (a tenth of it).
    """
    clean = F.when(F.col(flux) < 0, F.lit(0.0)).otherwise(F.col(flux))
    return df.groupBy(*keys).agg((sum_of(clean * F.lit(float(seconds_per_sample)), na_rm) / 1e6).alias("dose"))


def group_mean(df: DataFrame, keys: Sequence[str], value: str, out: str, na_rm: bool = True) -> DataFrame:
    return df.groupBy(*keys).agg(mean_of(value, na_rm).alias(out))


def band(df: DataFrame, keys: Sequence[str], value: str, na_rm: bool = True) -> DataFrame:
    """Mean, sd, non-missing count and mean -/+ sd/sqrt(n-1) (one such error, not a 95 % interval)."""
    out = df.groupBy(*keys).agg(
        mean_of(value, na_rm).alias("mean"), sd_of(value, na_rm).alias("sd"), F.count(value).alias("n")
    )
    se = standard_error("sd", "n")
    return out.withColumn("l95", F.col("mean") - se).withColumn("u95", F.col("mean") + se)


def two_level_mean(
    df: DataFrame, fine: Sequence[str], coarse: Sequence[str], value: str, out: str = "mean", na_rm: bool = True
) -> DataFrame:
    """Mean of the fine-group means; each fine group counts once whatever its size."""
    inner = df.groupBy(*fine).agg(mean_of(value, na_rm).alias("_fine"))
    return inner.groupBy(*coarse).agg(mean_of("_fine", na_rm).alias(out))


def geometric_band(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Geometric mean and error band: statistics on the log scale, transformed back. Values must be > 0."""
    logs = F.ln(F.col(value))
    out = df.groupBy(*keys).agg(
        F.avg(logs).alias("_m"), F.stddev_samp(logs).alias("_s"), F.count(logs).alias("n")
    )
    se = standard_error("_s", "n")
    return out.select(
        *keys, "n",
        F.exp("_m").alias("gmean"),
        F.exp(F.col("_m") - se).alias("l95"),
        F.exp(F.col("_m") + se).alias("u95"),
    )


def multi_stats(df: DataFrame, keys: Sequence[str], value: str, na_rm: bool = True) -> DataFrame:
    def strict(fn):
        c = F.col(value)
        return fn(c) if na_rm else F.when(F.count(c) == F.count(F.lit(1)), fn(c))

    return df.groupBy(*keys).agg(
        strict(F.avg).alias("mean"), strict(F.stddev_samp).alias("sd"),
        strict(F.min).alias("min"), strict(F.max).alias("max"),
    )


def total_then_mean(df: DataFrame, fine: Sequence[str], coarse: Sequence[str], value: str) -> DataFrame:
    """Daily totals, then the mean of the totals (named for what they are)."""
    inner = df.groupBy(*fine).agg(sum_of(value).alias("daily_total"))
    return inner.groupBy(*coarse).agg(F.avg("daily_total").alias("mean_total"))


def model_sizes(df: DataFrame, light: str, group: str) -> DataFrame:
    return df.agg(
        F.max(light).alias("max_light"),
        F.count_distinct(group).alias("n_groups"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def spread(df: DataFrame, keys: Sequence[str], key: str, levels: Sequence[str], value: str) -> DataFrame:
    """Long to wide; NULL where a level is absent, an error where it occurs twice.

    Written as conditional aggregates over the given levels: one shuffle, no pass
    to discover the levels.
    """
    out = []
    for level in levels:
        at = F.col(key) == level
        once = F.count(F.when(at, 1)) <= 1
        out.append(
            F.when(once, F.max(F.when(at, F.col(value))))
            .otherwise(F.raise_error(F.lit(f"duplicate {key}={level}")))
            .alias(level)
        )
    return df.groupBy(*keys).agg(*out)


def gather(df: DataFrame, keys: Sequence[str], columns: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), key, value)


def sum_of_levels(
    df: DataFrame, keys: Sequence[str], key: str, levels: Sequence[str], value: str, out: str
) -> DataFrame:
    """Wide by ``key`` and add the levels by key; NULL when one of them is missing."""
    wide = spread(df, keys, key, levels, value)
    total = F.col(levels[0])
    for level in levels[1:]:
        total = total + F.col(level)
    return wide.withColumn(out, total)


def nest_chunks(df: DataFrame, keys: Sequence[str], spread_by: Sequence[str], out: str = "data", chunk_rows: int = 5000) -> DataFrame:
    """Rows of each group as arrays of structs, at most about ``chunk_rows`` per array.

    A large group becomes several nested rows (``chunk`` tells them apart), so no
    array grows with the group; :func:`fold_chunks` brings a group back to one row and
    :func:`unnest` restores every row.
    """
    from .cleaning import attach_count

    rest = [c for c in df.columns if c not in keys]
    sized = attach_count(df, keys, "_size", spread_by)
    chunks = F.ceil(F.col("_size") / F.lit(chunk_rows)).cast("bigint")
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64(*spread_by), chunks))
    return sized.groupBy(*keys, "chunk").agg(F.collect_list(F.struct(*rest)).alias(out))


def fold_chunks(df: DataFrame, keys: Sequence[str], partial: Mapping[str, Column], merge: Mapping[str, Column]) -> DataFrame:
    """One row per group: ``partial`` maps each chunk to columns, ``merge`` aggregates these columns over the chunks."""
    parts = df.select(*keys, *[c.alias(name) for name, c in partial.items()])
    return parts.groupBy(*keys).agg(*[c.alias(name) for name, c in merge.items()])


def unnest(df: DataFrame, keys: Sequence[str], data: str = "data") -> DataFrame:
    return df.select(*keys, F.inline(F.col(data)))
