"""Daily production balance from oxygen rates and light."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integrate(
    df: DataFrame,
    keys: Sequence[str],
    rate: str = "rate",
    light: str = "light_group",
    samples_per_hour: float = 6.0,
    per_hour: bool = True,
) -> DataFrame:
    """Summed rate and hours per group, by day and by night; the night sum is scaled to 24 h.

    ``rate`` is per hour, so each reading counts 1/samples_per_hour of it.
    ``per_hour=False`` adds the readings undivided, as older tables did.
    """
    weight = 1.0 / samples_per_hour if per_hour else 1.0
    out = df.groupBy(*keys, light).agg(
        (F.sum(rate) * F.lit(weight)).alias("rate_sum"),
        (F.count(F.lit(1)) / F.lit(samples_per_hour)).alias("hours"),
    )
    night = F.col("rate_sum") / F.col("hours") * 24
    return out.withColumn("rate_sum", F.when(~F.col(light), night).otherwise(F.col("rate_sum")))


def balance(
    integrated: DataFrame, keys: Sequence[str], light: str = "light_group", nep_scope: str = "day"
) -> DataFrame:
    """RP (night, sign turned), NEP and GEP = NEP + RP; invalid or incomplete days are dropped.

    ``nep_scope='day'`` takes NEP from the light hours only; ``'24h'`` adds the unscaled
    night part so NEP covers the whole day.
    """
    day, night = F.col(light), ~F.col(light)
    wide = integrated.groupBy(*keys).agg(
        (-F.max(F.when(night, F.col("rate_sum")))).alias("RP"),
        F.max(F.when(day, F.col("rate_sum"))).alias("NEP"),
        F.max(F.when(night, F.col("rate_sum") * F.col("hours") / 24)).alias("_night"),
    )
    if nep_scope == "24h":
        wide = wide.withColumn("NEP", F.col("NEP") + F.col("_night"))
    out = wide.drop("_night").withColumn("RP", F.when(F.col("RP") > 0, F.col("RP")))
    out = out.withColumn("GEP", F.col("NEP") + F.col("RP"))
    return out.withColumn("GEP", F.when(F.col("GEP") > 0, F.col("GEP"))).na.drop("any", subset=["RP", "NEP", "GEP"])
