"""Queries: grouped summaries, production balance and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import mean_of, sd_of, snap, snap_sql, sum_of
from ..operators import aggregates as ag
from ..operators import cleaning as cl
from ..operators import joins as jn
from ..operators import production as pr
from ..operators import ranking as rk
from .registry import query
from .tables import (
    DAILY, DEPLOY_SQL, LINES, READINGS, SITES_SQL, daily, deployments, lines, readings, sites, table, with_views,
)


def _snapped(df, *columns, digits=4):
    for c in columns:
        df = df.withColumn(c, snap(F.col(f"`{c}`"), digits))
    return df


@query(
    "minute_stats",
    with_views(
        f"""SELECT location, date_trunc('minute', datetime) AS datetime, {snap_sql('avg(ppfd)')} AS mean_ppfd,
                   {snap_sql('stddev_samp(ppfd)')} AS sd_ppfd FROM readings GROUP BY ALL""", READINGS),
)
def minute_stats(spark, d):
    out = ag.minute_stats(readings(spark, d).select("location", "datetime", "ppfd"), ["location"], "datetime", "ppfd")
    return _snapped(out, "mean_ppfd", "sd_ppfd")


@query(
    "daily_dose",
    with_views(
        f"""SELECT location, day, {snap_sql('sum(CASE WHEN rate < 0 THEN 0 ELSE rate END * 600) / 1e6', 6)} AS dose,
                   {snap_sql('sum(CASE WHEN rate < 0 THEN 0 ELSE rate END * 60) / 1e6', 6)} AS dose_60
            FROM readings GROUP BY ALL""", READINGS),
)
def daily_dose(spark, d):
    # Both sampling assumptions side by side; the default is 600 seconds per reading.
    out = ag.daily_dose(readings(spark, d), ["location", "day"], "rate")
    return out.select("location", "day", snap("dose", 6).alias("dose"), snap(F.col("dose") / 10, 6).alias("dose_60"))


@query(
    "daily_mean",
    with_views(f"SELECT location, day, {snap_sql('avg(gappy)')} AS temperature FROM readings GROUP BY ALL", READINGS),
)
def daily_mean(spark, d):
    return _snapped(ag.group_mean(readings(spark, d), ["location", "day"], "gappy", "temperature"), "temperature")


INTEGRATED = """integrated AS (
  SELECT day, location, position, light_group,
         CASE WHEN light_group THEN total ELSE total / hours * 24 END AS rate_sum, hours
  FROM (SELECT day, location, position, ppfd >= 20 AS light_group,
               sum(rate) / 6 AS total, count(*) / 6.0::DOUBLE AS hours FROM kept GROUP BY 1, 2, 3, 4))"""
KEPT_ALL = "kept AS (SELECT * FROM readings)"
KEPT_DEPLOYED = """kept AS (
  SELECT * FROM readings r WHERE EXISTS (SELECT 1 FROM deploy p WHERE p.location = r.location
     AND r.datetime >= p.start_date AND r.datetime <= p.end_date))"""
KEYS = ["day", "location", "position"]


@query(
    "day_night_integral",
    with_views(
        f"SELECT day, location, position, light_group, {snap_sql('rate_sum')} AS rate_sum, {snap_sql('hours')} AS hours FROM integrated",
        READINGS, KEPT_ALL, INTEGRATED),
)
def day_night_integral(spark, d):
    flagged = cl.day_night(readings(spark, d), "ppfd", dark_below=20.0)
    return _snapped(pr.integrate(flagged, KEYS), "rate_sum", "hours")


@query(
    "production_balance",
    with_views(
        f"""SELECT site_label, month, key, count(*) AS n, {snap_sql('avg(v)')} AS mean, {snap_sql('stddev_samp(v)')} AS sd FROM (
              SELECT s.label AS site_label, CAST(month(day) AS INTEGER) AS month, key, v FROM (
                UNPIVOT (SELECT * FROM (SELECT *, NEP + RP AS GEP FROM (
                    SELECT day, location, position,
                           -max(rate_sum) FILTER (NOT light_group) AS RP, max(rate_sum) FILTER (light_group) AS NEP
                    FROM integrated GROUP BY ALL) WHERE RP > 0 AND NEP IS NOT NULL) WHERE GEP > 0)
                ON RP, NEP, GEP INTO NAME key VALUE v) u
              LEFT JOIN sites s ON s.code = u.location) GROUP BY ALL""",
        READINGS, DEPLOY_SQL, KEPT_DEPLOYED, INTEGRATED, SITES_SQL),
)
def production_balance(spark, d):
    """Readings in deployments -> day/night -> daily balance -> labelled monthly summary."""
    r = readings(spark, d).select("location", "position", "datetime", "day", "ppfd", "rate")
    deployed = jn.within_intervals(r, deployments(spark, d))
    flagged = cl.day_night(deployed, "ppfd", dark_below=20.0)
    wide = pr.balance(pr.integrate(flagged, KEYS), KEYS)
    long = ag.gather(wide, KEYS, ["RP", "NEP", "GEP"]).withColumn("month", F.month("day"))
    labelled = jn.label_sites(long, sites(spark))
    out = labelled.groupBy("site_label", "month", "key").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )
    return _snapped(out, "mean", "sd")


@query(
    "depth_sum",
    with_views(
        f"""SELECT day, location, key, {snap_sql('a')} AS "0m", {snap_sql('b')} AS "1m", {snap_sql('a + b')} AS value FROM (
              SELECT day, location, key, sum(value) FILTER (position = '0m') AS a, sum(value) FILTER (position = '1m') AS b
              FROM daily GROUP BY ALL)""", DAILY),
)
def depth_sum(spark, d):
    per_depth = daily(spark, d).groupBy("day", "location", "key", "position").agg(F.sum("value").alias("v"))
    out = ag.sum_of_levels(per_depth, ["day", "location", "key"], "position", ["0m", "1m"], "v", "value")
    return _snapped(out, "0m", "1m", "value")


@query(
    "monthly_se_band",
    with_views(
        f"""SELECT location, month, {snap_sql('m')} AS mean, {snap_sql('s')} AS sd, n,
                   CASE WHEN n > 1 THEN {snap_sql('m - s / sqrt(n - 1)')} END AS l95,
                   CASE WHEN n > 1 THEN {snap_sql('m + s / sqrt(n - 1)')} END AS u95
            FROM (SELECT location, month, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM daily GROUP BY ALL)""", DAILY),
)
def monthly_se_band(spark, d):
    return _snapped(ag.band(daily(spark, d), ["location", "month"], "value"), "mean", "sd", "l95", "u95")


@query(
    "two_level_mean",
    with_views(
        f"""SELECT location, month, {snap_sql('avg(v)')} AS mean FROM (
              SELECT location, month, day, avg(value) AS v FROM daily GROUP BY ALL) GROUP BY ALL""", DAILY),
)
def two_level_mean(spark, d):
    out = ag.two_level_mean(daily(spark, d), ["location", "month", "day"], ["location", "month"], "value")
    return _snapped(out, "mean")


@query(
    "geometric_band",
    with_views(
        f"""SELECT location, month, n, {snap_sql('exp(m)')} AS gmean, {snap_sql('exp(m - s / sqrt(n - 1))')} AS l95,
                   {snap_sql('exp(m + s / sqrt(n - 1))')} AS u95
            FROM (SELECT location, month, avg(ln(value)) AS m, stddev_samp(ln(value)) AS s, count(*) AS n FROM daily GROUP BY ALL)""", DAILY),
)
def geometric_band(spark, d):
    return _snapped(ag.geometric_band(daily(spark, d), ["location", "month"], "value"), "gmean", "l95", "u95")


@query(
    "multi_stats",
    with_views(
        f"""SELECT location, month, {snap_sql('avg(value)')} AS mean, {snap_sql('stddev_samp(value)')} AS sd,
                   {snap_sql('min(value)')} AS min, {snap_sql('max(value)')} AS max FROM daily GROUP BY ALL""", DAILY),
)
def multi_stats(spark, d):
    return _snapped(ag.multi_stats(daily(spark, d), ["location", "month"], "value"), "mean", "sd", "min", "max")


@query(
    "complete_groups",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 4)",
)
def complete_groups(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return cl.complete_groups(t, ["l_orderkey"], 4, ["l_linenumber", "l_quantity"])


@query("incomplete_groups", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) <> 4")
def incomplete_groups(spark, d):
    return cl.incomplete_groups(table(spark, d, "lineitem").select("l_orderkey"), ["l_orderkey"], 4)


@query(
    "dedup_rows",
    "SELECT DISTINCT CAST(ts AS DATE) AS day, event_type, user_id % 20 AS logger, CAST(round(value) AS BIGINT) AS level FROM events",
)
def dedup_rows(spark, d):
    return cl.distinct_rows(table(spark, d, "events").select(
        F.to_date("ts").alias("day"), "event_type", (F.col("user_id") % 20).alias("logger"),
        F.round("value").cast("bigint").alias("level"),
    ))


@query("distinct_values", with_views("SELECT DISTINCT location, position FROM readings", READINGS))
def distinct_values(spark, d):
    return readings(spark, d).select("location", "position").distinct()


@query(
    "overall_mean",
    with_views(
        f"""SELECT location, {snap_sql('avg(value)')} AS mean FROM daily GROUP BY location
            UNION ALL SELECT NULL, {snap_sql('avg(value)')} FROM daily""", DAILY),
)
def overall_mean(spark, d):
    # Site sums are enough for the overall mean: the rows are read once.
    per_site = daily(spark, d).groupBy("location").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    both = per_site.rollup("location").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return _snapped(both, "mean")


@query("value_range", with_views("SELECT location, min(raw) AS low, max(raw) AS high FROM daily GROUP BY location", DAILY))
def value_range(spark, d):
    return daily(spark, d).groupBy("location").agg(F.min("raw").alias("low"), F.max("raw").alias("high"))


@query(
    "box_stats",
    with_views(
        f"""SELECT location, month, {snap_sql('any_value(q1)')} AS q1, {snap_sql('any_value(q2)')} AS median, {snap_sql('any_value(q3)')} AS q3,
                   {snap_sql('min(raw) FILTER (inside)')} AS whisker_low, {snap_sql('max(raw) FILTER (inside)')} AS whisker_high,
                   count(*) FILTER (NOT inside) AS n_outliers, count(*) AS n
            FROM (SELECT d.location, d.month, raw, q1, q2, q3, raw BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
                  FROM skewed d JOIN (SELECT location, month, quantile_cont(raw, 0.25) q1, quantile_cont(raw, 0.5) q2, quantile_cont(raw, 0.75) q3
                                     FROM skewed GROUP BY ALL) q USING (location, month)) GROUP BY ALL""", DAILY,
        "skewed AS (SELECT location, month, raw * raw / 100000 AS raw FROM daily)"),
)
def box_stats(spark, d):
    t = daily(spark, d).select("location", "month", (F.col("raw") * F.col("raw") / 100000).alias("raw"))
    return _snapped(rk.box_stats(t, ["location", "month"], "raw"), "q1", "median", "q3", "whisker_low", "whisker_high")


@query("non_null_count", with_views("SELECT location, count(gappy) AS n, count(*) AS n_rows FROM readings GROUP BY location", READINGS))
def non_null_count(spark, d):
    return readings(spark, d).groupBy("location").agg(F.count("gappy").alias("n"), F.count(F.lit(1)).alias("n_rows"))


@query("group_sizes", with_views("SELECT location, day, count(*) AS size FROM readings GROUP BY ALL", READINGS))
def group_sizes(spark, d):
    return readings(spark, d).groupBy("location", "day").agg(F.count(F.lit(1)).alias("size"))


@query(
    "daily_total_month_mean",
    with_views(
        f"""SELECT location, month, {snap_sql('avg(t)')} AS mean_total FROM (
              SELECT location, month, day, sum(value) AS t FROM daily GROUP BY ALL) GROUP BY ALL""", DAILY),
)
def daily_total_month_mean(spark, d):
    return _snapped(ag.total_then_mean(daily(spark, d), ["location", "month", "day"], ["location", "month"], "value"), "mean_total")


@query("nest_unnest", with_views("SELECT location, day, event_id, ppfd FROM readings", READINGS))
def nest_unnest(spark, d):
    r = readings(spark, d).select("location", "day", "event_id", "ppfd")
    return ag.unnest(ag.nest_chunks(r, ["location", "day"], ["event_id"]), ["location", "day"])


@query(
    "nest_fold",
    with_views(f"SELECT location, day, count(*) AS n, {snap_sql('avg(ppfd)')} AS mean, max(ppfd) AS top FROM readings GROUP BY ALL", READINGS),
)
def nest_fold(spark, d):
    r = readings(spark, d).select("location", "day", "event_id", "ppfd")
    nested = ag.nest_chunks(r, ["location", "day"], ["event_id"], chunk_rows=50)
    light = F.col("data.ppfd")
    partial = {"c": F.size("data").cast("bigint"), "s": F.aggregate(light, F.lit(0.0), lambda a, v: a + v), "m": F.array_max(light)}
    out = ag.fold_chunks(nested, ["location", "day"], partial, {"n": F.sum("c"), "mean": F.sum("s") / F.sum("c"), "top": F.max("m")})
    return out.withColumn("mean", snap("mean"))


@query(
    "pivot_wide",
    with_views(
        f"""SELECT location, month, {snap_sql("sum(value) FILTER (key = 'GEP')")} AS "GEP",
                   {snap_sql("sum(value) FILTER (key = 'NEP')")} AS "NEP", {snap_sql("sum(value) FILTER (key = 'RP')")} AS "RP"
            FROM daily GROUP BY ALL""", DAILY),
)
def pivot_wide(spark, d):
    totals = daily(spark, d).groupBy("location", "month", "key").agg(snap(F.sum("value")).alias("v"))
    return ag.spread(totals, ["location", "month"], "key", ["GEP", "NEP", "RP"], "v")


@query(
    "unpivot_long",
    with_views(
        """SELECT event_id, 'ppfd' AS key, ppfd AS value FROM readings
           UNION ALL SELECT event_id, 'gappy', gappy FROM readings""", READINGS),
)
def unpivot_long(spark, d):
    return ag.gather(readings(spark, d), ["event_id"], ["ppfd", "gappy"])


@query(
    "na_strict_mean",
    with_views(
        f"""SELECT logger, day, {snap_sql('CASE WHEN count(gappy) = count(*) THEN avg(gappy) END')} AS strict_mean,
                   {snap_sql('CASE WHEN count(gappy) = count(*) THEN stddev_samp(gappy) END')} AS strict_sd,
                   {snap_sql('CASE WHEN count(gappy) = count(*) THEN sum(gappy) END')} AS strict_sum,
                   {snap_sql('avg(gappy)')} AS loose_mean FROM readings GROUP BY ALL""", READINGS),
)
def na_strict_mean(spark, d):
    return readings(spark, d).groupBy("logger", "day").agg(
        snap(mean_of("gappy")).alias("strict_mean"), snap(sd_of("gappy")).alias("strict_sd"),
        snap(sum_of("gappy")).alias("strict_sum"), snap(mean_of("gappy", na_rm=True)).alias("loose_mean"),
    )


@query(
    "model_sizes",
    with_views("SELECT max(x) AS max_light, count(DISTINCT location) AS n_groups, count(*) AS n_rows FROM lines", LINES),
)
def model_sizes(spark, d):
    return ag.model_sizes(lines(spark, d), "x", "location")
