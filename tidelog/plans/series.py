"""Queries: joins, group-relative values, samples, sorts and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import floor_minutes
from ..functions.values import snap, snap_sql
from ..operators import aggregates as ag
from ..operators import cleaning as cl
from ..operators import joins as jn
from ..operators import ordering as od
from ..operators import ranking as rk
from ..operators import windows as wn
from .registry import query
from .tables import (
    DAILY, DEPLOY_SQL, LINES, READINGS, SITES_SQL, daily, deployments, lines, readings, sites, table, with_views,
)

# --- joins -------------------------------------------------------------------


@query(
    "join_inner_keys",
    with_views(
        f"""SELECT a.location, a.day, a.hour, a.mean AS mean_x, b.mean AS mean_y FROM
              (SELECT location, day, hour(datetime) AS hour, {snap_sql('avg(rate)')} AS mean FROM readings
               WHERE regexp_matches(position, '0m') GROUP BY ALL) a
            JOIN (SELECT location, day, hour(datetime) AS hour, {snap_sql('avg(ppfd)')} AS mean FROM readings
               WHERE regexp_matches(position, '1m') GROUP BY ALL) b USING (location, day, hour)""", READINGS),
)
def join_inner_keys(spark, d):
    r = readings(spark, d).withColumn("hour", F.hour("datetime").cast("bigint"))
    keys = ["location", "day", "hour"]
    upper = cl.matching(r, "position", "0m").groupBy(*keys).agg(snap(F.avg("rate")).alias("mean"))
    lower = cl.matching(r, "position", "1m").groupBy(*keys).agg(snap(F.avg("ppfd")).alias("mean"))
    return jn.inner_on_keys(upper, lower, keys)


@query(
    "join_full_two_keys",
    with_views(
        f"""SELECT day, location, {snap_sql('a.v')} AS early, {snap_sql('b.v')} AS late FROM
              (SELECT day, location, sum(value) v FROM daily WHERE key = 'NEP' GROUP BY ALL) a
            FULL JOIN (SELECT day, location, sum(value) v FROM daily WHERE key = 'RP' GROUP BY ALL) b
            USING (day, location)""", DAILY),
)
def join_full_two_keys(spark, d):
    t = daily(spark, d)
    a = t.filter("key = 'NEP'").groupBy("day", "location").agg(snap(F.sum("value")).alias("early"))
    b = t.filter("key = 'RP'").groupBy("day", "location").agg(snap(F.sum("value")).alias("late"))
    return jn.full_on_keys(a, b, ["day", "location"])


@query(
    "join_full_chain",
    with_views(
        f"""SELECT coalesce(ab.location, c.location) AS location, coalesce(ab.month, c.month) AS month,
                   coalesce(ab.day, c.day) AS day, nep, rp, gep FROM
              (SELECT coalesce(a.location, b.location) AS location, coalesce(a.month, b.month) AS month,
                      coalesce(a.day, b.day) AS day, nep, rp
               FROM (SELECT nullif(location, '5-LOW') AS location, month, day, {snap_sql('sum(value)')} nep FROM daily WHERE key = 'NEP' GROUP BY ALL) a
               FULL JOIN (SELECT nullif(location, '5-LOW') AS location, month, day, {snap_sql('sum(value)')} rp FROM daily WHERE key = 'RP' GROUP BY ALL) b
               ON a.location IS NOT DISTINCT FROM b.location AND a.month = b.month AND a.day = b.day) ab
            FULL JOIN (SELECT nullif(location, '5-LOW') AS location, month, day, {snap_sql('sum(value)')} gep FROM daily WHERE key = 'GEP' GROUP BY ALL) c
            ON ab.location IS NOT DISTINCT FROM c.location AND ab.month = c.month AND ab.day = c.day""", DAILY),
)
def join_full_chain(spark, d):
    # One site is unnamed: missing keys must meet each other.
    t = daily(spark, d).withColumn("location", F.nullif("location", F.lit("5-LOW")))
    keys = ["location", "month", "day"]

    def total(key):
        return t.filter(F.col("key") == key).groupBy(*keys).agg(snap(F.sum("value")).alias(key.lower()))

    return jn.full_chain([total("NEP"), total("RP"), total("GEP")], keys)


@query(
    "join_interval_semi",
    with_views(
        """SELECT r.event_id, r.location, r.datetime FROM readings r
           WHERE EXISTS (SELECT 1 FROM deploy p WHERE p.location = r.location
                         AND r.datetime >= p.start_date AND r.datetime <= p.end_date)""", READINGS, DEPLOY_SQL),
)
def join_interval_semi(spark, d):
    return jn.within_intervals(readings(spark, d).select("event_id", "location", "datetime"), deployments(spark, d))


@query(
    "pair_depths",
    with_views(
        f"""SELECT location, slot, {snap_sql('a')} AS "0m", {snap_sql('b')} AS "1m", {snap_sql('a + b')} AS both_rates FROM (
              SELECT location, time_bucket(INTERVAL 30 MINUTE, datetime) AS slot,
                     avg(rate) FILTER (position = '0m') AS a, avg(rate) FILTER (position = '1m') AS b
              FROM readings GROUP BY ALL) WHERE a + b IS NOT NULL""", READINGS),
)
def pair_depths(spark, d):
    r = readings(spark, d).withColumn("slot", floor_minutes("datetime", 30))
    layers = r.groupBy("location", "slot", "position").agg(F.avg("rate").alias("rate"))
    paired = ag.sum_of_levels(layers, ["location", "slot"], "position", ["0m", "1m"], "rate", "both_rates")
    ok = cl.drop_missing(paired, ["both_rates"])
    return ok.select("location", "slot", *[snap(F.col(f"`{c}`")).alias(c) for c in ("0m", "1m", "both_rates")])


@query(
    "component_sum",
    with_views(
        f"""SELECT location, position, day, nutrient, {snap_sql('v')} AS conc FROM (
              UNPIVOT (SELECT location, position, day, sum(value) FILTER (key = 'NEP') AS no2, sum(value) FILTER (key = 'RP') AS no3,
                              sum(value) FILTER (key = 'NEP') + sum(value) FILTER (key = 'RP') AS no2_no3
                       FROM daily WHERE key <> 'GEP' GROUP BY ALL)
              ON no2, no3, no2_no3 INTO NAME nutrient VALUE v)""", DAILY),
)
def component_sum(spark, d):
    keys = ["location", "position", "day"]
    t = daily(spark, d).filter("key <> 'GEP'").withColumn("nutrient", F.when(F.col("key") == "NEP", "no2").otherwise("no3"))
    sums = t.groupBy(*keys, "nutrient").agg(F.sum("value").alias("conc"))
    wide = ag.sum_of_levels(sums, keys, "nutrient", ["no2", "no3"], "conc", "no2_no3")
    long = ag.gather(wide, keys, ["no2", "no3", "no2_no3"], "nutrient", "conc")
    return long.filter(F.col("conc").isNotNull()).withColumn("conc", snap("conc"))


@query(
    "apply_calibration",
    with_views(
        f"""SELECT l_orderkey, l_linenumber, {snap_sql('l.x * p.p_retailprice / 1000', 6)} AS calibrated
            FROM lines l LEFT JOIN part p ON p.p_partkey + CASE WHEN p.p_partkey % 10 = 3 THEN 1000000000 ELSE 0 END = l.logger""", LINES),
)
def apply_calibration(spark, d):
    shifted = F.col("p_partkey") + F.when(F.col("p_partkey") % 10 == 3, 1_000_000_000).otherwise(0)  # loggers that are unknown
    factors = table(spark, d, "part").select(
        shifted.alias("logger"), (F.col("p_retailprice") / 1000).alias("coefficient")
    )
    rows = lines(spark, d).select("l_orderkey", "l_linenumber", "logger", "x")
    out = jn.apply_factor(rows, factors, "logger", "x", "coefficient", "calibrated")
    return out.select("l_orderkey", "l_linenumber", snap("calibrated", 6).alias("calibrated"))


@query(
    "alias_sites",
    with_views(
        """SELECT event_id, location FROM readings
           UNION ALL SELECT event_id, 'view2' FROM readings WHERE location = 'view'
           UNION ALL SELECT event_id, 'view3' FROM readings WHERE location = 'view'""", READINGS),
)
def alias_sites(spark, d):
    return jn.alias_sites(readings(spark, d).select("event_id", "location"), "location", {"view": ["view2", "view3"]})


@query(
    "grid_cross",
    with_views(
        f"""SELECT location, {snap_sql('1 + i * 11 / 50.0::DOUBLE', 6)} AS month
            FROM (SELECT DISTINCT location FROM daily), (SELECT unnest(range(51))::INTEGER AS i)""", DAILY),
)
def grid_cross(spark, d):
    return jn.grid_by_level(daily(spark, d), "location", "month", 1, 12, 51).withColumn("month", snap("month", 6))


@query(
    "label_sites",
    with_views(
        """SELECT event_id, location, CAST(s.idx AS INTEGER) AS site_idx, s.label AS site_label
           FROM readings LEFT JOIN sites s ON s.code = location""", READINGS, SITES_SQL),
)
def label_sites(spark, d):
    return jn.label_sites(readings(spark, d).select("event_id", "location"), sites(spark))


# --- group-relative values and samples ---------------------------------------


@query(
    "subtract_group_min",
    with_views(
        f"SELECT event_id, {snap_sql('ppfd - min(ppfd) OVER (PARTITION BY location, day)')} AS ppfd FROM readings", READINGS),
)
def subtract_group_min(spark, d):
    r = readings(spark, d).select("event_id", "location", "day", "ppfd")
    out = wn.subtract_group_min(r, ["location", "day"], "ppfd", ["event_id"])
    return out.select("event_id", snap("ppfd").alias("ppfd"))


@query(
    "dense_month_index",
    with_views("SELECT id, CASE WHEN month % 3 = 0 THEN month + 12 ELSE month END AS month, CAST(dense_rank() OVER (ORDER BY CASE WHEN month % 3 = 0 THEN month + 12 ELSE month END) AS INTEGER) AS idx FROM daily", DAILY),
)
def dense_month_index(spark, d):
    later = F.when(F.col("month") % 3 == 0, F.col("month") + 12).otherwise(F.col("month")).cast("int")  # leaves gaps
    t = daily(spark, d).select("id", later.alias("month"))
    return rk.dense_index(t, "month", "idx", ["id"])


@query(
    "first_in_year_label",
    with_views(
        r"""SELECT day, strftime(day, '%m') || '月' ||
                   CASE WHEN row_number() OVER (PARTITION BY year(day) ORDER BY day) = 1
                        THEN chr(10) || strftime(day, '%Y') || '年' ELSE '' END AS label
            FROM (SELECT DISTINCT day FROM daily)""", DAILY),
)
def first_in_year_label(spark, d):
    # chr(10) sits between month and year on the first day of a year.
    return wn.first_in_year_labels(daily(spark, d), "day")


@query(
    "sample_days_per_month",
    with_views(
        """SELECT id, month, day FROM daily WHERE day IN (
             SELECT day FROM (SELECT month, day, row_number() OVER (PARTITION BY month ORDER BY md5('2019|' || day::VARCHAR), day) AS rn
                              FROM (SELECT DISTINCT month, day FROM daily)) WHERE rn <= 5)""", DAILY),
)
def sample_days_per_month(spark, d):
    t = daily(spark, d).select("id", "month", "day")
    return wn.sample_groups(t, "month", "day", size=5, seed=2019, spread_by=["id"])


@query(
    "first_groups",
    with_views(
        """SELECT event_id, r.day, r.location, r.position FROM readings r
           JOIN (SELECT DISTINCT day, location, position FROM readings ORDER BY day, location, position LIMIT 10) g
           USING (day, location, position)""", READINGS),
)
def first_groups(spark, d):
    r = readings(spark, d).select("event_id", "day", "location", "position")
    return wn.first_groups(r, ["day", "location", "position"], 10)


@query(
    "attach_group_count",
    with_views("SELECT event_id, location, day, count(*) OVER (PARTITION BY location, day) AS chk FROM readings", READINGS),
)
def attach_group_count(spark, d):
    return cl.attach_count(readings(spark, d).select("event_id", "location", "day"), ["location", "day"], "chk", ["event_id"])


# --- sorts and unions --------------------------------------------------------

# Display order of the sites.
SITE_ORDER = ["3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH", "4-NOT SPECIFIED"]


@query(
    "sort_levels",
    with_views(
        f"""SELECT location, month, {snap_sql('avg(value)')} AS mean FROM daily GROUP BY ALL""", DAILY),
)
def sort_levels(spark, d):
    means = daily(spark, d).groupBy("location", "month").agg(snap(F.avg("value")).alias("mean"))
    return od.sort_levels(means, "location", SITE_ORDER, "month")


@query("head_rows", with_views("SELECT id, location, raw FROM daily ORDER BY raw DESC, id LIMIT 10", DAILY))
def head_rows(spark, d):
    return od.head(daily(spark, d).select("id", "location", "raw"), [F.desc("raw"), F.asc("id")], 10)


@query(
    "neighbour_pairs",
    with_views(
        f"""SELECT CAST(rn AS INTEGER) AS pair, location AS upper, nxt AS lower, {snap_sql('e - en')} AS difference FROM (
              SELECT location, e, row_number() OVER o AS rn, lead(location) OVER o AS nxt, lead(e) OVER o AS en
              FROM (SELECT location, avg(value) AS e FROM daily GROUP BY location) WINDOW o AS (ORDER BY e DESC, location))
            WHERE nxt IS NOT NULL""", DAILY),
)
def neighbour_pairs(spark, d):
    means = daily(spark, d).groupBy("location").agg(F.avg("value").alias("e"))
    return wn.neighbour_pairs(means, "location", "e").withColumn("difference", snap("difference"))


@query(
    "union_by_name",
    with_views(
        """SELECT id, location, position, month FROM daily WHERE key = 'NEP'
           UNION ALL SELECT id, location, NULL, month FROM daily WHERE key IS DISTINCT FROM 'NEP'""", DAILY),
)
def union_by_name(spark, d):
    t = daily(spark, d)
    first = t.filter("key = 'NEP'").select("id", "location", "position", "month")
    return od.union_by_name([first, t.filter("NOT key <=> 'NEP'").select("month", "location", "id")])


@query(
    "union_tagged",
    with_views(
        f"""SELECT location, {snap_sql('avg(value)')} AS mean, 'value' AS variable FROM daily GROUP BY location
            UNION ALL SELECT location, {snap_sql('avg(raw)', 2)}, 'raw' FROM daily GROUP BY location""", DAILY),
)
def union_tagged(spark, d):
    t = daily(spark, d)
    return od.union_tagged({
        "value": t.groupBy("location").agg(snap(F.avg("value")).alias("mean")),
        "raw": t.groupBy("location").agg(snap(F.avg("raw"), 2).alias("mean")),
    })
