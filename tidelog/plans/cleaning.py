"""Queries: projections, filters, flags, scalar date / text / math functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves as cv
from ..functions import texts as tx
from ..functions import times as tm
from ..functions import values as va
from ..functions.values import snap, snap_sql
from ..operators import cleaning as cl
from ..operators.joins import full_on_keys, linear_grid
from ..operators.ordering import relevel as rebuild_levels
from ..operators.ordering import union_tagged
from .registry import query
from .tables import (
    DAILY, EXCLUDED_SQL, LINES, READINGS, daily, excluded, lines, readings, table, with_views,
)

# --- projections and filters -------------------------------------------------


@query(
    "select_by_prefix",
    "SELECT l_extendedprice AS price, l_shipdate AS shipped, l_quantity AS qty FROM lineitem",
)
def select_by_prefix(spark, d):
    return cl.select_by_name(
        table(spark, d, "lineitem"), {"price": "l_ext", "shipped": "l_ship", "qty": "l_quan"}
    )


@query("select_rename", "SELECT o_orderstatus, o_totalprice, o_orderdate AS day_stamp FROM orders")
def select_rename(spark, d):
    picked = cl.select_range(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return picked.drop("o_orderpriority").withColumnRenamed("o_orderdate", "day_stamp")


@query("filter_between", "SELECT event_id, value FROM events WHERE value >= 10.5 AND value <= 60.25")
def filter_between(spark, d):
    return cl.in_range(table(spark, d, "events").select("event_id", "value"), "value", 10.5, 60.25)


@query(
    "filter_regex",
    with_views(
        """SELECT event_id, location, position FROM readings
           WHERE regexp_matches(location, 'view|cli') AND NOT regexp_matches(position, '1m')""", READINGS),
)
def filter_regex(spark, d):
    df = readings(spark, d).select("event_id", "location", "position")
    return cl.matching(cl.matching(df, "location", "view|cli"), "position", "1m", keep=False)


@query("filter_key", with_views("SELECT id, key, day FROM daily WHERE key = 'GEP'", DAILY))
def filter_key(spark, d):
    return daily(spark, d).filter(F.col("key") == "GEP").select("id", "key", "day")


@query("filter_near", with_views("SELECT event_id, ppfd FROM readings WHERE abs(floor(ppfd) - 12) < 1.4901161193847656e-8", READINGS))
def filter_near(spark, d):
    return readings(spark, d).filter(va.near(F.floor("ppfd"), 12.0)).select("event_id", "ppfd")


@query(
    "exclude_pairs",
    with_views(
        """SELECT r.event_id, r.location, r.day FROM readings r
           WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE e.day = r.day AND e.location = r.location)""",
        READINGS, EXCLUDED_SQL),
)
def exclude_pairs(spark, d):
    df = readings(spark, d).select("event_id", "location", "day")
    return cl.exclude_pairs(df, excluded(spark), ["day", "location"])


@query("clamp_below", with_views("SELECT event_id, CASE WHEN rate < 0 THEN 0 ELSE rate END AS rate FROM readings", READINGS))
def clamp_below(spark, d):
    return readings(spark, d).select("event_id", va.clamp_below("rate").alias("rate"))


@query(
    "null_out_of_range",
    with_views("SELECT event_id, CASE WHEN ppfd > 150 THEN NULL ELSE ppfd END AS ppfd FROM readings", READINGS),
)
def null_out_of_range(spark, d):
    return readings(spark, d).select("event_id", va.null_where("ppfd", F.col("ppfd") > 150).alias("ppfd"))


@query("null_default", with_views("SELECT event_id, coalesce(gappy, 0) AS sol FROM readings", READINGS))
def null_default(spark, d):
    return readings(spark, d).select("event_id", F.coalesce("gappy", F.lit(0.0)).alias("sol"))


@query("drop_incomplete", with_views("SELECT event_id, location, gappy FROM readings WHERE gappy IS NOT NULL", READINGS))
def drop_incomplete(spark, d):
    return cl.drop_missing(readings(spark, d).select("event_id", "location", "gappy"))


@query(
    "filter_date_threshold",
    with_views("SELECT id, day, month FROM daily WHERE day > DATE '1998-01-01' AND raw > 200000.5 AND month > 5", DAILY),
)
def filter_date_threshold(spark, d):
    cond = (F.col("day") > F.lit("1998-01-01").cast("date")) & (F.col("raw") > 200000.5) & (F.col("month") > 5)
    return daily(spark, d).filter(cond).select("id", "day", "month")


@query(
    "day_night_flag",
    with_views(
        """SELECT event_id, CASE WHEN ppfd < 20 THEN 0 ELSE ppfd END AS ppfd,
                  NOT (abs(CASE WHEN ppfd < 20 THEN 0 ELSE ppfd END) < 1.4901161193847656e-8) AS light_group
           FROM readings""", READINGS),
)
def day_night_flag(spark, d):
    return cl.day_night(readings(spark, d).select("event_id", "ppfd"), "ppfd", dark_below=20.0)


@query(
    "am_pm_flag",
    with_views("SELECT event_id, CASE WHEN hour < 12 THEN 'AM' ELSE 'PM' END AS half FROM readings", READINGS),
)
def am_pm_flag(spark, d):
    return cl.half_day(readings(spark, d).select("event_id", "hour"), "hour").drop("hour")


@query(
    "drop_failed_groups",
    with_views(
        f"""SELECT a.logger, a.day, {snap_sql('a.r + b.r')} AS both_rates
           FROM (SELECT logger, day, sum(rate) r FROM readings WHERE hour < 12 GROUP BY ALL) a
           JOIN (SELECT logger, day, sum(rate) r FROM readings WHERE hour >= 12 GROUP BY ALL) b
           USING (logger, day)""", READINGS),
)
def drop_failed_groups(spark, d):
    r = readings(spark, d)
    am = r.filter("hour < 12").groupBy("logger", "day").agg(F.sum("rate").alias("am"))
    pm = r.filter("hour >= 12").groupBy("logger", "day").agg(F.sum("rate").alias("pm"))
    paired = full_on_keys(am, pm, ["logger", "day"]).withColumn("both_rates", F.col("am") + F.col("pm"))
    return paired.filter(F.col("both_rates").isNotNull()).select("logger", "day", snap("both_rates").alias("both_rates"))


# --- dates -------------------------------------------------------------------


@query("parse_date_time_cols", "SELECT event_id, date_trunc('second', ts) AS datetime FROM events")
def parse_date_time_cols(spark, d):
    text = table(spark, d, "events").select(
        "event_id", F.date_format("ts", "yyyy/MM/dd").alias("date_text"), F.date_format("ts", "HH:mm:ss").alias("time_text")
    )
    return text.select("event_id", tm.stamp("date_text", "time_text").alias("datetime"))


@query("parse_multi_format", "SELECT event_id, date_trunc('second', ts) AS datetime FROM events")
def parse_multi_format(spark, d):
    half = F.when(F.hour("ts") < 12, "午前").otherwise("午後")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "MM/dd/yy hh:mm:ss a"))
        .when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "MM/dd/yyyy "), half, F.date_format("ts", " hh:mm:ss")))
        .otherwise(F.date_format("ts", "M/d/yyyy H:mm:ss"))
    )
    return table(spark, d, "events").select("event_id", tm.parse_month_first(text).alias("datetime"))


@query("round_10min", "SELECT event_id, time_bucket(INTERVAL 10 MINUTE, ts + INTERVAL 5 MINUTE) AS datetime FROM events")
def round_10min(spark, d):
    return table(spark, d, "events").select("event_id", tm.round_minutes("ts", 10).alias("datetime"))


@query(
    "floor_units",
    "SELECT event_id, date_trunc('minute', ts) AS at_minute, CAST(date_trunc('month', ts) AS DATE) AS at_month FROM events",
)
def floor_units(spark, d):
    return table(spark, d, "events").select(
        "event_id", tm.floor_minutes("ts").alias("at_minute"), tm.floor_month("ts").alias("at_month")
    )


@query("date_month", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders")
def date_month(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("day"), F.month("o_orderdate").alias("month")
    )


@query("decimal_hour", f"SELECT event_id, {snap_sql('hour(ts) + minute(ts) / 60.0::DOUBLE')} AS hour FROM events")
def decimal_hour(spark, d):
    return table(spark, d, "events").select("event_id", snap(tm.decimal_hour("ts")).alias("hour"))


@query(
    "shift_days",
    """SELECT o_orderkey, o_orderdate + INTERVAL 2 DAY AS shifted,
              CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days_in FROM orders""",
)
def shift_days(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", tm.shift_days("o_orderdate", 2).alias("shifted"),
        tm.length_days(F.lit("1995-01-01").cast("date"), "o_orderdate").alias("days_in"),
    )


@query(
    "format_stamp",
    "SELECT event_id, strftime(ts, '%d/%m/%Y') AS day_text, strftime(ts, '%H:%M:%S') AS time_text FROM events",
)
def format_stamp(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.date_format("ts", "dd/MM/yyyy").alias("day_text"), F.date_format("ts", "HH:mm:ss").alias("time_text")
    )


@query(
    "month_label",
    """SELECT o_orderkey, strftime(o_orderdate, '%b') AS short_name, month(o_orderdate)::VARCHAR || '月' AS suffixed
       FROM orders""",
)
def month_label(spark, d):
    m = F.month("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", tm.month_name(m).alias("short_name"), tm.month_suffix(m).alias("suffixed")
    )


@query(
    "season_order",
    with_views(
        f"""SELECT month, CAST((month + 5) % 12 AS INTEGER) AS season_rank, count(*) AS n, {snap_sql('avg(value)')} AS mean
           FROM daily GROUP BY month""", DAILY),
)
def season_order(spark, d):
    out = daily(spark, d).groupBy("month").agg(F.count(F.lit(1)).alias("n"), snap(F.avg("value")).alias("mean"))
    out = out.withColumn("season_rank", tm.season_rank("month").cast("int"))
    return out.select("month", "season_rank", "n", "mean").orderBy("season_rank")


# --- text and categories -----------------------------------------------------


@query("template_name", "SELECT p_partkey, p_name || ' (' || p_brand || ')' AS variable, p_type || '-' || p_size::VARCHAR AS tag FROM part")
def template_name(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.format_string("%s (%s)", "p_name", "p_brand").alias("variable"),
        F.concat_ws("-", "p_type", F.col("p_size").cast("string")).alias("tag"),
    )


@query(
    "regex_extract",
    r"""SELECT p_partkey, nullif(regexp_extract(p_brand, '[0-9]+'), '') AS number,
               nullif(regexp_extract(p_name, 'bolt|ring'), '') AS kind FROM part""",
)
def regex_extract(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", tx.extract("p_brand", "[0-9]+").alias("number"), tx.extract("p_name", "bolt|ring").alias("kind")
    )


@query(
    "split_columns",
    "SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, nullif(split_part(p_name, ' ', 2), '') AS second_word FROM part",
)
def split_columns(spark, d):
    return table(spark, d, "part").select("p_partkey", *tx.split_into("p_name", ["first_word", "second_word"], " "))


@query(
    "value_map",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'Outer' WHEN 'click' THEN 'Inner' WHEN 'signup' THEN 'Inner'
              ELSE event_type END AS site,
              CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 END AS strict_idx FROM events""",
)
def value_map(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        tx.value_map("event_type", {"view": "Outer", "click": "Inner", "signup": "Inner"}).alias("site"),
        tx.value_map("event_type", {"view": 1, "click": 2}, keep_unmatched=False).alias("strict_idx"),
    )


# The wanted display order; the last level does not occur in the data.
LEVEL_ORDER = ["4-NOT SPECIFIED", "2-HIGH", "3-MEDIUM", "1-URGENT", "5-LOW", "6-ABSENT"]


@query(
    "relevel",
    with_views(
        """SELECT location, CAST(dense_rank() OVER (ORDER BY o) AS INTEGER) AS level, n FROM (
             SELECT d.location, l.o, count(*) AS n FROM daily d JOIN wanted l ON l.location = d.location GROUP BY ALL)""",
        DAILY,
        "wanted(location, o) AS (VALUES " + ", ".join(f"('{v}', {i})" for i, v in enumerate(LEVEL_ORDER)) + ")"),
)
def relevel(spark, d):
    counts = daily(spark, d).groupBy("location").agg(F.count(F.lit(1)).alias("n"))
    return rebuild_levels(counts, "location", LEVEL_ORDER, "level")


@query(
    "nutrient_summary",
    with_views(
        f"""SELECT location || ' (' || position || ')' AS variable, day, logger % 3 AS nutrient,
                   {snap_sql('avg(CASE WHEN rate < 0 THEN 0 ELSE rate END)')} AS conc,
                   CAST(month(day) AS INTEGER) AS month
            FROM readings WHERE regexp_matches(location || ' (' || position || ')', 'view|1m') GROUP BY ALL""", READINGS),
)
def nutrient_summary(spark, d):
    df = readings(spark, d).select(
        F.format_string("%s (%s)", "location", "position").alias("variable"), "day",
        (F.col("logger") % 3).alias("nutrient"), va.clamp_below("rate").alias("conc"),
    )
    means = cl.matching(df, "variable", "view|1m").groupBy("variable", "day", "nutrient").agg(snap(F.avg("conc")).alias("conc"))
    return means.withColumn("month", F.month("day"))


# --- math --------------------------------------------------------------------


@query(
    "math_functions",
    with_views(
        f"""SELECT event_id, {snap_sql('exp(ppfd / 100)')} AS e, {snap_sql('ln(nullif(ppfd, 0))')} AS l, {snap_sql('sqrt(ppfd)')} AS s,
                  {snap_sql('abs(rate)')} AS a, {snap_sql('pow(ppfd / 10, 1.5)')} AS p,
                  CASE WHEN event_id % 5 = 0 OR ppfd = 0 THEN '-inf'::DOUBLE ELSE {snap_sql('ln(nullif(ppfd, 0))')} END AS log_kept
           FROM readings""", READINGS),
)
def math_functions(spark, d):
    zeroed = F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("ppfd"))
    kept = va.log_keep_zero(zeroed)
    return readings(spark, d).select(
        "event_id", snap(F.exp(F.col("ppfd") / 100)).alias("e"), snap(F.ln("ppfd")).alias("l"),
        snap(F.sqrt("ppfd")).alias("s"), snap(F.abs("rate")).alias("a"),
        snap(F.pow(F.col("ppfd") / 10, F.lit(1.5))).alias("p"),
        F.when(kept == float("-inf"), kept).otherwise(snap(kept)).alias("log_kept"),
    )


@query(
    "flux_merge",
    with_views(
        f"""SELECT event_id, CASE WHEN m < 0 THEN NULL ELSE {snap_sql('m')} END AS ppfd FROM (
             SELECT event_id, 4.6 * coalesce(gappy, 0) + coalesce(rate - 100, 0) AS m FROM readings)""", READINGS),
)
def flux_merge(spark, d):
    merged = 4.6 * F.coalesce("gappy", F.lit(0.0)) + F.coalesce(F.col("rate") - 100, F.lit(0.0))
    df = readings(spark, d).select("event_id", merged.alias("m"))
    return df.select("event_id", snap(va.null_where("m", F.col("m") < 0)).alias("ppfd"))


@query(
    "light_curve_sat",
    with_views(
        f"""SELECT l_orderkey, l_linenumber, {snap_sql('20 * (1 - exp(-1.5 / 20 * x)) - 3')} AS minus_rd,
                  {snap_sql('20 * (1 - exp(-1.5 / 20 * x)) + 3')} AS plus_rd FROM lines""", LINES),
)
def light_curve_sat(spark, d):
    return lines(spark, d).select(
        "l_orderkey", "l_linenumber", snap(cv.saturating("x", 20.0, 1.5, 3.0)).alias("minus_rd"),
        snap(cv.saturating("x", 20.0, 1.5, 3.0, sign=1)).alias("plus_rd"),
    )


@query(
    "light_curve_two_site",
    with_views(
        f"""SELECT l_orderkey, l_linenumber, {snap_sql('p * (1 - exp(-a / p * x)) + r')} AS fit FROM (
             SELECT l_orderkey, l_linenumber, x, CASE WHEN location = 'R' THEN 17.0::DOUBLE ELSE 15.0::DOUBLE END AS p,
                    CASE WHEN location = 'R' THEN 2.5::DOUBLE ELSE 3.0::DOUBLE END AS a,
                    CASE WHEN location = 'R' THEN 2.25::DOUBLE ELSE 2.0::DOUBLE END AS r FROM lines)""", LINES),
)
def light_curve_two_site(spark, d):
    df = lines(spark, d).withColumn("site", F.when(F.col("location") == "R", 2).otherwise(1))
    fit = cv.saturating_two_site("x", "site", 15.0, 3.0, 2.0, 2.0, -0.5, 0.25)
    return df.select("l_orderkey", "l_linenumber", snap(fit).alias("fit"))


@query(
    "light_curve_inhib",
    with_views(
        f"""SELECT l_orderkey, l_linenumber,
                  {snap_sql('20 * (1 - exp(-1.5 / 20 * x)) * exp(-0.1 / 20 * x) - 3')} AS fit FROM lines""", LINES),
)
def light_curve_inhib(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", snap(cv.inhibited("x", 20.0, 1.5, 0.1, 3.0)).alias("fit"))


@query(
    "normal_pvalue",
    # The tail area is integrated by Simpson's rule on 400 intervals.
    with_views(
        f"""SELECT event_id, {snap_sql('''1 - 2 * z / 400 / 3 * 0.3989422804014327 * list_sum(list_transform(range(0, 401),
                lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                   * exp(-(z * i / 400) * (z * i / 400) / 2)))''', 6)} AS p
            FROM (SELECT event_id, abs(rate) / 30 AS z FROM readings)""", READINGS),
)
def normal_pvalue(spark, d):
    return readings(spark, d).select("event_id", snap(cv.normal_p_two_sided(F.col("rate") / 30), 6).alias("p"))


@query(
    "student_logpdf",
    with_views(
        f"""SELECT l_orderkey, l_linenumber, {snap_sql('''-ln(2 * sqrt(2) * 1.25)
             - 1.5 * ln(1 + pow((y - (20 * (1 - exp(-1.5 / 20 * x)) - 3)) / 1.25, 2) / 2)''')} AS log_density
            FROM lines""", LINES),
)
def student_logpdf(spark, d):
    mu = cv.saturating("x", 20.0, 1.5, 3.0)
    return lines(spark, d).select("l_orderkey", "l_linenumber", snap(cv.student2_logpdf("y", mu, 1.25)).alias("log_density"))


@query(
    "linear_grid",
    with_views(
        f"""SELECT kind, location, {snap_sql('i * hi / steps', 6)} AS light
            FROM (SELECT location, max(x) AS hi FROM lines GROUP BY location),
                 (VALUES ('closed', 20), ('open', 21)) k(kind, steps), (SELECT unnest(range(21))::INTEGER AS i)""", LINES),
)
def linear_grid_query(spark, d):
    top = lines(spark, d).groupBy("location").agg(F.max("x").alias("hi"))
    grids = {
        "closed": linear_grid(top, "light", 0.0, F.col("hi"), 21),
        "open": linear_grid(top, "light", 0.0, F.col("hi"), 21, closed=False),
    }
    return union_tagged(grids, "kind").select("kind", "location", snap("light", 6).alias("light"))
