"""The given tables seen as sensor data, once as DataFrames and once as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import decimal_hour
from ..operators.joins import dimension

PI = "3.141592653589793"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as 10-minute style logger readings."""
    return reading_columns(table(spark, sf_dir, "events"))


def reading_columns(events: DataFrame) -> DataFrame:
    hour = decimal_hour("ts")
    return events.select(
        "event_id",
        F.col("event_type").alias("location"),
        F.when(F.col("user_id") % 2 == 0, "0m").otherwise("1m").alias("position"),
        F.col("ts").alias("datetime"),
        F.to_date("ts").alias("day"),
        hour.alias("hour"),
        F.col("user_id").alias("logger"),
        F.col("value").alias("ppfd"),
        (F.col("value") - 40).alias("rate"),
        (8 + 2 * F.sin(2 * F.lit(float(PI)) * hour / 24) + (F.col("value") - 50) / 100).alias("oxygen"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("gappy"),
    )


READINGS = f"""readings AS (
  SELECT event_id, event_type AS location,
         CASE WHEN user_id % 2 = 0 THEN '0m' ELSE '1m' END AS position,
         ts AS datetime, CAST(ts AS DATE) AS day,
         hour(ts) + minute(ts) / 60.0::DOUBLE AS hour,
         user_id AS logger, value AS ppfd, value - 40 AS rate,
         8 + 2 * sin(2 * {PI} * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24) + (value - 50) / 100 AS oxygen,
         CASE WHEN event_id % 17 <> 0 THEN value END AS gappy
  FROM events)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as daily production values with a seasonal swing."""
    season = 1 + 0.3 * F.cos(F.lit(float(PI)) * (F.month("o_orderdate") - 7) / 6)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("location"),
        F.when(F.col("o_custkey") % 2 == 0, "0m").otherwise("1m").alias("position"),
        F.when(F.col("o_orderstatus") == "F", "NEP").when(F.col("o_orderstatus") == "O", "RP")
        .otherwise("GEP").alias("key"),
        F.to_date("o_orderdate").alias("day"),
        F.month("o_orderdate").alias("month"),
        (F.col("o_totalprice") / 1000 * season).alias("value"),
        F.col("o_totalprice").alias("raw"),
    )


DAILY = f"""daily AS (
  SELECT o_orderkey AS id, o_orderpriority AS location,
         CASE WHEN o_custkey % 2 = 0 THEN '0m' ELSE '1m' END AS position,
         CASE o_orderstatus WHEN 'F' THEN 'NEP' WHEN 'O' THEN 'RP' ELSE 'GEP' END AS key,
         CAST(o_orderdate AS DATE) AS day, CAST(month(o_orderdate) AS INTEGER) AS month,
         o_totalprice / 1000 * (1 + 0.3 * cos({PI} * (month(o_orderdate) - 7) / 6)) AS value,
         o_totalprice AS raw
  FROM orders)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as light-response observations: a saturating signal plus noise, one curve per location."""
    pmax = F.when(F.col("l_returnflag") == "A", 18.0).when(F.col("l_returnflag") == "N", 20.0).otherwise(24.0)
    signal = pmax * (1 - F.exp(-F.col("l_quantity") / 12)) - 2
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.col("l_partkey").alias("logger"),
        F.col("l_returnflag").alias("location"),
        F.col("l_quantity").alias("x"),
        (signal + (F.col("l_extendedprice") / 1000 - 50) / 25).alias("y"),
        F.to_date("l_shipdate").alias("day"),
    )


LINES = """lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS logger, l_returnflag AS location, l_quantity AS x,
         (CASE l_returnflag WHEN 'A' THEN 18.0::DOUBLE WHEN 'N' THEN 20.0::DOUBLE ELSE 24.0::DOUBLE END)
           * (1 - exp(-l_quantity / 12)) - 2 + (l_extendedprice / 1000 - 50) / 25 AS y,
         CAST(l_shipdate AS DATE) AS day
  FROM lineitem)"""

# Three parameters x four chains; the iteration number is dense within each chain.
DRAW_CHAINS = 4


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as posterior draws in long form."""
    e = table(spark, sf_dir, "events")
    wide = e.select(
        (F.col("event_id") % DRAW_CHAINS).cast("int").alias("chain"),
        F.floor(F.col("event_id") / DRAW_CHAINS).cast("bigint").alias("iter"),
        F.col("value").alias("pmax"),
        (F.col("user_id") / 10.0).alias("alpha"),
        (F.length("event_type") + F.col("value") / 100).alias("rd"),
    )
    return wide.unpivot(["chain", "iter"], ["pmax", "alpha", "rd"], "param", "value")


DRAWS = f"""wide_draws AS (
  SELECT CAST(event_id % {DRAW_CHAINS} AS INTEGER) AS chain, event_id // {DRAW_CHAINS} AS iter,
         value AS pmax, user_id / 10.0::DOUBLE AS alpha, length(event_type) + value / 100 AS rd
  FROM events),
draws AS (
  SELECT chain, iter, 'pmax' AS param, pmax AS value FROM wide_draws
  UNION ALL SELECT chain, iter, 'alpha', alpha FROM wide_draws
  UNION ALL SELECT chain, iter, 'rd', rd FROM wide_draws)"""

# Site codes, their order and display labels (one code never occurs, one is left out).
SITES = [
    ("view", 1, "Outer reef"),
    ("click", 2, "Inner bay"),
    ("signup", 3, "Old harbour"),
    ("purchase", 4, "New harbour"),
    ("unused", 5, "Never sampled"),
]
SITES_SQL = "sites(code, idx, label) AS (VALUES " + ", ".join(f"('{c}', {i}, '{t}')" for c, i, t in SITES) + ")"

# Fixed values: (day, site) pairs removed by hand.
EXCLUDED = [
    ("2024-01-03", "view"),
    ("2024-01-03", "click"),
    ("2024-01-11", "error"),
    ("2024-01-20", "signup"),
]
EXCLUDED_SQL = (
    "excluded(day, location) AS (VALUES " + ", ".join(f"(DATE '{d}', '{s}')" for d, s in EXCLUDED) + ")"
)


def sites(spark: SparkSession) -> DataFrame:
    return dimension(spark, SITES, ["code", "idx", "label"]).withColumn("idx", F.col("idx").cast("int"))


def excluded(spark: SparkSession) -> DataFrame:
    return dimension(spark, EXCLUDED, ["day", "location"]).withColumn("day", F.col("day").cast("date"))


# Deployments: four per site, 5 days long every 7 days, first 2 days dropped for settling.
DEPLOY_SQL = """deploy AS (
  SELECT s.location, TIMESTAMP '2024-01-01' + to_days(7 * i + 2) AS start_date,
         TIMESTAMP '2024-01-01' + to_days(7 * i + 5) AS end_date
  FROM (SELECT DISTINCT event_type AS location FROM events) s,
       (SELECT unnest(range(4))::INTEGER AS i))"""


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.times import shift_days

    base = table(spark, sf_dir, "events").select(F.col("event_type").alias("location")).distinct()
    runs = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    first = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(7 * i)")
    return runs.select(
        "location", shift_days(first, 2).alias("start_date"), shift_days(first, 5).alias("end_date")
    )


def with_views(body: str, *views: str) -> str:
    """SQL text with the named views in front."""
    return "WITH " + ",\n".join(views) + "\n" + body if views else body
