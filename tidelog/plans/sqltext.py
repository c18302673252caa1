"""Queries written as SQL text over the functions that functions.insql defines; each equals the DataFrame query."""

from __future__ import annotations

from ..functions import insql
from ..functions.values import snap_sql
from .modelling import HOUR_SPLINE
from .registry import ORACLES, query
from .tables import LINES, lines, readings, with_views


def _view(df, name):
    df.createOrReplaceTempView(name)


@query(
    "sql_light_curves",
    with_views(
        f"""SELECT l_orderkey, l_linenumber, {snap_sql('20 * (1 - exp(-1.5 / 20 * x)) - 3')} AS minus_rd, {snap_sql('20 * (1 - exp(-1.5 / 20 * x)) + 3')} AS plus_rd,
                   {snap_sql('p * (1 - exp(-a / p * x)) + r')} AS fit, {snap_sql('20 * (1 - exp(-1.5 / 20 * x)) * exp(-0.1 / 20 * x) - 3')} AS damped,
                   {snap_sql('-ln(2 * sqrt(2) * 1.25) - 1.5 * ln(1 + pow((y - (20 * (1 - exp(-1.5 / 20 * x)) - 3)) / 1.25, 2) / 2)')} AS log_density
            FROM (SELECT *, CASE WHEN location = 'R' THEN 17.0::DOUBLE ELSE 15.0::DOUBLE END AS p, CASE WHEN location = 'R' THEN 2.5::DOUBLE ELSE 3.0::DOUBLE END AS a,
                         CASE WHEN location = 'R' THEN 2.25::DOUBLE ELSE 2.0::DOUBLE END AS r FROM lines)""", LINES),
)
def sql_light_curves(spark, d):
    insql.register(spark)
    _view(lines(spark, d), "tidelog_lines")
    return spark.sql(f"""
        SELECT l_orderkey, l_linenumber, {snap_sql('light_saturating(x, 20, 1.5, 3)')} AS minus_rd, {snap_sql('light_respired(x, 20, 1.5, 3)')} AS plus_rd,
               {snap_sql("light_two_site(x, if(location = 'R', 2, 1), 15, 3, 2, 2, -0.5, 0.25)")} AS fit, {snap_sql('light_inhibited(x, 20, 1.5, 0.1, 3)')} AS damped,
               {snap_sql('student2_logpdf(y, light_saturating(x, 20, 1.5, 3), 1.25)')} AS log_density
        FROM tidelog_lines""")


@query("sql_oxygen_slope", ORACLES["oxygen_slope"])
def sql_oxygen_slope(spark, d):
    insql.register(spark, HOUR_SPLINE)
    _view(readings(spark, d), "tidelog_readings")
    return spark.sql(f"""
        WITH cells AS (SELECT location, position, day, hour, count(oxygen) AS n, sum(oxygen) AS s1, sum(oxygen * oxygen) AS s2
                       FROM tidelog_readings GROUP BY location, position, day, hour),
             fits AS (SELECT * FROM smooth_fit(TABLE(SELECT * FROM cells), 'hour', 0.0, 24.0, 5, 'cs'))
        SELECT event_id, r.location, r.position, r.day, {snap_sql('hour')} AS hour, {snap_sql('oxygen')} AS oxygen, {snap_sql('smooth_slope(beta, hour)', 3)} AS rate
        FROM tidelog_readings r LEFT JOIN fits f ON r.location <=> f.location AND r.position <=> f.position AND r.day <=> f.day""")
