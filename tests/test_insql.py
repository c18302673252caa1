"""SQL text against the DataFrame functions."""

import numpy as np
import pytest

from tests.conftest import rows
from tidelog.functions import curves as cv
from tidelog.functions import insql
from tidelog.functions.splines import Spline
from tidelog.operators.smoothing import fit_groups, gram, slope_at_rows

SPLINE = Spline.even(0.0, 24.0, 5, "cs")


@pytest.fixture(scope="module")
def readings(spark):
    r = np.random.default_rng(3)
    out = []
    for site, n in (("a", 60), ("b", 40), (None, 30)):
        hour = np.round(r.uniform(0, 24, n), 1)
        out += [(i, site, float(h), float(100 + np.sin(h / 4) + r.normal(0, 0.1))) for i, h in enumerate(hour)]
    out += [(0, "few", 1.0, 2.0), (1, "empty", None, 1.0), (2, "empty", 1.0, None)]
    df = spark.createDataFrame(out, "id int, site string, hour double, value double")
    df.createOrReplaceTempView("insql_readings")
    insql.register(spark)
    return df


CELLS = "SELECT site, hour, count(value) AS n, sum(value) AS s1, sum(value * value) AS s2 FROM insql_readings GROUP BY site, hour"


def test_curves_equal_the_column_functions(spark, readings):
    got = spark.sql("""SELECT id, site, light_saturating(hour, 10, 2, 1) AS a, light_respired(hour, 10, 2, 1) AS b, light_inhibited(hour, 10, 2, 0.1, 1) AS c,
                       light_two_site(hour, id % 2 + 1, 10, 2, 1, 0.5, 0.1, 0.2) AS d, student2_logpdf(value, hour, 2) AS e FROM insql_readings""")
    site = (readings["id"] % 2 + 1)
    want = readings.select("id", "site", cv.saturating("hour", 10, 2, 1).alias("a"), cv.saturating("hour", 10, 2, 1, sign=1).alias("b"),
                           cv.inhibited("hour", 10, 2, 0.1, 1).alias("c"), cv.saturating_two_site("hour", site, 10, 2, 1, 0.5, 0.1, 0.2).alias("d"),
                           cv.student2_logpdf("value", "hour", 2).alias("e"))
    for a, b in zip(rows(got), rows(want), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-12)


def test_table_function_fits_what_the_operator_fits(spark, readings):
    got = {r.site: r for r in spark.sql(f"SELECT * FROM smooth_fit(TABLE({CELLS}), 'hour', 0.0, 24.0, 5, 'cs')").collect()}
    assert set(got) == {"a", "b", None, "few", "empty"} and got["few"].beta is None and got["empty"].beta is None and got["a"].n == 60
    slopes = spark.sql(f"""SELECT r.id, r.site, smooth_slope(beta, hour) AS rate FROM insql_readings r
        LEFT JOIN smooth_fit(TABLE({CELLS}), 'hour', 0.0, 24.0, 5, 'cs') f ON r.site <=> f.site WHERE hour IS NOT NULL AND value IS NOT NULL""")
    want = slope_at_rows(readings.filter("hour IS NOT NULL AND value IS NOT NULL"), ["site"], "hour", "value", SPLINE, ["id"]).select("id", "site", "rate")
    for a, b in zip(rows(slopes), rows(want), strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or a[2] == pytest.approx(b[2], abs=1e-5))
    edf = {r.site: r.edf for r in fit_groups(gram(readings.filter("site = 'a'"), ["site"], SPLINE, "hour", "value"), ["site"], SPLINE).collect()}
    assert got["a"].edf == pytest.approx(edf["a"], abs=0.3)  # without the mean taken off first


def test_one_table_without_keys_and_wrong_columns(spark, readings):
    whole = CELLS.replace("SELECT site, hour", "SELECT hour").replace("GROUP BY site, hour", "GROUP BY hour")
    got = spark.sql(f"SELECT * FROM smooth_fit(TABLE({whole}), 'hour', 0.0, 24.0, 5, 'cs')").collect()
    assert len(got) == 1 and got[0].asDict().keys() == {"beta", "edf", "n"} and got[0].n == 131
    with pytest.raises(Exception, match="no column at"):
        spark.sql(f"SELECT * FROM smooth_fit(TABLE({CELLS}), 'at', 0.0, 24.0, 5, 'cs')").collect()
