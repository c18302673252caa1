"""Column functions on hand-made rows with the expected values written out."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidelog.functions import curves as cv
from tidelog.functions import distributions as ds
from tidelog.functions import texts as tx
from tidelog.functions import times as tm
from tidelog.functions import values as va

NAN = float("nan")


def one(spark, value, *exprs, kind="double"):
    return tuple(spark.createDataFrame([(value,)], f"x {kind}").select(*exprs).first())


def stamps(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))


def test_strict_and_loose_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", 5.0), ("d", None)], "k string, x double")
    out = df.groupBy("k").agg(
        va.mean_of("x").alias("m"), va.mean_of("x", True).alias("ml"), va.sum_of("x").alias("s"), va.sd_of("x").alias("sd")
    )
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert got["a"] == (None, 1.0, None, None)
    assert got["b"] == (3.0, 3.0, 6.0, pytest.approx(math.sqrt(2)))
    assert got["c"] == (5.0, 5.0, 5.0, None)  # one row: no standard deviation
    assert got["d"] == (None, None, None, None)


def test_standard_error_of_one_value_is_missing(spark):
    df = spark.createDataFrame([(2.0, 5), (2.0, 1)], "sd double, n int")
    assert [r[0] for r in df.select(va.standard_error("sd", "n")).collect()] == [1.0, None]


def test_clamp_near_and_null_rules(spark):
    assert one(spark, -3.0, va.clamp_below("x"), va.null_where("x", F.col("x") < 0)) == (0.0, None)
    assert one(spark, None, va.clamp_below("x"), va.null_where("x", F.col("x") < 0), va.near("x", 0.0)) == (None, None, None)
    assert one(spark, 1e-9, va.near("x", 0.0)) == (True,)
    assert one(spark, 1e-7, va.near("x", 0.0)) == (False,)


def test_log_of_zero_is_minus_infinity(spark):
    assert one(spark, 0.0, va.log_keep_zero("x")) == (float("-inf"),)
    assert one(spark, None, va.log_keep_zero("x")) == (None,)


def test_snap_matches_its_sql(spark):
    import duckdb

    values = [0.0, 1.23456, -1.23456, 1e5 + 1 / 3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(va.snap("x", 4)).collect()]
    want = [duckdb.sql(f"SELECT {va.snap_sql(repr(v) + '::DOUBLE', 4)}").fetchall()[0][0] for v in values]
    assert got == want


def test_round_ten_minutes(spark):
    df = stamps(spark, ["2024-01-01 00:04:59", "2024-01-01 00:05:00", "2024-01-01 00:09:59.5", "2024-01-01 23:55:00", None])
    got = [r[0] for r in df.select(tm.round_minutes("t", 10)).collect()]
    day = dt.datetime(2024, 1, 1)
    assert got == [day, day.replace(minute=10), day.replace(minute=10), dt.datetime(2024, 1, 2), None]
    with pytest.raises(ValueError):
        tm.floor_minutes("t", 7)


@pytest.mark.parametrize("text, want", [
    ("03/04/18 01:02:03 PM", dt.datetime(2018, 3, 4, 13, 2, 3)),
    ("03/04/2018 午後 12:02:03", dt.datetime(2018, 3, 4, 12, 2, 3)),
    ("03/04/2018 午前 12:02", dt.datetime(2018, 3, 4, 0, 2)),
    ("3/4/2018 23:59:59", dt.datetime(2018, 3, 4, 23, 59, 59)),
    ("3-4-18 0:00", dt.datetime(2018, 3, 4)),
    ("13/04/2018 10:00", None),
    ("2018/03/04 10:00", None),
    ("", None),
    (None, None),
])
def test_month_first_texts(spark, text, want):
    assert one(spark, text, tm.parse_month_first("x"), kind="string") == (want,)


def test_other_dates(spark):
    df = stamps(spark, ["2018-12-31 13:30:15"])
    got = df.select(
        tm.floor_month("t"), tm.decimal_hour("t"), tm.shift_days("t", 2), tm.length_days(F.lit("2018-12-01").cast("date"), "t"),
        tm.month_name(F.month("t")), tm.month_suffix(F.month("t")), tm.season_rank(F.month("t")), tm.season_rank(F.lit(7)),
    ).first()
    assert tuple(got) == (dt.date(2018, 12, 1), 13.5, dt.datetime(2019, 1, 2, 13, 30, 15), 30, "Dec", "12月", 5, 0)
    assert one(spark, "x", tm.stamp("x", "x"), kind="string") == (None,)


def test_texts(spark):
    got = one(spark, "log_7_siteA_0m_x.csv", *tx.split_into("x", ["", "id", "location", "position", "", "type", "more"]), kind="string")
    assert got == ("7", "siteA", "0m", "csv", None)
    assert one(spark, "yhat[3,17]", *tx.drawn_index("x"), kind="string") == (3, 17)
    assert one(spark, "lp__", *tx.drawn_index("x"), tx.extract("x", "[0-9]+"), kind="string") == (None, None, None)
    kept, strict = tx.value_map("x", {"a": "A"}), tx.value_map("x", {"a": "A"}, keep_unmatched=False)
    assert one(spark, "z", kept, strict, kind="string") == ("z", None)
    assert one(spark, None, kept, strict, kind="string") == (None, None)


def test_curves(spark):
    got = one(spark, 10.0, cv.saturating("x", 10.0, 0.5, 1.0), cv.saturating("x", 10.0, 0.5, 1.0, sign=1), cv.inhibited("x", 10.0, 0.5, 0.2, 1.0))
    rise = 10 * (1 - math.exp(-0.5))
    assert got == pytest.approx((rise - 1, rise + 1, rise * math.exp(-0.2) - 1))
    two = [cv.saturating_two_site("x", F.lit(s), 10.0, 0.5, 1.0, 2.0, 0.1, 0.5) for s in (1, 2)]
    assert one(spark, 10.0, *two) == pytest.approx((rise + 1, 12 * (1 - math.exp(-0.6 / 12 * 10)) + 1.5))


def test_probabilities(spark):
    for z in (0.0, 0.3, 1.96, -4.0, 8.0, 30.0, 60.0):
        assert one(spark, z, cv.normal_p_two_sided("x"))[0] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-11)
    # Density and quantile of t(2) against the closed-form distribution function.
    u = one(spark, 0.2, cv.student2_quantile("x"))[0]
    assert 0.5 + u / (2 * math.sqrt(2 + u * u)) == pytest.approx(0.2)
    want = math.lgamma(1.5) - math.log(1.5 * math.sqrt(2 * math.pi)) - 1.5 * math.log(1 + ((2 - 1) / 1.5) ** 2 / 2)
    assert one(spark, 2.0, cv.student2_logpdf("x", 1.0, 1.5))[0] == pytest.approx(want)
    assert ds.beta_regularised(0.3, 2, 3) == pytest.approx(0.3483)
    assert ds.t_two_sided(2.0, 10) == pytest.approx(0.07338803, rel=1e-6)
    assert ds.f_upper_tail(3.0, 1, 1e9) == pytest.approx(math.erfc(math.sqrt(1.5)), rel=1e-5)
    assert ds.f_upper_tail(2.5, 4, 20) == pytest.approx(0.0750, abs=2e-4)


def test_hash_uniform_is_repeatable_and_spread(spark):
    df = spark.range(4000).select(cv.hash_uniform(F.lit(1), "id").alias("u"))
    a, b = df.agg(F.avg("u"), F.stddev("u"), F.min("u"), F.max("u")).first(), df.agg(F.avg("u")).first()
    assert a[0] == b[0] and abs(a[0] - 0.5) < 0.02 and abs(a[1] - 0.2887) < 0.01 and 0 < a[2] < a[3] < 1


def test_rows_helper_sorts(spark):
    assert rows(spark.createDataFrame([(2,), (None,), (1,)], "x int")) == [(None,), (1,), (2,)]
