"""Operators on small frames: missing keys, both interval ends, ties, duplicates, one-row groups."""

import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from tidelog.operators import aggregates as ag
from tidelog.operators import cleaning as cl
from tidelog.operators import joins as jn
from tidelog.operators import ordering as od
from tidelog.operators import production as pr
from tidelog.operators import ranking as rk
from tidelog.operators import windows as wn

T = dt.datetime


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


# --- joins -------------------------------------------------------------------


def test_missing_keys_meet(spark):
    a = frame(spark, [("p", 1), (None, 2), ("q", 3)], "k string, a int")
    b = frame(spark, [("p", 10), (None, 20), ("r", 30)], "k string, b int")
    assert rows(jn.full_on_keys(a, b, ["k"]), "k", "a", "b") == [(None, 2, 20), ("p", 1, 10), ("q", 3, None), ("r", None, 30)]
    assert rows(jn.inner_on_keys(a, b.withColumnRenamed("b", "a"), ["k"])) == [(None, 2, 20), ("p", 1, 10)]
    assert jn.inner_on_keys(a, b.withColumnRenamed("b", "a"), ["k"]).columns == ["k", "a_x", "a_y"]
    assert rows(jn.full_chain([a, b, a.withColumnRenamed("a", "c")], ["k"]), "k", "a", "b", "c")[-1] == ("r", None, 30, None)


def test_intervals_closed_overlapping_and_reversed(spark):
    r = frame(spark, [("s", T(2024, 1, 1)), ("s", T(2024, 1, 3)), ("s", T(2024, 1, 3, 0, 0, 1)), ("s", T(2024, 1, 2)),
                      ("u", T(2024, 1, 2)), (None, T(2024, 1, 2)), ("s", None)], "location string, datetime timestamp_ntz")
    i = frame(spark, [("s", T(2024, 1, 1), T(2024, 1, 3)), ("s", T(2024, 1, 2), T(2024, 1, 3)), ("u", T(2024, 1, 5), T(2024, 1, 1)),
                      ("w", T(2024, 1, 1), T(2024, 1, 9))], "location string, start_date timestamp_ntz, end_date timestamp_ntz")
    got = rows(jn.within_intervals(r, i))
    assert got == [("s", T(2024, 1, 1)), ("s", T(2024, 1, 2)), ("s", T(2024, 1, 3))]


def test_intervals_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = T(2024, 1, 1)
    at = lambda hours: base + dt.timedelta(hours=int(hours))
    intervals = [(f"s{rng.integers(3)}", at(a), at(a + rng.integers(-5, 120))) for a in rng.integers(0, 600, 25)]
    readings = [(i, f"s{rng.integers(4)}", at(h)) for i, h in enumerate(rng.integers(0, 720, 800))]
    got = jn.within_intervals(
        frame(spark, readings, "i int, location string, datetime timestamp_ntz"),
        frame(spark, intervals, "location string, start_date timestamp_ntz, end_date timestamp_ntz"))
    want = sorted(i for i, s, t in readings if any(s == p and a <= t <= b for p, a, b in intervals))
    assert 100 < len(want) < 800 and sorted(r["i"] for r in got.collect()) == want


def test_hand_back_with_a_hot_group(spark):
    # One group holds most rows, another is missing its key: every row keeps its own result once.
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    sums = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
    for known in (None, sums.count()):
        got = jn.hand_back(df, sums, ["k"], "n", ["id"], known)
        assert got.columns == ["id", "k", "total"]
        assert got.count() == 5000 and got.select("id").distinct().count() == 5000
        check = {r["k"]: r["t"] for r in got.groupBy("k").agg(F.max("total").alias("t"), F.min("total").alias("u")).filter("t = u").collect()}
        assert check == {r["k"]: r["total"] for r in sums.collect()}


def test_hand_back_spreads_the_hot_group(spark):
    df = spark.range(64_000).select("id", F.lit("hot").alias("k"))
    counted = cl.attach_count(df, ["k"], "n", ["id"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["c"] for r in counted.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()]
        spread = counted.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 64_000 and len(spread) == 8 and max(r["count"] for r in spread) < 20_000


def test_a_large_factor_table_is_neither_repeated_nor_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jn, "BROADCAST_ROWS", 5)
    df = frame(spark, [(i % 12 if i % 12 else None, float(i)) for i in range(48)], "logger int, x double")
    factors = frame(spark, [(i, i / 2.0) for i in range(10)] + [(3, 7.0)], "logger int, f double")
    out = jn.apply_factor(df, factors, "logger", "x", "f", "y")
    plan = out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan
    both = {i: [i / 2.0] for i in range(10)} | {3: [1.5, 7.0]}
    want = [(k, float(i), None if f is None else i * f) for i in range(48) for k in [i % 12 or None] for f in both.get(k, [None])]
    assert rows(out) == sorted(want, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_alias_label_factor_grid(spark):
    df = frame(spark, [("a", 1.0), ("b", 2.0), (None, 3.0)], "site string, x double")
    assert rows(jn.alias_sites(df, "site", {"a": ["a2", "a3"]})) == [(None, 3.0), ("a", 1.0), ("a2", 1.0), ("a3", 1.0), ("b", 2.0)]
    sites = jn.dimension(spark, [("a", 1, "A"), ("z", 2, "Z")], ["code", "idx", "label"])
    assert rows(jn.label_sites(df, sites, "site")) == [(None, 3.0, None, None), ("a", 1.0, 1, "A"), ("b", 2.0, None, None)]
    factors = jn.dimension(spark, [("a", 0.5)], ["site", "f"])
    assert rows(jn.apply_factor(df, factors, "site", "x", "f", "y")) == [(None, 3.0, None), ("a", 1.0, 0.5), ("b", 2.0, None)]
    grid = [r["m"] for r in jn.grid_by_level(df.filter("site = 'a'"), "site", "m", 1, 12, 12).orderBy("m").collect()]
    assert grid == pytest.approx(list(range(1, 13)))
    half_open = [r["m"] for r in jn.linear_grid(df.filter("site = 'a'"), "m", 0, 10, 5, closed=False).orderBy("m").collect()]
    assert half_open == pytest.approx([0, 2, 4, 6, 8])


# --- cleaning ----------------------------------------------------------------


def test_select_by_name_wants_exactly_one(spark):
    df = frame(spark, [(1, 2)], "`Velo[cm/s]` int, `Vel X[cm/s]` int")
    assert cl.select_by_name(df, {"v": "Velo["}).columns == ["v"]
    with pytest.raises(ValueError):
        cl.select_by_name(df, {"v": "Vel"})
    assert cl.select_by_name(df, {"x": "X["}, how="contains").first()[0] == 2
    assert cl.select_range(frame(spark, [(1, 2, 3)], "a int, b int, c int"), "b", "c").columns == ["b", "c"]


def test_filters(spark):
    df = frame(spark, [("0m", 1.0), ("1m", 5.0), ("mid", 5.5), (None, None)], "p string, x double")
    assert rows(cl.in_range(df, "x", 1, 5)) == [("0m", 1.0), ("1m", 5.0)]
    assert rows(cl.matching(df, "p", "[(0m)(1m)]"), "p") == [("0m",), ("1m",), ("mid",)]  # a character class
    assert rows(cl.matching(df, "p", "m$", keep=False), "p") == [("mid",)]
    pairs = frame(spark, [("1m", 5.0), (None, None)], "p string, x double")
    assert rows(cl.exclude_pairs(df, pairs, ["p", "x"]), "p") == [("0m",), ("mid",)]


def test_day_night_and_half_day(spark):
    df = frame(spark, [(0.5, 11.99), (1.0, 12.0), (None, None)], "l double, h double")
    assert rows(cl.half_day(cl.day_night(df, "l"), "h")) == [(None, None, None, None), (0.0, 11.99, False, "AM"), (1.0, 12.0, True, "PM")]


def test_completeness_and_duplicates(spark):
    df = frame(spark, [("a", 1, 1.0), ("a", 2, None), ("b", 1, 1.0), (None, 1, 1.0), (None, 2, 2.0)], "k string, i int, x double")
    assert rows(cl.complete_groups(df, ["k"], 2, ["i"]), "k", "i") == [(None, 1), (None, 2), ("a", 1), ("a", 2)]
    assert rows(cl.incomplete_groups(df, ["k"], 2)) == [("b", 1)]
    assert cl.distinct_rows(df.union(df)).count() == 5
    assert rows(cl.drop_missing(frame(spark, [(1.0,), (None,), (float("nan"),)], "x double"))) == [(1.0,)]


# --- aggregates --------------------------------------------------------------


def test_dose_counts_negative_as_dark(spark):
    df = frame(spark, [("s", -5.0), ("s", 10.0), ("s", 20.0), ("n", None), ("n", 1.0)], "k string, x double")
    assert dict(ag.daily_dose(df, ["k"], "x").collect()) == {"s": pytest.approx(30 * 600 / 1e6), "n": None}
    assert dict(ag.daily_dose(df, ["k"], "x", 60, na_rm=True).collect())["n"] == pytest.approx(60 / 1e6)


def test_bands(spark):
    df = frame(spark, [("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0)], "k string, x double")
    got = {r["k"]: r for r in ag.band(df, ["k"], "x").collect()}
    assert got["a"]["n"] == 2 and got["a"]["mean"] == 2.0 and got["a"]["u95"] == pytest.approx(2 + 2**0.5)
    assert got["b"]["sd"] is None and got["b"]["l95"] is None
    assert {r["k"]: r["mean"] for r in ag.band(df, ["k"], "x", na_rm=False).collect()} == {"a": None, "b": 2.0}
    geo = {r["k"]: r["gmean"] for r in ag.geometric_band(df, ["k"], "x").collect()}
    assert geo["a"] == pytest.approx(3**0.5)
    assert {r["k"]: r["min"] for r in ag.multi_stats(df, ["k"], "x", na_rm=False).collect()} == {"a": None, "b": 2.0}


def test_two_level_mean_weighs_days_equally(spark):
    df = frame(spark, [("m", 1, 1.0), ("m", 1, 1.0), ("m", 1, 1.0), ("m", 2, 5.0)], "m string, d int, x double")
    assert ag.two_level_mean(df, ["m", "d"], ["m"], "x").first()["mean"] == 3.0
    assert ag.total_then_mean(df, ["m", "d"], ["m"], "x").first()["mean_total"] == 4.0


def test_spread_and_gather(spark):
    df = frame(spark, [("a", "0m", 1.0), ("a", "1m", 2.0), ("b", "0m", 3.0)], "k string, p string, x double")
    wide = ag.sum_of_levels(df, ["k"], "p", ["0m", "1m"], "x", "both")
    assert rows(wide) == [("a", 1.0, 2.0, 3.0), ("b", 3.0, None, None)]
    back = ag.gather(wide.drop("both"), ["k"], ["0m", "1m"], "p", "x").filter("x is not null")
    assert rows(back) == rows(df)
    with pytest.raises(PySparkException, match="duplicate p=0m"):
        ag.spread(df.union(df.limit(1)), ["k"], "p", ["0m", "1m"], "x").collect()


def test_nest_keeps_rows_and_bounds_arrays(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "big").otherwise("small").alias("k"), "id")
    nested = ag.nest_chunks(df, ["k"], ["id"], chunk_rows=100)
    assert nested.select(F.max(F.size("data"))).first()[0] < 250
    assert rows(ag.unnest(nested, ["k"])) == rows(df)
    one = ag.fold_chunks(nested, ["k"], {"c": F.size("data")}, {"n": F.sum("c")})
    assert rows(one) == [("big", 900), ("small", 100)]


# --- ranking -----------------------------------------------------------------


@pytest.fixture(scope="module")
def ranked_rows(spark):
    rng = np.random.default_rng(5)
    data = [("hot", float(v)) for v in np.round(rng.lognormal(3, 2, 900), 1)]
    data += [("hot", 7.0)] * 400 + [("one", 3.0)] + [("two", 1.0), ("two", 2.0)] + [(None, 5.0), (None, 9.0), ("hot", None)]
    return data, frame(spark, data, "k string, x double")


def test_ranks(spark, ranked_rows):
    data, df = ranked_rows
    got = {}
    for r in rk.rank_values(df, ["k"], ["x"]).rows.collect():
        got.setdefault(r["k"], []).append((r["x"], r["lo"], r["hi"], r["dense"], r["n"]))
    for key in ("hot", "one", "two", None):
        values = sorted(v for k, v in data if k == key and v is not None)
        want, seen = [], 0
        for i, v in enumerate(sorted(set(values)), 1):
            want.append((v, seen + 1, seen + values.count(v), i, len(values)))
            seen += values.count(v)
        assert sorted(got[key]) == want


def test_quantiles_and_boxes(spark, ranked_rows):
    data, df = ranked_rows
    boxes = {r["k"]: r for r in rk.box_stats(df, ["k"], "x").collect()}
    for key in ("hot", "one", "two"):
        v = np.array([x for k, x in data if k == key and x is not None])
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = (v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))
        b = boxes[key]
        assert (b["q1"], b["median"], b["q3"]) == pytest.approx((q1, q2, q3))
        assert (b["whisker_low"], b["whisker_high"]) == pytest.approx((v[inside].min(), v[inside].max()))
        assert (b["n_outliers"], b["n"]) == ((~inside).sum(), len(v))


def test_shortest_interval(spark, ranked_rows):
    data, df = ranked_rows
    got = {r["k"]: (r["hdi_low"], r["hdi_high"]) for r in rk.shortest_interval(df, ["k"], "x", 0.8).collect()}
    assert "one" not in got
    for key in ("hot", "two", None):
        v = np.sort([x for k, x in data if k == key and x is not None])
        gap = max(1, min(len(v) - 1, round(len(v) * 0.8)))
        i = int(np.argmin(v[gap:] - v[: len(v) - gap]))
        assert got[key] == pytest.approx((v[i], v[i + gap]))


def test_dense_index(spark):
    df = frame(spark, [(1, 5), (2, 2), (3, 5), (4, None), (5, 9)], "id int, m int")
    assert rows(rk.dense_index(df, "m", "i", ["id"]), "id", "i") == [(1, 2), (2, 1), (3, 2), (4, None), (5, 3)]


# --- windows, ordering -------------------------------------------------------


def test_group_minimum(spark):
    df = frame(spark, [(1, "a", 5.0), (2, "a", 3.0), (3, None, 4.0), (4, "b", None)], "id int, k string, x double")
    assert rows(wn.subtract_group_min(df, ["k"], "x", ["id"]), "id", "x") == [(1, 2.0), (2, 0.0), (3, 0.0), (4, None)]


def test_year_labels(spark):
    df = frame(spark, [("2018-12-01",), ("2018-12-01",), ("2019-01-05",), ("2019-02-01",)], "d string")
    got = dict((str(r[0]), r[1]) for r in wn.first_in_year_labels(df, "d").collect())
    assert got == {"2018-12-01": "12月\n2018年", "2019-01-05": "01月\n2019年", "2019-02-01": "02月"}


def test_samples_are_whole_groups(spark):
    df = spark.range(2000).select("id", (F.col("id") % 4).alias("m"), (F.col("id") % 40).alias("d"))
    got = wn.sample_groups(df, "m", "d", 3, 7, ["id"])
    assert got.groupBy("m").agg(F.count_distinct("d").alias("n")).filter("n <> 3").count() == 0
    assert got.count() == 4 * 3 * 50
    assert rows(got, "id") == rows(wn.sample_groups(df.repartition(5), "m", "d", 3, 7, ["id"]), "id")
    assert wn.first_groups(df, ["m", "d"], 2).count() == 100


def test_orderings(spark):
    df = frame(spark, [("b", 1.0), ("a", 3.0), ("c", 2.0), ("z", 2.0)], "s string, e double")
    assert [r["s"] for r in od.sort_levels(df, "s", ["c", "b", "a"]).collect()] == ["z", "c", "b", "a"]
    assert [r["s"] for r in od.head(df, [F.desc("e"), F.asc("s")], 2).collect()] == ["a", "c"]
    assert rows(od.relevel(df, "s", ["z", "x", "a"], "i"), "s", "i") == [("a", 2), ("z", 1)]
    pairs = [(r["upper"], r["lower"], r["difference"]) for r in wn.neighbour_pairs(df, "s", "e").orderBy("pair").collect()]
    assert pairs == [("a", "c", 1.0), ("c", "z", 0.0), ("z", "b", 1.0)]
    both = od.union_tagged({"p": df, "q": df.select("s")}, "t")
    assert both.count() == 8 and both.filter("t = 'q' and e is null").count() == 4


# --- production --------------------------------------------------------------


def test_balance(spark):
    # Day: 2 readings, night: 3 readings of 10 minutes each.
    data = [("a", True, 6.0), ("a", True, 12.0)] + [("a", False, -3.0)] * 3 + [("b", True, 6.0)]
    data += [("c", True, 1.0), ("c", False, 4.0)] + [("d", True, -600.0), ("d", False, -1.0)]
    df = frame(spark, data, "k string, light_group boolean, rate double")
    integrated = pr.integrate(df, ["k"])
    sums = {(r["k"], r["light_group"]): (r["rate_sum"], r["hours"]) for r in integrated.collect()}
    assert sums[("a", True)] == pytest.approx((3.0, 2 / 6))
    assert sums[("a", False)] == pytest.approx((-72.0, 0.5))  # -3 per hour over 24 hours
    # b has no night, c respires the wrong way, d has no gross production.
    assert rows(pr.balance(integrated, ["k"])) == [("a", 72.0, 3.0, 75.0)]
    whole = pr.balance(integrated, ["k"], nep_scope="24h").first()
    assert (whole["NEP"], whole["GEP"]) == pytest.approx((1.5, 73.5))
    raw = pr.integrate(df, ["k"], per_hour=False).filter("k = 'a' and light_group").first()
    assert raw["rate_sum"] == pytest.approx(18.0)


def test_ranks_do_not_depend_on_the_blocks(spark, monkeypatch):
    from tidelog.operators import ranking as rk

    df = spark.createDataFrame([("a" if i % 3 else "b", float((i * 37) % 50), i) for i in range(300)], "k string, v double, i int")
    found = []
    for size in (rk.BLOCK_ROWS, 7):
        monkeypatch.setattr(rk, "BLOCK_ROWS", size)
        found.append([rows(rk.box_stats(df, ["k"], "v")), rows(rk.shortest_interval(df, ["k"], "v")), rows(rk.dense_index(df, "v", "at", ["i"]))])
    assert found[0] == found[1]


def test_open_and_far_deployments(spark):
    r = spark.createDataFrame([("s", f"2024-01-0{d} 12:00:00", d) for d in range(1, 9)], "location string, t string, id int").selectExpr("location", "timestamp(t) datetime", "id")
    i = spark.createDataFrame([("s", "2024-01-06 00:00:00", None), ("s", None, "2024-01-01 23:00:00"), ("s", "2024-01-03 00:00:00", "2024-01-03 23:00:00"), ("s", "2024-01-08 00:00:00", "9999-01-01 00:00:00")],
                              "location string, a string, b string").selectExpr("location", "timestamp(a) start_date", "timestamp(b) end_date")
    assert [x["id"] for x in jn.within_intervals(r, i).orderBy("id").collect()] == [1, 3, 6, 7, 8]


def test_hand_back_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(jn, "PIECE_ROWS", 10)
    df = spark.createDataFrame([(None if i % 4 == 0 else "big" if i % 4 < 3 else f"k{i}", i) for i in range(200)], "k string, id int")
    sums = df.groupBy("k").agg(F.sum("id").alias("total"), F.count("*").alias("n"))
    got = {r["id"]: r["total"] for r in jn.hand_back(df, sums, ["k"], "n", ["id"]).collect()}
    want = {r["k"]: r["total"] for r in sums.collect()}
    assert got == {r["id"]: want[r["k"]] for r in df.collect()}
