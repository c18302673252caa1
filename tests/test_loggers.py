"""The logger data source: byte ranges, pruned files, odd rows; the sink: nothing is left of a failed job."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidelog.sources import loggers as lg
from tidelog.sources import scans as sc

OPTIONS = {"columns": "n,note,x,gone", "kinds": "ncn_", "keys": ",site,depth", "skip": "2", "encoding": "cp932"}


@pytest.fixture(scope="module")
def source(spark):
    lg.register(spark)
    return lambda folder, **more: spark.read.format("loggers").options(path=str(folder), **{**OPTIONS, **more}).load()


def logger_file(folder, name, body, end="\r\n"):
    (folder / name).write_bytes((end.join(["説明 表", "題", *body]) + end).encode("cp932"))


def test_any_split_gives_every_line_once(tmp_path, source):
    body = [f"{i},測{'定' * (i % 7)},{i / 4},z" for i in range(300)]
    logger_file(tmp_path, "a_north_0m.csv", body)
    want = [("0m", "north", float(i), f"測{'定' * (i % 7)}", i / 4) for i in range(300)]
    for split in (1 << 20, 1000, 97, 40):
        got = source(tmp_path, split=split)
        assert got.columns == ["site", "depth", "n", "note", "x"]
        assert sorted(tuple(r) for r in got.select("depth", "site", "n", "note", "x").collect()) == sorted(want)


def test_odd_rows_and_files(tmp_path, source):
    logger_file(tmp_path, "a_s.csv", ['1,"a, b",x', "", "2", "3,,4.5,more,still"], "\n")
    logger_file(tmp_path, "a_t_1m.csv", [])
    (tmp_path / "a_u_1m.csv").write_bytes(b"")
    (tmp_path / "_hidden_v_1m.csv").write_bytes(b"\xff\xff")
    (tmp_path / "_stage-1").mkdir()
    (tmp_path / "_stage-1" / "a_w_1m.csv").write_bytes(b"1\n2\n3,,3\n")
    assert rows(source(tmp_path)) == [("s", None, 1.0, "a, b", None), ("s", None, 2.0, None, None), ("s", None, 3.0, None, 4.5)]
    (tmp_path / "none").mkdir()
    assert source(tmp_path / "none").count() == 0


def test_a_file_without_line_end(tmp_path, source):
    (tmp_path / "a_s_0m.csv").write_bytes(b"t\nh\n1,a,2\n2,b,3")
    assert rows(source(tmp_path, split=5 * 2), "n", "note") == [(1.0, "a"), (2.0, "b")]


def test_files_out_of_the_filter_are_not_opened(tmp_path, source):
    logger_file(tmp_path, "a_north_0m.csv", ["1,a,2"])
    logger_file(tmp_path, "a_south_0m.csv", ["2,b,3"])
    (tmp_path / "a_broken_0m.csv").write_bytes(b"t\nh\n1,\x81\xff\xff,2\n")  # no text in this encoding
    with pytest.raises(Exception, match="decode"):
        source(tmp_path).collect()
    t = source(tmp_path)
    for wanted, sites in [(F.col("site") == "north", ["north"]), (F.col("site").isin("north", "south") & (F.col("n") > 1), ["south"]),
                          (F.col("site").endswith("th"), ["north", "south"]), (F.col("site").startswith("n") & F.col("depth").contains("0"), ["north"])]:
        assert [r.site for r in t.filter(wanted).orderBy("site").collect()] == sites


def test_a_preamble_over_more_than_a_range_is_refused(tmp_path, source):
    logger_file(tmp_path, "a_s_0m.csv", [f"{i},a,1" for i in range(50)])
    with pytest.raises(Exception, match="preamble does not fit"):
        source(tmp_path, skip=30, split=60).collect()


def routed(df, folder, mode="append"):
    df.write.format("loggers").options(path=str(folder), column="site", pattern="^n", hit="near", miss="far").mode(mode).save()


def test_routes_and_overwriting(spark, tmp_path, source):
    df = spark.createDataFrame([("n1", 1.0), ("x", None), (None, 3.0), ("n,2", 4.0)], "site string, x double").repartition(3)
    routed(df, tmp_path / "out")
    read = lambda region: rows(sc.scan_typed_csv(spark, str(tmp_path / "out" / f"region={region}"), "site STRING, x DOUBLE"))
    assert read("near") == [("n,2", 4.0), ("n1", 1.0)] and read("far") == [(None, 3.0), ("x", None)]
    routed(df.filter("site = 'x'"), tmp_path / "out")
    assert len(read("far")) == 3
    routed(df.filter("site = 'x'"), tmp_path / "out", "overwrite")
    assert read("far") == [("x", None)] and not (tmp_path / "out" / "region=near").exists()
    routed(df.limit(0), tmp_path / "empty")
    assert [p.name for p in (tmp_path / "empty").iterdir()] == ["_SUCCESS"]


def test_a_failed_job_leaves_nothing(spark, tmp_path, source):
    good = spark.createDataFrame([("n1", 1.0), ("x", 2.0)], "site string, x double")
    routed(good, tmp_path / "out")
    before = sorted(str(p) for p in (tmp_path / "out").rglob("*"))
    fails = spark.range(0, 4000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, "n").otherwise("s").alias("site"),
        F.when(F.col("id") == 3999, F.raise_error(F.lit("broken on purpose")).cast("double")).otherwise(F.col("id").cast("double")).alias("x"))
    with pytest.raises(Exception, match="broken on purpose"):
        routed(fails, tmp_path / "out")
    assert sorted(str(p) for p in (tmp_path / "out").rglob("*")) == before
