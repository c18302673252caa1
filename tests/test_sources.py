"""Logger files written by hand into a scratch folder and read back."""

import datetime as dt
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from tidelog.functions import times as tm
from tidelog.operators import cleaning as cl
from tidelog import session as ss
from tidelog.session import materialize, shared_dir
from tidelog.sources import calibration as cal
from tidelog.sources import scans as sc
from tidelog.sources import sinks as sk
from tidelog.sources.workbook import read_rows, write_rows

HEADER = "No.,YYYY/MM/DD,hh:mm:ss,Velo[cm/s],Vel X[cm/s],ｸﾛﾛ[μg/L],"


def cp932_file(folder, name, lines, skip=36):
    body = [f"説明 {i}, 表" for i in range(skip)] + [HEADER] + lines
    (folder / name).write_bytes(("\r\n".join(body) + "\r\n").encode("cp932"))


def test_cp932_preamble_and_header(spark, tmp_path):
    cp932_file(tmp_path, "a_1_north_0m_x.csv", ["1,2018/01/01,00:00:00,1.5,-2,3,", "2,2018/01/01,00:10:00,x,7,,"])
    cp932_file(tmp_path, "a_2_east_1m 測定.csv", [])
    table = sc.scan_by_header(spark, str(tmp_path), 36, "nccnnn_", "cp932")
    picked = cl.select_by_name(table, {"path": "path", "n": "No.", "d": "YYYY", "t": "hh:", "speed": "Velo[", "chl": "ｸﾛﾛ["})
    keyed = sc.file_name_keys(picked, ["", "id", "location", "position"]).withColumn("ts", tm.stamp("d", "t"))
    got = rows(keyed, "n", "ts", "speed", "chl", "id", "location", "position")
    assert got == [
        (1.0, dt.datetime(2018, 1, 1), 1.5, 3.0, "1", "north", "0m"),
        (2.0, dt.datetime(2018, 1, 1, 0, 10), None, None, "1", "north", "0m"),
    ]


def test_a_file_over_many_splits_keeps_every_line(spark, tmp_path):
    lines = [f"{i},2018/01/01,00:00:00,1,2,3," for i in range(20_000)]
    cp932_file(tmp_path, "big.csv", lines)
    cp932_file(tmp_path, "small.csv", lines[:3])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        table = sc.scan_by_header(spark, str(tmp_path), 36, "nccnnn_", "cp932")
        assert table.rdd.getNumPartitions() > 4
        assert table.count() == 20_003
        assert table.agg(F.sum("`No.`")).first()[0] == sum(range(20_000)) + 3
        with pytest.raises(PySparkException, match="preamble does not fit"):
            sc.logger_lines(spark, str(tmp_path), 19_000, "cp932").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_headers_that_differ(spark, tmp_path):
    (tmp_path / "m_s1.csv").write_text("title\nid,GMT,PAR\n1,01/02/2018 10:00,5\n2,01/02/2018 10:10,\n")
    (tmp_path / "m_s2.csv").write_text("title\nW,GMT,id\n7.5,\"01/02/2018 10:20\",3\n")
    table = sc.scan_by_header(spark, str(tmp_path), 1)
    assert rows(table, "id", "PAR", "W") == [("1", "5", None), ("2", None, None), ("3", None, "7.5")]
    renamed = sc.scan_variants(sc.scan_by_header(spark, str(tmp_path), 1), {"W": "PAR"}, ["id", "PAR"], ["PAR"])
    assert rows(renamed, "id", "PAR") == [("1", 5.0), ("2", None), ("3", 7.5)]


def test_csv_and_workbook_of_one_layout(spark, tmp_path):
    (tmp_path / "a_1_x_0m_z.csv").write_text("t\nh\n1,01/02/2018 10:00:00 PM,5.5,20\n2,bad,,21\n")
    (tmp_path / "a_2_y_1m_z.xlsx").write_bytes(write_rows([["t"], ["h"], [3, "01/02/2018 9:00:00 AM", None, 22.5]]))
    names = ["n", "datetime", "oxygen", "temperature"]
    got = sc.scan_headerless_any(spark, str(tmp_path), "ncnn", names).withColumn("datetime", tm.parse_month_first("datetime"))
    assert rows(got, *names) == [
        (1.0, dt.datetime(2018, 1, 2, 22), 5.5, 20.0), (2.0, None, None, 21.0), (3.0, dt.datetime(2018, 1, 2, 9), None, 22.5),
    ]
    assert sc.list_files(spark, str(tmp_path), r"\.xlsx$").count() == 1
    only = sc.logger_lines(spark, str(tmp_path), 2, glob="*.csv", pattern="_x_0m_")
    assert only.count() == 2


def test_workbook_shapes():
    book = write_rows([["a & <b>", 1.5, None, 3], [], [None, "日本"]])
    assert read_rows(book) == [["a & <b>", "1.5", None, "3"], [], [None, "日本"]]


def test_excel_day_numbers(spark):
    got = spark.createDataFrame([(43101.5,), (None,)], "x double").select(sc.excel_stamp(F.col("x"))).collect()
    assert [r[0] for r in got] == [dt.datetime(2018, 1, 1, 12), None]


def test_routed_sink_and_typed_csv(spark, tmp_path):
    df = spark.createDataFrame([("north", 1.0), ("south", None)], "location string, x double")
    for fmt in ("csv", "parquet"):
        sk.write_routed(df, str(tmp_path / fmt), "location", "north|east", "near", "far", fmt)
    back = sc.scan_typed_csv(spark, str(tmp_path / "csv" / "region=far"), "location STRING, x DOUBLE")
    assert rows(back) == [("south", None)]
    assert rows(spark.read.parquet(str(tmp_path / "parquet")), "location", "region") == [("north", "near"), ("south", "far")]


def test_written_files_are_whole(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("file_name"), (-F.col("id")).alias("row"), F.col("id").cast("string").alias("line"))
    sk.write_files(df, str(tmp_path / "out"), lambda lines: "\n".join(lines).encode())
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert files == ["0", "1", "2"]
    assert (tmp_path / "out" / "1").read_text().split("\n") == [str(i) for i in range(97, 0, -3)]


def test_calibration_table(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,calibration_coefficient\n41,0.5\n42,NA\n")
    assert rows(cal.read_calibration(spark, str(tmp_path / "c.csv"))) == [(41, 0.5), (42, None)]
    assert cal.calibration(spark).count() == 14


def test_materialized_rows_do_not_depend_on_the_plan(spark):
    fixed = materialize(spark.range(10).withColumn("u", F.rand()), "t")
    assert rows(fixed) == rows(fixed) and shared_dir(spark) in fixed.inputFiles()[0]


def test_written_tables_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(ss, "_written", {})
    table = materialize(spark.range(3), "drop")
    assert table.count() == 3 and ss.drop_written(spark) == 1 and ss.drop_written(spark) == 0


def test_a_file_is_written_from_its_own_rows_alone(spark, tmp_path):
    def encode(found):
        return f"{sys.getallocatedblocks()} {found[0]} {found[-1]} {len(found)}".encode()

    held, files, parts = {}, 40, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for n in (1, files):
            lines = spark.range(10_000 * n).selectExpr(f"concat('f', id % {n}) AS file_name", f"-(id div {n}) AS row", "concat('line ', id) AS line")
            sk.write_files(lines, str(tmp_path / f"out{n}"), encode)
            found = {p.name: p.read_text().split(" ", 1) for p in (tmp_path / f"out{n}").iterdir()}
            assert {k: v[1] for k, v in found.items()} == {f"f{k}": f"line {9999 * n + k} line {k} 10000" for k in range(n)}
            held[n] = max(int(v[0]) for v in found.values())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert held[files] - held[1] < 100_000  # objects of one file, not of all 400,000 lines
