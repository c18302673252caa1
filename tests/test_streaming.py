"""Streams against the same summaries of the finished table: restarts, late rows, repeated batches."""

import datetime as dt

import pytest

from tests.conftest import rows
from tidelog.operators.aggregates import daily_dose, minute_stats
from tidelog.streaming.resample import latest_windows, run_available, stream_daily_dose, stream_files, stream_minute_stats, write_windows

SCHEMA = "site string, at timestamp_ntz, ppfd double"


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 5, day, hour, minute, second)


@pytest.fixture
def folder(spark, tmp_path):
    def add(*readings):
        spark.createDataFrame(list(readings), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(kind=stream_minute_stats, **options):
        stream = stream_files(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
        out = kind(stream, ["site"], "at", "ppfd", **options)
        run_available(out, str(tmp_path / kind.__name__), str(tmp_path / f"{kind.__name__}-checkpoint"))
        return latest_windows(spark, str(tmp_path / kind.__name__), ["site", "at"], out.schema)

    return add, run, tmp_path


FIRST = [("a", at(1, 10, 0, 5), 1.0), ("a", at(1, 10, 0, 45), 3.0), ("a", at(5, 9), 5.0), ("b", at(5, 9, 1), None), ("b", at(5, 9, 1, 30), 2.0), (None, at(5, 9), -7.0), ("a", None, 9.0)]
SECOND = [("a", at(5, 9, 0, 30), 8.0), ("b", at(4, 12), 4.0), ("b", at(6, 1), 6.0)]


def test_restart_goes_on_with_the_open_windows(spark, folder):
    add, run, _ = folder
    add(*FIRST)
    once = run()
    table = spark.createDataFrame([r for r in FIRST if r[1]], SCHEMA)
    assert rows(once) == rows(minute_stats(table, ["site"], "at", "ppfd"))
    add(*SECOND)  # a new query on the same checkpoint: rows of a window seen before, and rows within the delay
    table = spark.createDataFrame([r for r in FIRST + SECOND if r[1]], SCHEMA)
    assert rows(run()) == rows(minute_stats(table, ["site"], "at", "ppfd"))
    assert rows(run()) == rows(minute_stats(table, ["site"], "at", "ppfd"))  # nothing new


def test_rows_behind_the_watermark_are_dropped(spark, folder):
    add, run, _ = folder
    add(*FIRST)
    run(delay="1 day")
    add(("a", at(1, 10, 0, 59), 100.0), ("a", at(2, 0), 100.0), ("a", at(4, 10), 7.0))  # watermark: day 4, 9:01:30
    run(delay="1 day")
    got = {(r.site, r["at"]): r.mean_ppfd for r in run(delay="1 day").collect()}
    assert got[("a", at(1, 10))] == 2.0 and got[("a", at(4, 10))] == 7.0 and ("a", at(2)) not in got


def test_daily_doses(spark, folder):
    add, run, _ = folder
    add(*FIRST)
    add(*SECOND)
    table = spark.createDataFrame([r for r in FIRST + SECOND if r[1]], SCHEMA).selectExpr("site", "date_trunc('day', at)::timestamp_ntz AS at", "ppfd")
    assert rows(run(stream_daily_dose)) == rows(daily_dose(table, ["site", "at"], "ppfd"))


def test_a_repeated_batch_changes_nothing(spark, folder):
    add, run, path = folder
    add(*FIRST)
    before = rows(run())
    kept = str(path / "stream_minute_stats" / "batch=0")
    again = spark.createDataFrame(spark.read.parquet(kept).collect(), spark.read.parquet(kept).schema)
    write_windows(str(path / "stream_minute_stats"))(again, 0)
    assert rows(run()) == before


def test_an_empty_folder(folder):
    add, run, _ = folder
    add()
    assert run().collect() == []
