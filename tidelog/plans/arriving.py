"""Queries over readings that arrive as a stream; each equals the query over the finished table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.values import snap
from ..session import new_path
from ..streaming import resample as rs
from .registry import ORACLES, query
from . import summaries  # noqa: F401 - its SQL holds here too
from .tables import reading_columns, table


def _arrive(spark, d, name, summary, keys):
    events = table(spark, d, "events")
    stream = reading_columns(rs.stream_files(spark, f"{d}/events.parque[t]", events.schema))
    out = summary(stream)
    path = new_path(spark, name)
    rs.run_available(out, f"{path}/windows", f"{path}/checkpoint")
    return rs.latest_windows(spark, f"{path}/windows", keys, StructType(out.schema.fields))


@query("stream_minute_stats", ORACLES["minute_stats"])
def stream_minute_stats(spark, d):
    keys = ["location", "datetime"]
    found = _arrive(spark, d, "stream-minutes", lambda s: rs.stream_minute_stats(s, ["location"], "datetime", "ppfd"), keys)
    return found.select(*keys, snap("mean_ppfd").alias("mean_ppfd"), snap("sd_ppfd").alias("sd_ppfd"))


@query("stream_daily_dose", ORACLES["daily_dose"])
def stream_daily_dose(spark, d):
    keys = ["location", "datetime"]
    found = _arrive(spark, d, "stream-doses", lambda s: rs.stream_daily_dose(s, ["location"], "datetime", "rate"), keys)
    return found.select("location", F.to_date("datetime").alias("day"), snap("dose", 6).alias("dose"), snap(F.col("dose") / 10, 6).alias("dose_60"))
