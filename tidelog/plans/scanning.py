"""Queries: reading and writing logger files.

The files are written from the readings into the shared folder first (once per session and
data set), at most CHUNK readings per file, and then read back by the operator under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times as tm
from ..functions.values import snap, snap_sql
from ..operators import cleaning as cl
from ..operators.joins import apply_factor
from ..operators.ordering import union_by_name
from ..session import new_path
from ..sources import calibration as cal
from ..sources import loggers as lg
from ..sources import scans as sc
from ..sources import sinks as sk
from ..sources.files import is_folder
from ..sources.workbook import write_rows
from .registry import ORACLES, query
from .tables import READINGS, readings, with_views

CHUNK = 20_000
_written: dict[tuple, str] = {}

# Header of the current logger, with the instrument's Japanese texts.
CURRENT_HEADER = "No.,YYYY/MM/DD,hh:mm:ss,Velo[cm/s],Vel X[cm/s],Vel Y[cm/s],Temp[℃],流向[゜],"
CURRENT_TYPES = "nccnnnnn_"
PREAMBLE = 36


def _folder(spark, d, kind, build) -> str:
    table = readings(spark, d)
    changed = spark.read.parquet(f"{d}/events.parquet").agg(F.max("_metadata.file_modification_time"), F.sum("_metadata.file_size")).first()
    key = (spark.sparkContext.applicationId, d, kind, *changed)
    if key not in _written or not is_folder(_written[key]):
        folder = new_path(spark, f"files-{kind}")
        build(table, folder)
        _written[key] = folder
    return _written[key]


def _chunked(r, extension="csv", tag="log"):
    chunk = F.floor(F.col("event_id") / CHUNK).cast("string")
    name = F.concat_ws("_", F.lit(tag), chunk, "location", "position", F.lit(f"x.{extension}"))
    return r.withColumn("file_name", name)


def _with_heading(rows, heading):
    """Heading lines in front of every file; rows carry (file_name, row, line)."""
    top = F.posexplode(F.array(*[F.lit(h) if isinstance(h, str) else h for h in heading])).alias("i", "line")
    heads = rows.select("file_name").distinct().select("file_name", top)
    heads = heads.select("file_name", (F.col("i") - len(heading)).cast("bigint").alias("row"), "line")
    return rows.select("file_name", "row", "line").unionByName(heads)


def _encode(encoding):
    return lambda lines: ("\r\n".join(lines) + "\r\n").encode(encoding)


def _write_current(r, folder):
    line = F.concat_ws(
        ",", F.col("event_id"), F.date_format("datetime", "yyyy/MM/dd"), F.date_format("datetime", "HH:mm:ss"),
        F.col("ppfd"), F.col("rate"), -F.col("rate"), F.col("logger"), F.lit("12"), F.lit(""),
    )
    rows = _chunked(r).select("file_name", F.col("event_id").alias("row"), line.alias("line"))
    notes = [f"測器情報 {i}" for i in range(PREAMBLE)]
    sk.write_files(_with_heading(rows, [*notes, CURRENT_HEADER]), folder, _encode("cp932"))


@query(
    "scan_cp932_logger",
    with_views(
        """SELECT location, event_id::DOUBLE AS n, date_trunc('second', datetime) AS datetime, ppfd AS speed, rate AS vel_x, logger::DOUBLE AS temperature
           FROM readings WHERE rate BETWEEN -30 AND 100""", READINGS),
)
def scan_cp932_logger(spark, d):
    folder = _folder(spark, d, "current", _write_current)
    raw = sc.scan_by_header(spark, folder, PREAMBLE, CURRENT_TYPES, "cp932")
    picked = cl.select_by_name(raw, {
        "path": "path", "n": "No.", "date_text": "YYYY", "time_text": "hh:", "speed": "Velo[", "vel_x": "Vel X[", "temperature": "Temp[",
    })
    keyed = sc.file_name_keys(picked, ["", "", "location", "position"])
    typed = keyed.withColumn("datetime", tm.stamp("date_text", "time_text"))
    return cl.in_range(typed, "vel_x", -30, 100).select("location", "n", "datetime", "speed", "vel_x", "temperature")


OXYGEN_NAMES = ["n", "datetime", "oxygen", "temperature"]


def _oxygen_lines(r, stamp):
    return F.concat_ws(",", F.col("event_id"), stamp, F.col("ppfd"), F.col("logger"))


def _write_oxygen(r, folder):
    half = F.when(F.hour("datetime") < 12, "午前").otherwise("午後")
    stamp = F.concat(F.date_format("datetime", "MM/dd/yyyy "), half, F.date_format("datetime", " hh:mm:ss"))
    for extension, even in (("csv", True), ("xlsx", False)):
        part = _chunked(r.filter((F.col("logger") % 4 < 2) if even else (F.col("logger") % 4 >= 2)), extension, "oxy")
        rows = part.select("file_name", F.col("event_id").alias("row"), _oxygen_lines(part, stamp).alias("line"))
        full = _with_heading(rows, ["Plot title", "#,Date,DO,Temp"])
        sk.write_files(full, folder, _encode("utf-8") if extension == "csv" else _as_workbook)


def _as_workbook(lines):
    def cell(text):
        try:
            return float(text)
        except ValueError:
            return text

    return write_rows([[cell(c) for c in line.split(",")] for line in lines])


@query(
    "scan_headerless_dispatch",
    with_views(
        """SELECT location, position, event_id::DOUBLE AS n, date_trunc('second', datetime) AS datetime, ppfd AS oxygen, logger::DOUBLE AS temperature
           FROM readings""", READINGS),
)
def scan_headerless_dispatch(spark, d):
    folder = _folder(spark, d, "oxygen", _write_oxygen)
    raw = sc.scan_headerless_any(spark, folder, "ncnn", OXYGEN_NAMES)
    keyed = sc.file_name_keys(raw, ["", "", "location", "position"])
    return keyed.withColumn("datetime", tm.parse_month_first("datetime")).select("location", "position", *OXYGEN_NAMES)


def _write_station(r, folder):
    """Surface stations of two makes: one measures photon flux, the other energy."""
    stamp = F.date_format("datetime", "MM/dd/yyyy HH:mm:ss")
    for make, head, cols in (
        (0, "#,Date Time GMT+09:00,PAR uE", [F.col("event_id"), stamp, F.col("ppfd")]),
        (1, "#,Solar W/m2,Date Time GMT+09:00", [F.col("event_id"), F.col("ppfd"), stamp]),
    ):
        part = _chunked(r.filter(F.col("logger") % 3 % 2 == make), tag=f"station{make}")
        rows = part.select("file_name", F.col("event_id").alias("row"), F.concat_ws(",", *cols).alias("line"))
        sk.write_files(_with_heading(rows, ["Station export", head]), folder, _encode("utf-8"))


def _station(spark, d):
    folder = _folder(spark, d, "station", _write_station)
    return sc.scan_by_header(spark, folder, 1)


@query(
    "scan_varied_header",
    with_views(
        f"""SELECT location, position, time_bucket(INTERVAL 10 MINUTE, date_trunc('second', datetime) + INTERVAL 5 MINUTE) AS datetime,
                  {snap_sql('CASE WHEN logger % 3 % 2 = 1 THEN 4.6 * ppfd ELSE ppfd END')} AS ppfd FROM readings""", READINGS),
)
def scan_varied_header(spark, d):
    named = cl.select_by_name(_station(spark, d), {"path": "path", "datetime": "GMT", "par": "PAR", "sol": "W/m2"}, how="contains")
    keyed = sc.file_name_keys(named, ["", "", "location", "position"])
    flux = 4.6 * F.coalesce(F.col("sol").cast("double"), F.lit(0.0)) + F.coalesce(F.col("par").cast("double"), F.lit(0.0))
    return keyed.select(
        "location", "position", tm.round_minutes(tm.parse_month_first("datetime"), 10).alias("datetime"),
        snap(F.when(flux >= 0, flux)).alias("ppfd"),
    )


@query(
    "union_varied_files",
    with_views(
        """SELECT event_id, CASE WHEN logger % 3 % 2 = 0 THEN ppfd END AS par, CASE WHEN logger % 3 % 2 = 1 THEN ppfd END AS sol FROM readings""",
        READINGS),
)
def union_varied_files(spark, d):
    t = _station(spark, d)
    return t.select(
        F.col("`#`").cast("bigint").alias("event_id"), F.col("`PAR uE`").cast("double").alias("par"),
        F.col("`Solar W/m2`").cast("double").alias("sol"),
    )


def _write_sheets(r, folder):
    minutes = F.hour("datetime") * 60 + F.minute("datetime")
    serial = (tm.length_days(F.lit("1899-12-30").cast("date"), "datetime") + minutes / 1440).cast("string")
    part = _chunked(r, "xlsx", "sheet")
    rows = part.select("file_name", F.col("event_id").alias("row"), F.concat_ws(",", "location", "event_id", serial, "ppfd").alias("line"))
    sk.write_files(_with_heading(rows, ["location,id,start_date,value"]), folder, _as_workbook)


@query(
    "scan_xlsx",
    with_views(
        "SELECT location, event_id::DOUBLE AS id, date_trunc('minute', datetime) AS start_date, ppfd AS value FROM readings", READINGS),
)
def scan_xlsx(spark, d):
    folder = _folder(spark, d, "sheet", _write_sheets)
    t = sc.scan_workbooks(spark, folder, "cnnn", ["location", "id", "start_date", "value"])
    return t.select("location", "id", sc.excel_stamp(F.col("start_date")).alias("start_date"), "value")


@query(
    "scan_path_regex",
    with_views(
        "SELECT event_id::DOUBLE AS n, ppfd AS oxygen FROM readings WHERE location IN ('view', 'click') AND position = '0m' AND logger % 4 < 2", READINGS),
)
def scan_path_regex(spark, d):
    folder = _folder(spark, d, "oxygen", _write_oxygen)
    lines = sc.logger_lines(spark, folder, 2, glob="*.csv", pattern="_(view|click)_0m_")
    return sc.scan_headerless(lines, "n_n_", OXYGEN_NAMES).select("n", "oxygen")


@query(
    "file_name_keys",
    with_views(
        """SELECT DISTINCT location, position, CASE WHEN logger % 4 < 2 THEN 'csv' ELSE 'xlsx' END AS type, event_id // 20000 AS chunk FROM readings""",
        READINGS),
)
def file_name_keys(spark, d):
    folder = _folder(spark, d, "oxygen", _write_oxygen)
    files = sc.list_files(spark, folder, "oxy_")
    keyed = sc.file_name_keys(files, ["", "chunk", "location", "position", "", "type"])
    return keyed.select("location", "position", "type", F.col("chunk").cast("bigint").alias("chunk"))


INTERMEDIATE = "event_id BIGINT, location STRING, gappy DOUBLE, day DATE"


def _write_intermediate(r, folder):
    sk.write_routed(r.select("event_id", "location", "gappy", "day"), folder, "location", "view|click", "inner", "outer")


@query("scan_typed_csv", with_views("SELECT event_id, location, gappy, day FROM readings", READINGS))
def scan_typed_csv(spark, d):
    folder = _folder(spark, d, "intermediate", _write_intermediate)
    return sc.scan_typed_csv(spark, folder, INTERMEDIATE).select("event_id", "location", "gappy", "day")


@query(
    "sink_by_region",
    with_views(
        f"""SELECT CASE WHEN regexp_matches(location, 'view|click') THEN 'inner' ELSE 'outer' END AS region, location, count(*) AS n,
                  {snap_sql('sum(gappy)')} AS total FROM readings GROUP BY ALL""", READINGS),
)
def sink_by_region(spark, d):
    folder = _folder(spark, d, "intermediate", _write_intermediate)
    both = [
        sc.scan_typed_csv(spark, f"{folder}/region={region}", INTERMEDIATE).withColumn("region", F.lit(region))
        for region in ("inner", "outer")
    ]
    out = union_by_name(both).groupBy("region", "location").agg(F.count(F.lit(1)).alias("n"), F.sum("gappy").alias("total"))
    return out.withColumn("total", snap("total"))


@query(
    "logger_source",
    with_views(
        """SELECT location, position, event_id::DOUBLE AS n, ppfd AS oxygen, logger::DOUBLE AS temperature
           FROM readings WHERE logger % 4 < 2 AND location IN ('view', 'click') AND position = '0m' AND ppfd > 20""", READINGS),
)
def logger_source(spark, d):
    """The text files of the headerless logger by the data source; the filters on their names choose the files."""
    lg.register(spark)
    table = spark.read.format("loggers").options(
        path=_folder(spark, d, "oxygen", _write_oxygen), skip=2, columns=",".join(OXYGEN_NAMES), kinds="n_nn", keys=",,location,position", pattern="[.]csv$").load()
    return table.filter(F.col("location").isin("view", "click") & (F.col("position") == "0m") & (F.col("oxygen") > 20))


@query("logger_sink", ORACLES["sink_by_region"])
def logger_sink(spark, d):
    """The routed table written by the all-or-nothing sink."""
    lg.register(spark)
    folder = new_path(spark, "routed")
    rows = readings(spark, d).select("event_id", "location", "gappy", "day")
    rows.write.format("loggers").options(path=folder, column="location", pattern="view|click", hit="inner", miss="outer").mode("append").save()
    both = [sc.scan_typed_csv(spark, f"{folder}/region={r}", INTERMEDIATE).withColumn("region", F.lit(r)) for r in ("inner", "outer")]
    out = union_by_name(both).groupBy("region", "location").agg(F.count(F.lit(1)).alias("n"), F.sum("gappy").alias("total"))
    return out.withColumn("total", snap("total"))


def _write_variants(r, folder):
    """Three laboratories: the first names the concentration plainly, the others by its processing."""
    for lab, head in ((0, "id,station,conc"), (1, "station,conc_base_gain_carry_value,extra,id"), (2, "station,conc_base_gain_carry_value,extra,id")):
        cols = ["event_id", "location", "ppfd"] if lab == 0 else ["location", "ppfd", "position", "event_id"]
        part = _chunked(r.filter(F.col("logger") % 3 == lab), tag=f"lab{lab}")
        rows = part.select("file_name", F.col("event_id").alias("row"), F.concat_ws(",", *cols).alias("line"))
        sk.write_files(_with_heading(rows, [head]), folder, _encode("utf-8"))


@query("variant_files", with_views("SELECT event_id::DOUBLE AS id, location AS station, ppfd AS conc FROM readings", READINGS))
def variant_files(spark, d):
    folder = _folder(spark, d, "variants", _write_variants)
    table = sc.scan_variants(
        sc.scan_by_header(spark, folder, 0), {"conc_base_gain_carry_value": "conc"}, ["id", "station", "conc"], ["id", "conc"]
    )
    return table.drop("path")


COEFFICIENTS_SQL = "coefficients(id, c) AS (VALUES " + ", ".join(f"({i}, {c!r}::DOUBLE)" for i, c in cal.COEFFICIENTS.items()) + ")"


@query(
    "sensor_calibration",
    with_views(
        f"SELECT event_id, logger, {snap_sql('ppfd * c', 6)} AS ppfd FROM readings LEFT JOIN coefficients ON id = logger", READINGS, COEFFICIENTS_SQL),
)
def sensor_calibration(spark, d):
    factors = cal.calibration(spark).select(F.col("id").alias("logger"), "calibration_coefficient")
    out = apply_factor(readings(spark, d).select("event_id", "logger", "ppfd"), factors, "logger", "ppfd", "calibration_coefficient", "ppfd")
    return out.withColumn("ppfd", snap("ppfd", 6))
