"""Windowed summaries of growing folders of readings: minute statistics and daily doses as Structured Streaming jobs.

A run reads what has arrived since the last one (``availableNow``), updates the open windows and ends. The
checkpoint folder holds which files were read and the open windows, so a run after a restart goes on where
the last one stopped. Windows leave the state once the watermark has passed them; rows later than that are dropped.

Each micro-batch writes the windows it changed to a folder of its own, named by its number. A batch
that is repeated after a failure replaces its folder, and ``latest_windows`` takes the newest row of
each window, so results are exact whatever was repeated. A column named ``batch`` must not be a key or summary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.values import mean_of, sd_of, sum_of
from ..operators.aggregates import LIGHT_SECONDS

DELAY = "2 days"


def stream_files(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_batch: int | None = None, **options: str) -> DataFrame:
    """A folder of files as a stream; files that arrive later belong to a later batch. A single file must be named by a pattern."""
    reader = spark.readStream.schema(schema).format(kind).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def windowed(stream: DataFrame, keys: Sequence[str], ts: str, width: str, delay: str, **summaries: Column) -> DataFrame:
    """(keys, ts as start of its window, summaries) in event time; rows without a time belong to no window."""
    timed = stream.filter(F.col(ts).isNotNull()).withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", delay)
    out = timed.groupBy(*keys, F.window("_time", width).alias("_window")).agg(*[c.alias(n) for n, c in summaries.items()])
    return out.select(*keys, F.col("_window.start").cast("timestamp_ntz").alias(ts), *summaries)


def stream_minute_stats(stream: DataFrame, keys: Sequence[str], ts: str, value: str, minutes: int = 1, delay: str = DELAY, na_rm: bool = False) -> DataFrame:
    """Mean and sd per time slot, as aggregates.minute_stats gives for a table."""
    return windowed(stream, keys, ts, f"{minutes} minutes", delay, **{f"mean_{value}": mean_of(value, na_rm), f"sd_{value}": sd_of(value, na_rm)})


def stream_daily_dose(stream: DataFrame, keys: Sequence[str], ts: str, flux: str, seconds_per_sample: float = LIGHT_SECONDS,
                      delay: str = DELAY, na_rm: bool = False) -> DataFrame:
    """Light sum per day in mol per m2, as aggregates.daily_dose gives; ``ts`` is the start of the day."""
    clean = F.when(F.col(flux) < 0, F.lit(0.0)).otherwise(F.col(flux))
    return windowed(stream, keys, ts, "1 day", delay, dose=sum_of(clean * F.lit(float(seconds_per_sample)), na_rm) / 1e6)


def write_windows(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for foreachBatch: the changed windows of batch n in ``path``/batch=n, replaced when the batch is repeated."""
    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_available(summary: DataFrame, path: str, checkpoint: str) -> None:
    """Read everything that has arrived, then stop."""
    summary.sparkSession.createDataFrame([], summary.schema).write.mode("ignore").parquet(f"{path}/batch=-1")  # a table even without any batch
    query = summary.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write_windows(path)).start()
    query.awaitTermination()


def latest_windows(spark: SparkSession, path: str, keys: Sequence[str], schema: StructType) -> DataFrame:
    """The newest state of every window. Without any batch there are no rows."""
    fields = [f.name for f in schema if f.name not in keys]
    written = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("_new"))
    return newest.select(*keys, *[F.col(f"_new.{f}").alias(f) for f in fields])
