"""Session set-up and the shared folder used for written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}  # paths written per application


def get_session(app: str = "tidelog", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library expects; everything else is the cluster's choice."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is
    used only when that is unset and the master is local, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tidelog-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)  # after the session has ended
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_written(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote; results still reading them become unusable."""
    from .sources.files import remove

    paths = _written.pop(spark.sparkContext.applicationId, [])
    return sum(remove(path) for path in paths)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used where later steps must all see the very same rows (range partition
    numbers, iteration state): a lost executor then re-reads files instead of
    re-running a plan whose sampling could come out differently. The files also
    give Catalyst a true size for its broadcast decision.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
