"""Writers: routed tables and whole files in logger formats."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import resolve


def write_routed(df: DataFrame, path: str, column: str, pattern: str, hit: str, miss: str, fmt: str = "csv") -> None:
    """One folder per route: rows whose ``column`` matches go to ``region=hit``, the others to ``region=miss``.

    Every task writes its own part of each region: no shuffle, and a large region is many files.
    """
    routed = df.withColumn("region", F.when(F.col(column).rlike(pattern), hit).otherwise(miss))
    writer = routed.write.partitionBy("region")
    if fmt == "csv":
        writer.option("header", "true").option("nullValue", "NA").csv(path)
    else:
        writer.format(fmt).save(path)


def write_files(lines: DataFrame, folder: str, encode: Callable[[list[str]], bytes]) -> None:
    """Write one file per ``file_name`` from its lines (columns file_name, row, line).

    A file is gathered in one task, so callers bound the rows of a file; a task holds one file at a time. The content
    goes to a name of the attempt first and is then moved, so a repeated attempt leaves one good file.
    """

    def save(rows: pa.Table) -> pa.Table:
        system, base = resolve(folder)
        system.create_dir(base, recursive=True)
        order = pc.sort_indices(rows, sort_keys=[("row", "ascending"), ("line", "ascending")], null_placement="at_start")
        hidden = f"{base}/_{uuid.uuid4().hex}"
        with system.open_output_stream(hidden) as out:
            out.write(encode(rows["line"].take(order).to_pylist()))
        system.move(hidden, f"{base}/{rows['file_name'][0].as_py()}")
        return rows.select(["file_name"]).slice(0, 1)

    lines.select("file_name", "row", "line").groupBy("file_name").applyInArrow(save, "file_name string").count()
