"""Readers for logger files: preambles, foreign encodings, varying headers, workbooks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import batched, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import split_into
from ..operators.joins import BROADCAST_ROWS, hand_back, key_join
from .files import line_at
from .workbook import iter_rows


def logger_lines(
    spark: SparkSession, path: str, skip: int, encoding: str = "utf-8", glob: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Decoded lines after the first ``skip`` lines of every file: (path, first, line).

    Files are read through the splittable text source. Only the split at offset 0 of a file
    holds its preamble, so counting lines there is enough and a huge file still spreads
    over many tasks. ``first`` marks the line right after the preamble. Bytes stay untouched
    until they are decoded here (line ends and commas are never part of a CP932 character).
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("split"),
        F.col("value").cast("binary").alias("value"),
    )
    if pattern:
        raw = raw.filter(F.col("path").rlike(pattern))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        split: set[str] = set()
        for pdf in batches:
            head = pdf["start"] == 0
            position = pdf.groupby("path").cumcount() + pdf["path"].map(lambda p: seen.get(p, 0))
            for p, n in pdf.loc[head, "path"].value_counts().items():
                seen[p] = seen.get(p, 0) + int(n)
            split.update(pdf.loc[head & pdf["split"], "path"].unique())
            keep = ~head | (position >= skip)
            kept = pdf[keep]
            if not len(kept):
                continue
            yield pd.DataFrame({
                "path": kept["path"],
                "first": (head & (position == skip))[keep],
                "line": b"\n".join(kept["value"]).decode(encoding).split("\n"),  # no line holds a line end
            })
        short = [p for p in split if seen[p] <= skip]
        if short:
            raise ValueError(f"preamble does not fit the first split of {short[0]}")

    return raw.mapInPandas(decode, "path string, first boolean, line string")


def header_lines(
    spark: SparkSession, path: str, skip: int, encoding: str = "utf-8", glob: str | None = None, pattern: str | None = None
) -> DataFrame:
    """(path, head): the line after the preamble of every file. Only the start of each file is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select(F.col("_metadata.file_path").alias("path"), F.col("path").alias("uri"))
    if pattern:
        files = files.filter(F.col("path").rlike(pattern))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = [line_at(uri, skip, encoding) for uri in pdf["uri"]]
            yield pd.DataFrame({"path": pdf["path"], "head": heads})

    return files.mapInPandas(read, "path string, head string").filter(F.col("head").isNotNull())


def file_name_keys(df: DataFrame, names: Sequence[str], path: str = "path", pattern: str = "[^A-Za-z0-9]+") -> DataFrame:
    """Columns from the pieces of the file name; an empty name drops its piece."""
    base = F.element_at(F.split(F.col(path), "/"), -1)
    return df.select("*", *split_into(base, names, pattern))


def _as_type(cell: Column, kind: str) -> Column:
    text = F.nullif(F.trim(cell), F.lit(""))
    return text.try_cast("double") if kind == "n" else text


def _typed(cells: Column, types: str, names: Sequence[str]) -> list[Column]:
    """Columns by position: n number, c text, _ dropped. Unreadable numbers become NULL."""
    out = []
    for i, (kind, name) in enumerate(zip(types, names)):
        if kind == "_":
            continue
        out.append(_as_type(F.get(cells, F.lit(i)), kind).alias(name))
    return out


def _csv_cells(line: Column, count: int) -> Column:
    schema = ", ".join(f"c{i} string" for i in range(count))
    parsed = F.from_csv(line, F.lit(schema), {"mode": "PERMISSIVE"})
    return F.array(*[parsed[f"c{i}"] for i in range(count)])


def _header_names(line: Column, types: str | None) -> Column:
    """Names of a header line by position; NULL where the position is dropped."""

    def name(cell: Column, at: Column) -> Column:
        text = F.regexp_replace(cell, r'^[\s"]+|[\s"]+$', "")
        text = F.when(F.length(text) > 0, text).otherwise(F.concat(F.lit("unnamed_"), at.cast("string")))
        dropped = [i for i, kind in enumerate(types or "") if kind == "_"]
        return F.when(~at.isin(dropped), text) if dropped else text

    return F.transform(F.split(line, ","), name)


def scan_headerless(lines: DataFrame, types: str, names: Sequence[str]) -> DataFrame:
    """Lines without a header row, columns named and typed by position."""
    cells = lines.withColumn("_cells", _csv_cells(F.col("line"), len(types)))
    return cells.select("path", *_typed(F.col("_cells"), types, names))


def scan_by_header(
    spark: SparkSession,
    path: str,
    skip: int,
    types: str | None = None,
    encoding: str = "utf-8",
    glob: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Tables whose first line after the preamble names the columns; differing files are stacked by name.

    With ``types=None`` all columns stay text. The names and places of columns, which make the
    schema, are the only thing brought to the driver; each file's rows look their places up
    in its own header, so any number of header lines may differ. The rows are read once.
    """
    heads = header_lines(spark, path, skip, encoding, glob, pattern).select("path", _header_names(F.col("head"), types).alias("_names"))
    lines = logger_lines(spark, path, skip, encoding, glob, pattern)
    data = lines.filter(~F.col("first")).select("path", "line")
    known = heads.select(F.posexplode("_names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"), F.max("at").alias("last"))
    places = sorted((r["at"], r["name"], r["last"]) for r in known.collect() if r["name"] is not None)
    if not places:
        return data.select("path")
    width = max([len(types or ""), *(last + 1 for *_, last in places)])
    variants = heads.select("_names").distinct().limit(2).collect()
    if len(variants) == 1:
        data = data.withColumn("_names", F.array(*[F.lit(n) for n in variants[0]["_names"]]))
    elif heads.count() <= BROADCAST_ROWS:
        data = key_join(data, F.broadcast(heads), ["path"])
    else:
        sizes = data.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
        data = hand_back(data, key_join(sizes, heads, ["path"]), ["path"], "_n", ["line"])
    cells = data.withColumn("_cells", _csv_cells(F.col("line"), width))
    out = []
    for at, name, _ in places:
        place = F.nullif(F.array_position("_names", F.lit(name)), F.lit(0)) - 1
        kind = types[at] if types and at < len(types) else "c"
        out.append(_as_type(F.get(F.col("_cells"), place.cast("int")), kind).alias(name))
    return cells.select("path", *out)


def scan_variants(table: DataFrame, rename: Mapping[str, str], keep: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Stacked files that call the same column differently: bring the names together, keep the common columns."""
    for old, new in rename.items():
        if old in table.columns:
            source = F.col(f"`{old}`")
            table = table.withColumn(new, F.coalesce(F.col(new), source) if new in table.columns else source)
    return table.select("path", *[F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in keep])


def scan_workbooks(spark: SparkSession, path: str, types: str, names: Sequence[str], skip: int = 1, glob: str = "*.xlsx") -> DataFrame:
    """First sheet of every workbook under ``path``, parsed row by row; a workbook is one record of at most 1,048,576 rows."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
        .select(F.col("_metadata.file_path").alias("path"), "content")
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for rows in batched(islice(iter_rows(content.as_py()), skip, None), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.list_(pa.string()))], names=["path", "cells"])

    cells = files.mapInArrow(parse, "path string, cells array<string>")
    return cells.select("path", *_typed(F.col("cells"), types, names))


def excel_stamp(serial: Column) -> Column:
    """Timestamp (no zone) of an Excel day number, to the second."""
    seconds = F.round(serial * 86400).cast("bigint")
    return F.lit("1899-12-30 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def scan_headerless_any(spark: SparkSession, path: str, types: str, names: Sequence[str], skip: int = 2) -> DataFrame:
    """CSV and XLSX files of the same layout under one folder, chosen by extension."""
    text = scan_headerless(logger_lines(spark, path, skip, glob="*.csv"), types, names)
    return text.unionByName(scan_workbooks(spark, path, types, names, skip))


def scan_typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Intermediate tables with a header; the schema is given, never inferred."""
    return spark.read.schema(schema).option("header", "true").option("nullValue", "NA").csv(path)


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files under ``path`` whose full name matches the pattern (contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length").filter(F.col("path").rlike(pattern))
