"""Logger files as a Spark data source: ``spark.read.format("loggers")`` and a routed, all-or-nothing ``df.write.format("loggers")``.

Reading: files are cut into byte ranges, values come as Arrow batches, and filters on the keys in the file
names choose the files before any is opened. Writing: tasks write into a hidden folder; the driver moves the
files of successful tasks to their routes when all have ended, or removes the folder when the job fails.

Read options: path; skip (lines in front, 0); columns and kinds (comma-separated names and one letter each:
n number, c text, _ left out, as in the scans); keys (names of the parts of the file name between ``_``, empty to
leave one out); encoding (utf-8; one in which a line end is a byte of its own); pattern (regular expression for the
file name); split (bytes of a range, 32 MB). Write options: path, column, pattern, hit, miss as in sinks.write_routed.
Paths are opened by pyarrow's file systems on the driver and the executors.
"""

from __future__ import annotations

import csv
import re
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith,
    StringStartsWith, WriterCommitMessage,
)

from .files import resolve

SPLIT_BYTES, BLOCK_BYTES = 32 << 20, 4 << 20
TRIES = 20  # to remove the hidden folder while tasks are being stopped


@dataclass
class Split(InputPartition):
    """Lines that start in bytes ``start`` .. ``end`` of a file; without a path there is nothing to read."""

    path: str | None
    start: int = 0
    end: int = 0
    keys: tuple = ()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # route, file name


def _accepts(f: Filter, keys: dict[str, str | None]) -> bool:
    value = keys[f.attribute[0]]
    if isinstance(f, IsNotNull):
        return value is not None
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    return {StringStartsWith: value.startswith, StringEndsWith: value.endswith, StringContains: value.__contains__}[type(f)](f.value)


class LoggerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.skip = options["path"], int(options.get("skip", 0))
        self.encoding, self.pattern = options.get("encoding", "utf-8"), options.get("pattern", "")
        self.split = int(options.get("split", SPLIT_BYTES))
        self.names, self.kinds, self.keys = _layout(options)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {k for k in self.keys if k}
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and f.attribute[0] in known and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def _keys_of(self, path: str) -> dict[str, str | None]:
        parts = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].split("_")
        return {k: parts[i] if i < len(parts) else None for i, k in enumerate(self.keys) if k}

    def partitions(self) -> list[Split]:
        system, base = resolve(self.path)
        out = []
        for info in sorted(system.get_file_info(arrow_fs.FileSelector(base, recursive=True)), key=lambda i: i.path):
            inside = info.path[len(base):].lstrip("/").split("/")
            if info.type != arrow_fs.FileType.File or any(p[:1] in "_." for p in inside) or not re.search(self.pattern, inside[-1]):
                continue
            keys = self._keys_of(info.path)
            if all(_accepts(f, keys) for f in self.filters):
                out += [Split(info.path, a, min(a + self.split, info.size), tuple(keys.values())) for a in range(0, info.size, self.split)]
        return out or [Split(None)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.path is None:
            return
        system, _ = resolve(self.path)
        with system.open_input_file(split.path) as file:
            for lines in self._lines(file, split):
                yield self._batch(lines, split.keys)

    def _lines(self, file, split: Split) -> Iterator[list[bytes]]:
        """Whole lines in blocks; a range that starts inside a line leaves it to the range before."""
        at, rest, skip = split.start, b"", self.skip if split.start == 0 else 0
        if split.start:
            file.seek(split.start - 1)
            while True:
                data = file.read(1 << 16)
                if not data:
                    return
                cut = data.find(b"\n")
                if cut >= 0:
                    at = file.tell() - len(data) + cut + 1
                    break
            if at >= split.end:
                return
        file.seek(at)  # bytes up to ``at`` are behind us; the next line starts there
        while at < split.end:
            data = file.read(BLOCK_BYTES)
            data, ended = rest + data, not data
            if ended:
                lines, rest, used = ([data] if data else []), b"", len(data)
            else:
                lines = data.split(b"\n")
                rest = lines.pop()
                used = len(data) - len(rest)
            kept, place = [], at
            for line in lines:
                if place >= split.end:
                    break
                kept.append(line)
                place += len(line) + 1
            at += used
            if skip:
                skip, kept = max(0, skip - len(kept)), kept[skip:]
            yield kept
            if ended:
                break
        if skip and split.end < file.size():
            raise ValueError(f"preamble does not fit into the first range of {split.path}")

    def _batch(self, lines: list[bytes], keys: tuple) -> pa.RecordBatch:
        rows = list(csv.reader(t for t in (line.decode(self.encoding).rstrip("\r") for line in lines) if t.strip()))
        out = [pa.array([k] * len(rows), pa.string()) for k in keys]
        for i, kind in enumerate(self.kinds):
            if kind == "_":
                continue
            texts = [r[i] if i < len(r) and r[i] != "" else None for r in rows]
            if kind == "n":
                numbers = pd.to_numeric(pd.Series(texts, dtype=object), errors="coerce").to_numpy(dtype=float)
                out.append(pa.array(numbers, pa.float64(), from_pandas=True))
            else:
                out.append(pa.array(texts, pa.string()))
        return pa.RecordBatch.from_arrays(out, names=[*[k for k in self.keys if k], *[n for n, k in zip(self.names, self.kinds) if k != "_"]])


class RoutedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.column, self.pattern = options["column"], options["pattern"]
        self.hit, self.miss = options["hit"], options["miss"]
        self.stage = f"_stage-{uuid.uuid4().hex}"
        system, base = resolve(self.path)
        for route in dict.fromkeys((self.hit, self.miss)):
            system.create_dir(f"{base}/{self.stage}/{route}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = resolve(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.csv"
        open_files: dict[str, object] = {}
        try:
            for batch in iterator:
                pdf = batch.to_pandas()
                hit = pdf[self.column].map(lambda v: isinstance(v, str) and re.search(self.pattern, v) is not None).astype(bool)
                for route, part in ((self.hit, pdf[hit]), (self.miss, pdf[~hit])):
                    if not len(part):
                        continue
                    if route not in open_files:
                        # the folder is the driver's: a task that outlives its job finds none and makes none
                        open_files[route] = system.open_output_stream(f"{base}/{self.stage}/{route}/{name}")
                        open_files[route].write((",".join(part.columns) + "\n").encode())
                    open_files[route].write(part.to_csv(index=False, header=False, na_rep="NA").encode())
        finally:
            for file in open_files.values():
                file.close()
        return Written([(route, name) for route in open_files])

    def commit(self, messages: list[Written | None]) -> None:
        system, base = resolve(self.path)
        system.create_dir(base, recursive=True)
        if self.overwrite:
            for info in system.get_file_info(arrow_fs.FileSelector(base)):
                if info.type == arrow_fs.FileType.Directory and info.base_name.startswith("region="):
                    system.delete_dir(info.path)
        for route, name in (f for m in messages if m is not None for f in m.files):
            system.create_dir(f"{base}/region={route}", recursive=True)
            system.move(f"{base}/{self.stage}/{route}/{name}", f"{base}/region={route}/{name}")
        self.abort(messages)  # what is left are files of attempts that did not count
        with system.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        system, base = resolve(self.path)
        for left in range(TRIES, 0, -1):
            if system.get_file_info(f"{base}/{self.stage}").type != arrow_fs.FileType.Directory:
                return
            try:
                system.delete_dir(f"{base}/{self.stage}")
            except OSError:  # a task that is being stopped has just added a file
                if left == 1:
                    raise
                time.sleep(0.2)


def _layout(options: dict[str, str]) -> tuple[list[str], str, list[str]]:
    names, kinds = options["columns"].split(","), options["kinds"]
    if len(names) != len(kinds) or set(kinds) - set("nc_"):
        raise ValueError("expected one of n, c, _ for every column")
    return names, kinds, options.get("keys", "").split(",")


class LoggerFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loggers"

    def schema(self) -> str:
        names, kinds, keys = _layout(self.options)
        fields = [(k, "string") for k in keys if k] + [(n, "double" if k == "n" else "string") for n, k in zip(names, kinds) if k != "_"]
        return ", ".join(f"`{n}` {t}" for n, t in fields)

    def reader(self, schema) -> LoggerReader:
        return LoggerReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RoutedWriter:
        return RoutedWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.dataSource.register(LoggerFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
