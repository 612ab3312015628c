"""The last lines of logs, read from their ends: a data source whose work is that of the lines asked for.

Files are taken from the newest to the oldest, and each from its end in blocks that double, until the lines are
together; older files and what stands before are never opened.  Planning finds where the lines begin, tasks read them.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Lines at most, bytes of the first block.
MOST, BLOCK = 5000, 64 << 10
SCHEMA = "arrival struct<changed: timestamp, file: string, start: bigint, line: bigint>, value string"


@dataclass
class Slice(InputPartition):
    """Bytes of a file that hold whole lines."""

    path: str
    changed: dt.datetime
    start: int
    end: int


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path of a folder or file as Spark names it."""
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", path)))


def _begin(fs: pafs.FileSystem, path: str, size: int, n: int, block: int) -> tuple[int, int, int]:
    """(where the last n lines of a file begin, how many there are, bytes read)."""
    took, read = 0, 0
    with fs.open_input_file(path) as file:
        while True:
            took = min(size, max(block, 2 * took))
            lines = file.read_at(took, size - took).splitlines(keepends=True)
            read += took
            whole = lines if took == size else lines[1:]  # the first one may be cut
            if took == size or len(whole) >= n:
                return size - sum(map(len, whole[-n:])), min(n, len(whole)), read


def planned(path: str, n: int, order: str = "changed", block: int = BLOCK) -> tuple[list[Slice], int]:
    """The slices that hold the last n lines (1 to ``MOST``) under ``path``, oldest first, and the bytes that were read.

    ``order`` is by the time of change and then by name (changed), or by name alone (name).  A path that is not there
    has no lines.
    """
    fs, place = filesystem(path)
    info = fs.get_file_info(place)
    files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(place, allow_not_found=True))
    files = [f for f in files if f.type == pafs.FileType.File and f.size and not f.base_name.startswith(("_", "."))]
    files.sort(key=lambda f: f.path if order == "name" else (f.mtime, f.path), reverse=True)
    left, found, read = min(max(n, 1), MOST), [], 0
    for f in files:
        start, got, took = _begin(fs, f.path, f.size, left, block)
        found.append(Slice(f.path, f.mtime, start, f.size))
        left, read = left - got, read + took
        if not left:
            break
    return found[::-1], read


class LogTailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.n, self.order = options["path"], int(options.get("lines", 400)), options.get("order", "changed")

    def partitions(self) -> list[Slice]:
        return planned(self.path, self.n, self.order)[0]

    def read(self, partition: Slice | None) -> Iterator[tuple]:
        if partition is None:  # there is no slice
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as file:
            data = file.read_at(partition.end - partition.start, partition.start)
        for i, line in enumerate(data.splitlines()):
            yield (partition.changed, partition.path, partition.start, i), line.decode("utf-8", "ignore")


class LogTail(DataSource):
    """``spark.read.format("log_tail").option("lines", n).load(path)``: (arrival, value), as ``readers.read_lines``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogTailReader:
        return LogTailReader(self.options)


def read_log_tail(spark: SparkSession, path: str, n: int = 400, order: str = "changed") -> DataFrame:
    """(arrival, value) of the last n lines (1 to ``MOST``); bytes that are no UTF-8 go."""
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").option("lines", n).option("order", order).load(path)
