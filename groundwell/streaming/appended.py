"""Streams of lines from files that are still being written.

Spark's file streams take a file once, so lines appended later are lost. This source keeps a byte
offset per file: a batch takes what lies between the last offset and the last line end that is
there, cut into ranges of bytes that are read by different tasks. A line without its end is left to
the next batch. Offsets are part of the stream's checkpoint, so a batch that is run again reads the
same bytes. Files are found through pyarrow's file systems, which must reach the folder from the
driver and from every executor. A file that became shorter was written anew: it is read from its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a file that one task reads, and that are read at once where a line end is looked for.
RANGE, LOOK = 64 << 20, 1 << 16
SCHEMA = "file string, offset long, value string"


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def line_end(file, size: int, above: int) -> int:
    """The place behind the last line end between `above` and `size`, else `above`."""
    upto = size
    while upto > above:
        begin = max(above, upto - LOOK)
        found = file.read_at(upto - begin, begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        upto = begin
    return above


def lines(file, begin: int, end: int, from_start: bool) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in [begin, end), with their offsets; if not `from_start`, a line may hang over from before."""
    file.seek(begin if from_start else begin - 1)
    at = begin
    if not from_start:
        hanging = _line(file)
        at = begin - 1 + len(hanging)
    while at < end:
        line = _line(file)
        if not line:
            return
        yield at, line
        at += len(line)


def _line(file) -> bytes:
    """Through the next line end."""
    out = b""
    while True:
        place = file.tell()
        piece = file.read(LOOK)
        if not piece:
            return out
        stop = piece.find(b"\n")
        if stop >= 0:
            file.seek(place + stop + 1)
            return out + piece[: stop + 1]
        out += piece


class AppendedReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, size: int):
        self.path, self.suffix, self.size = path, suffix, size
        self.system, self.root = opened(path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for info in self.system.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            if info.is_file and info.path.endswith(self.suffix):
                with self.system.open_input_file(info.path) as file:
                    found[info.path] = line_end(file, info.size, 0)
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, upto in sorted(end.items()):
            done = start.get(path, 0)
            done = 0 if done > upto else done
            out += [Range(path, a, min(a + self.size, upto)) for a in range(done, upto, self.size)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        with self.system.open_input_file(partition.path) as file:
            starts = partition.begin == 0 or file.read_at(1, partition.begin - 1) == b"\n"
            if starts:
                file.seek(partition.begin)
            for offset, line in lines(file, partition.begin, partition.end, starts):
                yield partition.path, offset, line.rstrip(b"\r\n").decode(errors="replace")

    def commit(self, end: dict) -> None:
        pass


class AppendedLines(DataSource):
    """Format `appended_lines`: file, offset and value of every complete line. Options: path, suffix, bytes (of a range)."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return AppendedReader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("bytes", RANGE)))


def read_appended(spark: SparkSession, path: str, suffix: str = ".jsonl", size: int = RANGE) -> DataFrame:
    """A stream of the complete lines of all files under `path`, those appended while it runs included."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").option("path", path).option("suffix", suffix).option("bytes", size).load()
