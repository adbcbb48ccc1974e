"""A streaming source of growing text files, line by line with positions.

The built-in text source reads a file once, when it first appears. This one reads what was appended: an offset is
the size of every file, a batch the bytes between two sizes. A line belongs to the batch that has the line break
at its end, and a reader goes back to where that line begins; so a line that was half written when a batch was cut is
whole in the next one, and a batch that runs again gives the same lines. Large ranges are read by several
tasks under the same rule. ``pos`` is the byte at which a line begins: it grows along a file and never repeats.

A file that got shorter was begun anew and is read from its start, its positions too. The last line of a file is
read when its line break is there (a batch read of the folder takes it as it is). Offsets are one number a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from kinetable.sources.files import file_system

SCHEMA = "log string, pos long, value string"
RANGE_BYTES, BLOCK = 64 << 20, 1 << 20


@dataclass
class FileRange(InputPartition):
    """Lines of a file whose line breaks lie in ``[begin, end)``; with ``last`` also what follows the last one."""

    log: str
    begin: int
    end: int
    last: bool = False


class _Folder:
    """The log files of a folder; names are paths below it."""

    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.range, self.tail = int(options.get("rangeBytes", RANGE_BYTES)), int(options.get("tail", -1))

    def sizes(self) -> dict[str, int]:
        from pyarrow import fs

        system, place = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
        return {i.path[len(place.rstrip("/")) + 1:]: i.size for i in found
                if i.type == fs.FileType.File and i.path.endswith(self.suffix) and not i.base_name.startswith((".", "_"))}

    def open(self, log: str) -> pa.NativeFile:
        system, place = file_system(self.path)
        return system.open_input_file(f"{place.rstrip('/')}/{log}")

    def ranges(self, log: str, begin: int, end: int, last: bool = False) -> list[FileRange]:
        cuts = [*range(begin, end, self.range), end]
        return [FileRange(log, a, b, last and b == end) for a, b in zip(cuts, cuts[1:])]

    def lines(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        with self.open(part.log) as file:
            at = _line_start(file, part.begin)
            file.seek(at)
            rest, starts, values = b"", [], []
            read = at
            while read < part.end:
                block = file.read(min(BLOCK, part.end - read))
                if not block:
                    break
                read += len(block)
                *whole, rest = (rest + block).split(b"\n")
                for line in whole:
                    starts.append(at)
                    values.append(line.decode(errors="replace"))
                    at += len(line) + 1
                if len(starts) >= 10_000:
                    yield _batch(part.log, starts, values)
                    starts, values = [], []
            if part.last and rest:
                starts.append(at)
                values.append(rest.decode(errors="replace"))
            if starts:
                yield _batch(part.log, starts, values)


def _batch(log: str, starts: list[int], values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([log] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(values, pa.string())],
        names=["log", "pos", "value"])


def _line_start(file: pa.NativeFile, at: int, lines: int = 0) -> int:
    """Where the line begins that holds the byte ``at``, or the one so many lines before it."""
    wanted = lines + 1
    while at > 0:
        begin = max(0, at - (64 << 10))
        file.seek(begin)
        block = file.read(at - begin)
        end = len(block)
        while (found := block.rfind(b"\n", 0, end)) >= 0:
            wanted -= 1
            if not wanted:
                return begin + found + 1
            end = found
        at = begin
    return 0


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        """Empty, or with the option ``tail`` the places from which on each file has so many lines."""
        if self.folder.tail < 0:
            return {}
        offset = {}
        for log, size in self.folder.sizes().items():
            with self.folder.open(log) as file:
                offset[log] = _line_start(file, size, self.folder.tail)
        return offset

    def latestOffset(self) -> dict:
        return self.folder.sizes()

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        out: list[FileRange] = []
        for log, size in sorted(end.items()):
            begin = start.get(log, 0)
            out += self.folder.ranges(log, begin if begin <= size else 0, size)
        return out

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition)


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = _Folder(options)

    def partitions(self) -> list[FileRange]:
        return [r for log, size in sorted(self.folder.sizes().items()) for r in self.folder.ranges(log, 0, size, last=True)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition)


class LogTail(DataSource):
    """Format ``log_tail``: a folder of log files, as a table or as a stream.

    Options: ``path``, ``suffix`` of the file names, ``tail`` (a new stream begins so many lines before the end of
    the files that are there), ``rangeBytes`` that one task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)
