"""Growing text logs as a data source, batch and stream: one row per line with the byte it begins at.

``seq`` is that byte, so it rises along a file, never changes once a line is written, and needs no pass over what
stands before: files are cut into byte ranges, and a range reads the lines that begin in it. The stream's offsets
are the ends of the complete lines seen so far, by file; it goes on from there after a stop in the middle of a file.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from panelflow.session import qualified
from panelflow.sources.files import file_system

RANGE_BYTES, BATCH_BYTES, STEP_BYTES = 64 << 20, 4 << 20, 64 << 10
LINES = "path string, seq bigint, line string"
_FIELDS = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("line", pa.string())])


@dataclass
class LineRange(InputPartition):
    """Lines that begin at ``begin`` or later, before ``stop``."""

    path: str
    begin: int
    stop: int


def _sizes(uri: str) -> dict[str, int]:
    """Bytes of the file, or of the files of the folder whose names do not begin with a dot or an underscore."""
    from pyarrow import fs

    system, path = file_system(uri)
    found = system.get_file_info(path)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if found.type == fs.FileType.File:
        return {"": found.size}
    entries = system.get_file_info(fs.FileSelector(path))
    return {e.base_name: e.size for e in sorted(entries, key=lambda e: e.base_name) if e.type == fs.FileType.File and e.base_name[0] not in "._"}


def _cut(name: str, begin: int, stop: int, step: int) -> list[LineRange]:
    return [LineRange(name, at, min(at + step, stop)) for at in range(begin, stop, step)]


def _read(uri: str, part: LineRange) -> Iterator[pa.RecordBatch]:
    if part.begin >= part.stop:
        return
    system, path = file_system(uri)
    shown = f"{uri}/{part.path}" if part.path else uri
    made: list[tuple] = []
    held = 0
    with io.BufferedReader(system.open_input_file(f"{path}/{part.path}" if part.path else path), 1 << 20) as file:
        if part.begin:  # the line that the byte before belongs to is another range's
            file.seek(part.begin - 1)
            at = part.begin - 1 + len(file.readline())
        else:
            at = 0
        while at < part.stop and (line := file.readline()):
            made.append((shown, at, line.removesuffix(b"\n").removesuffix(b"\r").decode(errors="replace")))
            at, held = at + len(line), held + len(line)
            if held >= BATCH_BYTES:
                yield _batch(made)
                made, held = [], 0
    if made:
        yield _batch(made)


def _batch(made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _FIELDS)], schema=_FIELDS)


def _complete(uri: str, name: str, size: int, known: int) -> int:
    """End of the last complete line: the byte after the last line feed, or ``known`` if none follows it."""
    system, path = file_system(uri)
    with system.open_input_file(f"{path}/{name}" if name else path) as file:
        stop = size
        while stop > known:
            begin = max(known, stop - STEP_BYTES)
            file.seek(begin)
            found = file.read(stop - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            stop = begin
    return known


class LogReader(DataSourceReader):
    def __init__(self, uri: str, step: int) -> None:
        self.uri, self.step = uri, step

    def partitions(self) -> list[LineRange]:
        return [r for name, size in _sizes(self.uri).items() for r in _cut(name, 0, size, self.step)] or [LineRange("", 0, 0)]

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        return _read(self.uri, partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, uri: str, step: int) -> None:
        self.uri, self.step, self.known = uri, step, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.known = {name: _complete(self.uri, name, size, self.known.get(name, 0)) for name, size in _sizes(self.uri).items()}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        return [r for name, stop in sorted(end.items()) for r in _cut(name, start.get(name, 0), stop, self.step)]

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        return _read(self.uri, partition)


class LogFiles(DataSource):
    """``path``: a log file or a folder of them, as a full URI; ``range_bytes``: what one task reads."""

    @classmethod
    def name(cls) -> str:
        return "log_files"

    def schema(self) -> str:
        return LINES

    def _made(self, kind):
        return kind(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def reader(self, schema) -> LogReader:
        return self._made(LogReader)

    def streamReader(self, schema) -> LogStreamReader:
        return self._made(LogStreamReader)


def scan_log(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, seq, line) of the log file, or of each file of the folder; a last line without line feed counts.

    Lines end with a line feed, a carriage return before it goes; bytes that are not UTF-8 become replacement
    signs. Empty files give no rows. (path, seq) is unique.
    """
    spark.dataSource.register(LogFiles)
    return spark.read.format("log_files").option("range_bytes", range_bytes).load(qualified(spark, path))


def stream_log(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same rows as a stream over files that only grow; a line comes once its line feed is written."""
    spark.dataSource.register(LogFiles)
    return spark.readStream.format("log_files").option("range_bytes", range_bytes).load(qualified(spark, path))
