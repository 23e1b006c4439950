"""Zip archives as tables: list, read and rebuild, entry by entry.

Listing opens only the directory at the end of each file. Reading is planned per
entry, so one huge archive is read by many tasks. File access goes through the file
system the path names, so the same code runs on local, HDFS and object stores.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.session import qualified
from panelflow.sources.files import file_system

LISTING = (
    "archive string, entry_index bigint, name string, is_dir boolean, n_bytes bigint, date_time array<int>, "
    "compress_type int, external_attr bigint, entry_comment binary, extra binary, create_system int, archive_comment binary, problem string"
)
_META = ("date_time", "compress_type", "external_attr", "entry_comment", "extra", "create_system")


def _open(path: str) -> zipfile.ZipFile:
    system, local = file_system(path)
    return zipfile.ZipFile(system.open_input_file(local))


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in LISTING.split(", ")]
    for batch in batches:
        for path in batch["path"]:
            try:
                with _open(path) as archive:
                    rows = [
                        (path, i, e.filename, e.is_dir(), e.file_size, list(e.date_time), e.compress_type, e.external_attr,
                         e.comment, e.extra, e.create_system, archive.comment, None)
                        for i, e in enumerate(archive.infolist())
                    ]
            except (zipfile.BadZipFile, ValueError, EOFError, NotImplementedError) as error:  # also what a too short file raises
                rows = [(path, None, None, None, None, None, None, None, None, None, None, None, f"not a zip: {error}")]
            for start in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[start:start + 10_000], columns=columns)


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of the zip files (``.zip`` in any case) under ``path``, in archive order, without its bytes.

    A file that is no archive gives one row with ``problem``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").option(
        "recursiveFileLookup", "true").load(path).select("path")
    return files.mapInPandas(_list, schema=LISTING)


BATCH_BYTES, BATCH_ENTRIES = 4 << 20, 1024  # of what is read before it is handed over


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    opened, archive, held, n_bytes = None, None, [], 0

    def full() -> pd.DataFrame:
        return pd.DataFrame(held, columns=["archive", "entry_index", "data", "read_problem"])

    try:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.archive != opened:
                    if archive is not None:
                        archive.close()
                    archive, opened = _open(row.archive), row.archive
                    listed = archive.infolist()
                info, data, problem = listed[row.entry_index], b"", None
                try:
                    data = b"" if info.is_dir() else archive.read(info)
                except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, ValueError) as error:  # damaged, encrypted, unknown method
                    data, problem = None, f"{type(error).__name__}: {error}"
                held.append((row.archive, row.entry_index, data, problem))
                n_bytes += len(data or b"")
                if n_bytes >= BATCH_BYTES or len(held) >= BATCH_ENTRIES:
                    yield full()
                    held, n_bytes = [], 0
        if held:
            yield full()
    finally:
        if archive is not None:
            archive.close()


def _read_tasks(spark: SparkSession) -> int:
    told = spark.conf.get("spark.sql.shuffle.partitions")
    return max(spark.sparkContext.defaultParallelism, int(told) if told.isdigit() else 1)


def read_entries(entries: DataFrame) -> DataFrame:
    """(archive, entry_index) -> ``data``; the entries decide the tasks, not the archives.

    An entry that cannot be read has no data but a ``read_problem``. Names are few bytes whatever stands behind them,
    so the number of tasks is given: by size alone, adaptive execution would leave all reading to one. Ranges, so that a
    task opens few archives.
    """
    wanted = entries.where("entry_index is not null").select("archive", "entry_index").repartitionByRange(
        _read_tasks(entries.sparkSession), "archive", "entry_index")
    return wanted.sortWithinPartitions("archive", "entry_index").mapInPandas(
        _read, schema="archive string, entry_index bigint, data binary, read_problem string")


def _entry(row) -> zipfile.ZipInfo:
    info = zipfile.ZipInfo(row.name, tuple(row.date_time) if row.date_time is not None else (1980, 1, 1, 0, 0, 0))
    for field, kind in (("compress_type", int), ("external_attr", int), ("create_system", int)):
        value = getattr(row, field)
        if value is not None and not pd.isna(value):
            setattr(info, field, kind(value))
    info.comment, info.extra = row.entry_comment or b"", row.extra or b""
    return info


class _Writer:
    """One archive under construction; renamed into place only when complete."""

    def __init__(self, folder: str, archive: str):
        self.system, folder = file_system(folder)
        self.target = posixpath.join(folder, archive)
        below, name = posixpath.split(self.target)
        if below != folder:
            self.system.create_dir(below, recursive=True)
        self.partial = posixpath.join(below, f".{name}.{uuid.uuid4().hex}.partial")
        self.stream = self.system.open_output_stream(self.partial)
        self.zip = zipfile.ZipFile(io.BufferedWriter(_Raw(self.stream)), "w")
        self.count = 0

    def add(self, row) -> None:
        self.zip.comment = row.archive_comment or b""
        self.zip.writestr(_entry(row), row.data if row.data is not None else b"")
        self.count += 1

    def close(self) -> int:
        out = self.zip.fp
        self.zip.close()
        out.flush()
        self.stream.close()
        self.system.move(self.partial, self.target)
        return self.count

    def abandon(self) -> None:
        self.stream.close()
        self.system.delete_file(self.partial)


class _Raw(io.RawIOBase):
    """A write-only stream as the zip writer wants it (no seeking)."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)


def write_archives(entries: DataFrame, folder: str) -> DataFrame:
    """Rebuild archives from (archive, entry_index, name, data and the listing's metadata).

    Entries stream in order into one file per archive, whose name may have folders in front; a failed or
    repeated task leaves the finished file as it was. Returns (archive, n_entries, problem): an archive with an
    entry that has a ``read_problem`` is not written. Nothing is written before an action runs on the result.
    """
    folder = qualified(entries.sparkSession, folder)
    for name, kind in (("date_time", "array<int>"), ("compress_type", "int"), ("external_attr", "bigint"),
                       ("entry_comment", "binary"), ("extra", "binary"), ("create_system", "int"), ("archive_comment", "binary"), ("read_problem", "string")):
        if name not in entries.columns:
            entries = entries.withColumn(name, F.lit(None).cast(kind))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, writer, finished, bad = None, None, [], False
        try:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    if row.archive != current:
                        if writer is not None:
                            finished.append((current, writer.close(), None))
                            writer = None
                        current, writer, bad = row.archive, _Writer(folder, row.archive), False
                    if bad:
                        continue
                    if row.read_problem is not None:
                        writer.abandon()
                        writer, bad = None, True
                        finished.append((current, None, f"{row.name}: {row.read_problem}"))
                        continue
                    writer.add(row)
            if writer is not None:
                finished.append((current, writer.close(), None))
                writer = None
        finally:
            if writer is not None:
                writer.abandon()
        if finished:
            yield pd.DataFrame(finished, columns=["archive", "n_entries", "problem"]).astype({"n_entries": "Int64"})

    ordered = entries.select("archive", "entry_index", "name", "data", *_META, "archive_comment", "read_problem")
    return ordered.repartition("archive").sortWithinPartitions("archive", "entry_index").mapInPandas(
        write, schema="archive string, n_entries bigint, problem string")


def make_folder(spark: SparkSession, folder: str) -> str:
    folder = qualified(spark, folder)
    system, local = file_system(folder)
    system.create_dir(local, recursive=True)
    return folder
