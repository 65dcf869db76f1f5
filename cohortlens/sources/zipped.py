"""Zip archives of CSV files as a data source, read and written.

Reading: the archives' central directories (a seek to the end of each file)
name the members, and every member is a partition of its own.  A task opens
the archive where it lies, inflates its member as a stream and parses it in
blocks, so memory does not depend on the size of member or archive.  Zip64
members and archives of any number of members are fine; a deflated member
can't be split, so one huge member is one task's serial work.

Writing: every task streams its rows into an archive with one member.  The
driver moves the finished archives to their place when all tasks are done; an
attempt that failed leaves only a file below ``_unfinished``.

Paths may have any scheme that Arrow's file systems know (``file``, ``hdfs``,
``s3``, ``gs``), or none.
"""

from __future__ import annotations

import fnmatch
import io
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv as arrow_csv, fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DateType, StringType, StructField, StructType, TimestampNTZType, TimestampType

BLOCK_BYTES = 8 << 20
UNFINISHED = "_unfinished"
# The texts that pandas reads as missing.
MISSING = ["", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
           "NULL", "NaN", "None", "n/a", "nan", "null"]


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def listing(path: str) -> list[str]:
    """Archives at ``path``: a file, a folder of ``.zip`` files, or a pattern in the last part of the path."""
    fs, inside = file_system(path)
    prefix = path[:len(path) - len(inside)] if path.endswith(inside) else ""
    folder, _, last = inside.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        found = fs.get_file_info(arrow_fs.FileSelector(folder or "/"))
        names = [f.path for f in found if f.is_file and fnmatch.fnmatch(f.base_name, last)]
    elif fs.get_file_info(inside).type == arrow_fs.FileType.Directory:
        names = [f.path for f in fs.get_file_info(arrow_fs.FileSelector(inside)) if f.is_file and f.extension == "zip"]
    else:
        names = [inside]
    return [prefix + n for n in sorted(names)]


class Seekable(io.RawIOBase):
    """An Arrow file as zipfile expects one: a place before the start is an OSError."""

    def __init__(self, path: str):
        fs, inside = file_system(path)
        self.file = fs.open_input_file(inside)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        place = offset + (0, self.file.tell(), self.file.size())[whence]
        if place < 0:
            raise OSError("before the start")
        return self.file.seek(place)

    def readinto(self, buffer) -> int:
        got = self.file.read(len(buffer))
        buffer[:len(got)] = got
        return len(got)

    def close(self) -> None:
        self.file.close()
        super().close()


def opened(path: str) -> io.BufferedReader:
    return io.BufferedReader(Seekable(path), 1 << 20)


@dataclass
class Member(InputPartition):
    archive: str
    name: str


def members(archive: str) -> list[Member]:
    with opened(archive) as f, zipfile.ZipFile(f) as z:
        return [Member(archive, i.filename) for i in z.infolist() if not i.is_dir()]


class ZippedCsv(DataSource):
    """Format ``zipped_csv``: all columns are text; a column that a file lacks is null.

    Options: ``path``, ``sep`` (``,``).  Names come from each file's header.
    A record may go over several lines inside quotes, up to ``BLOCK_BYTES``.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZippedCsvReader(schema.names, self.options["path"], self.options.get("sep", ","))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ZippedCsvWriter(self.options["path"], self.options.get("sep", ","), overwrite)


class ZippedCsvReader(DataSourceReader):
    def __init__(self, names: list[str], path: str, sep: str):
        self.names, self.path, self.sep = names, path, sep

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(32) as pool:
            return [m for found in pool.map(members, listing(self.path)) for m in found]

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition where there are no members
            return
        text = pa.schema([(n, pa.string()) for n in self.names])
        convert = arrow_csv.ConvertOptions(column_types=text, include_columns=self.names, include_missing_columns=True,
                                           null_values=MISSING, strings_can_be_null=True)
        with opened(partition.archive) as f, zipfile.ZipFile(f) as z:
            if not z.getinfo(partition.name).file_size:
                return
            with z.open(partition.name) as content:
                yield from arrow_csv.open_csv(
                    content, arrow_csv.ReadOptions(use_threads=False, block_size=BLOCK_BYTES),
                    arrow_csv.ParseOptions(delimiter=self.sep, newlines_in_values=True), convert)


@dataclass
class Archive(WriterCommitMessage):
    path: str
    rows: int


class ZippedCsvWriter(DataSourceArrowWriter):
    def __init__(self, path: str, sep: str, overwrite: bool):
        self.path, self.sep, self.overwrite = path.rstrip("/"), sep, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archive:
        fs, folder = file_system(self.path)
        fs.create_dir(f"{folder}/{UNFINISHED}")
        name, rows = f"{folder}/{UNFINISHED}/{uuid.uuid4().hex}.zip", 0
        with fs.open_output_stream(name) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open("data.csv", "w", force_zip64=True) as content:
                for batch in iterator:
                    options = arrow_csv.WriteOptions(include_header=not rows, delimiter=self.sep)
                    arrow_csv.write_csv(batch, content, options)
                    rows += batch.num_rows
        return Archive(name, rows)

    def commit(self, messages: list[Archive | None]) -> None:
        fs, folder = file_system(self.path)
        if self.overwrite:
            for old in listing(self.path):
                fs.delete_file(file_system(old)[1])
        done = [m for m in messages if m is not None and m.rows]
        for k, m in enumerate(done):
            fs.move(m.path, f"{folder}/part-{k:05d}-{uuid.uuid4().hex}.zip")

    def abort(self, messages: list[Archive | None]) -> None:
        """Files of the attempts stay below ``_unfinished``, where no reader looks."""


def read_zipped_csv(spark: SparkSession, path: str, schema: StructType | str, *, sep: str = ",",
                    timestamp_format: str | None = None, date_format: str | None = None) -> DataFrame:
    """Rows of every CSV member of the zip archives at ``path`` (file, folder or pattern), typed by ``schema``.

    A value that does not fit its type becomes null, dates and timestamps too
    (ISO unless a format is given).
    """
    spark.dataSource.register(ZippedCsv)
    wanted = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    text = StructType([StructField(n, StringType()) for n in wanted.names])
    rows = spark.read.format("zipped_csv").schema(text).option("sep", sep).load(path)

    def typed(f: StructField):
        kind, column = f.dataType, F.col(f"`{f.name}`")
        if isinstance(kind, (TimestampType, TimestampNTZType)) and timestamp_format:
            return F.try_to_timestamp(column, F.lit(timestamp_format)).cast(kind).alias(f.name)
        if isinstance(kind, DateType) and date_format:
            return F.try_to_timestamp(column, F.lit(date_format)).cast(kind).alias(f.name)
        return column.try_cast(kind).alias(f.name)

    return rows.select(*map(typed, wanted.fields))


def write_zipped_csv(df: DataFrame, path: str, *, sep: str = ",", mode: str = "append") -> None:
    """``df`` as one zip archive a task below ``path``, with the text form of every value (null: nothing)."""
    df.sparkSession.dataSource.register(ZippedCsv)
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    text.write.format("zipped_csv").mode(mode).option("sep", sep).save(path)
