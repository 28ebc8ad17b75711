"""Input files as rows: size, digest, header and number of records, each file read in bounded pieces by a task of its own.

A Python data source: ``spark.read.format("file_report").load(path)`` after ``register``. The driver lists the files; each is
one input partition, read where the task runs through Arrow's file systems (local, HDFS, S3, GCS by the path's scheme). No
file is ever held as a whole, so its size bounds nothing.
"""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "file_report"
# Bytes of a file that are in memory at a time.
PIECE = 8 << 20
COLUMNS = "path string, file string, bytes long, sha256 string, kind string, header array<string>, records long"
KINDS = {".parquet": "parquet", ".csv": "csv", ".tsv": "csv", ".json": "lines", ".jsonl": "lines"}


@dataclass
class OneFile(InputPartition):
    path: str
    bytes: int


def file_system(path: str):
    """Arrow file system of a path and the path inside it; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Records:
    """Counts the records of delimited text that comes in pieces; line ends inside quotes end no record."""

    def __init__(self, quotes: bool):
        self.quotes, self.inside, self.ends, self.open, self.first = quotes, False, 0, False, b""

    def add(self, piece: bytes) -> None:
        if not self.ends:
            self.first += piece if not self.first else piece[:PIECE]
        for i, part in enumerate(piece.split(b'"') if self.quotes else [piece]):
            self.inside ^= self.quotes and i > 0
            if not self.inside:
                self.ends += part.count(b"\n")
        self.open = self.open if not piece else not piece.endswith(b"\n") or self.inside

    @property
    def count(self) -> int:
        return self.ends + self.open


def read_file(path: str, size: int) -> tuple:
    """One row of ``COLUMNS`` after the path: a Parquet footer or the text itself tells header and records, else null."""
    import pyarrow.parquet as pq

    system, inner = file_system(path)
    name = inner.rsplit("/", 1)[-1]
    kind = KINDS.get(name[name.rfind("."):].lower(), "other") if "." in name else "other"
    digest, length, records = hashlib.sha256(), 0, _Records(kind == "csv")
    with system.open_input_stream(inner) as stream:
        while piece := stream.read(PIECE):
            digest.update(piece)
            length += len(piece)
            if kind in ("csv", "lines"):
                records.add(piece)
    header = count = None
    if kind == "parquet":
        with system.open_input_file(inner) as opened:
            footer = pq.read_metadata(opened)
            header, count = footer.schema.to_arrow_schema().names, footer.num_rows
    elif kind == "csv":
        delimiter = "\t" if name.lower().endswith(".tsv") else ","
        header = next(csv.reader(io.StringIO(records.first.decode("utf-8-sig", "replace")), delimiter=delimiter), [])
        count = max(0, records.count - 1)
    elif kind == "lines":
        count = records.count
    return path, name, length, digest.hexdigest(), kind, header, count


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[OneFile]:
        from pyarrow import fs

        system, inner = file_system(self.path)
        info = system.get_file_info(inner)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        prefix = self.path[:len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        files = [OneFile(prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        return sorted(files, key=lambda f: f.path)

    def read(self, partition: OneFile) -> Iterator[tuple]:
        if partition is not None:  # an empty folder has one empty partition
            yield read_file(partition.path, partition.bytes)


class FileReport(DataSource):
    """Every file below the ``path`` option, hidden ones left out."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """One row per file at or below ``path``: path, file, bytes, sha256, kind, header, records.

    ``header`` and ``records`` come from the footer of a Parquet file, or from the first record and the record ends of CSV
    (quoted line ends do not count); JSON lines have records only, other files neither. An empty file has no records and,
    as CSV, an empty header; a folder without files gives no rows, a path that does not exist raises.
    """
    spark.dataSource.register(FileReport)
    return spark.read.format(FORMAT).load(path)


def table_report(report: DataFrame, path: str) -> DataFrame:
    """One row per table of the folder ``path``: table, files, bytes, kind, header, records.

    A table is a file right in the folder, or a sub-folder with all files below it. Kind and header are those of its first
    file by path; records are null if a file of the table has none to tell.
    """
    base = file_system(path)[1].rstrip("/") + "/"
    inner = F.substring("path", F.locate(base, F.col("path")) + len(base), F.length("path"))
    counted = F.when(F.count("records") == F.count(F.lit(1)), F.sum("records"))
    return report.groupBy(F.substring_index(inner, "/", 1).alias("table")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.min_by("kind", "path").alias("kind"),
        F.min_by("header", "path").alias("header"), counted.alias("records"),
    )
