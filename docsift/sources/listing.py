"""Listing of files by executors, with empty files and folders that can't be read.

Spark's own file scan leaves out files of zero bytes. Here folders are listed by tasks: the driver goes down only until there
are enough folders to share, and each task walks what is below its own. No content is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import FILE_TYPES
from .files import file_info
from .payloads import opened

FORMAT = "listing"
ENTRY = "path string, length bigint, error string"
#: Folders that the driver finds before it deals them out.
SHARED_FOLDERS = 256


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool  # with what is below it, or only its own files


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.least = options["path"], int(options.get("sharedfolders", SHARED_FOLDERS))

    def partitions(self) -> list[Folder]:
        """Folders to walk, and the folders above them whose own files are listed alone."""
        from pyarrow import fs

        store, path = opened(self.path)
        if store.get_file_info(path).type != fs.FileType.Directory:
            raise FileNotFoundError(self.path)
        above: list[Folder] = []
        level = [path]
        while level and len(level) < self.least:
            below: list[str] = []
            for folder in level:
                above.append(Folder(folder, False))
                below += [i.path for i in _entries(store, folder)[0] if i.type == fs.FileType.Directory]
            level = below
        return above + [Folder(folder, True) for folder in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = opened(self.path)
        waiting = [partition.path]
        while waiting:
            folder = waiting.pop()
            found, error = _entries(store, folder)
            if error:
                yield folder, None, error
            for info in found:
                if info.type == fs.FileType.File:
                    yield info.path, info.size, None
                elif info.type == fs.FileType.Directory and partition.deep:
                    waiting.append(info.path)


def _entries(store, folder: str) -> tuple[list, str | None]:
    from pyarrow import fs

    try:
        return store.get_file_info(fs.FileSelector(folder)), None
    except OSError as error:
        return [], f"{type(error).__name__}: {error}"


class ListingSource(DataSource):
    """``path, length, error`` of every file below a folder; a folder that can't be read is a row with its error."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> ListingReader:
        return ListingReader({k.lower(): v for k, v in self.options.items()})


def list_entries(spark: SparkSession, folder: str, shared_folders: int = SHARED_FOLDERS) -> DataFrame:
    spark.dataSource.register(ListingSource)
    return spark.read.format(FORMAT).option("sharedFolders", shared_folders).load(folder)


def list_all_files(spark: SparkSession, folder: str, file_type: str = "txt") -> tuple[DataFrame, DataFrame]:
    """``path, filename, doc_id, size_kb`` of one file type at any depth, in path order and with empty files; and ``path, error`` of folders that can't be read."""
    if file_type not in FILE_TYPES:
        raise ValueError(f"unknown file type {file_type!r}; choose one of {', '.join(FILE_TYPES)}")
    entries = list_entries(spark, folder)
    files = entries.filter(F.col("error").isNull() & F.col("path").endswith(f".{file_type}"))
    return file_info(files.select("path", "length")).orderBy("path"), entries.filter("error IS NOT NULL").select("path", "error")
