"""Exchange files: a data source that reads JSON payloads and writes result arrays.

``spark.read.format("payloads").load(folder)`` gives the items of all payload files; a file counts as a whole
or not at all. ``results.write.format("payloads").save(folder)`` writes a file for each row of
``name, payload``. Files are opened where tasks run, through Arrow's file systems, so any store that these know
works, and local folders as far as all executors share them.

Writing is committed at the end: tasks write below ``_pending`` in a folder of their own, and when all have
ended the driver moves what they report to its place. It handles names only. A task that is tried again leaves what its first
attempt wrote behind, and a job that fails leaves the folder as it was.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "payloads"
ITEM_ROWS = "name string, pos int, id string, content string, rejected string"
RESULT_ROWS = "name string, payload string"
SUFFIX = ".json"
PENDING = "_pending"

#: Bytes of payloads that one task reads; a larger payload is a task of its own.
TASK_BYTES = 32 << 20

_ID = re.compile(r"[^\W_]+")
_NAME = re.compile(r"[^/\\\x00]+")


def opened(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), posixpath.abspath(path)
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def parse_payload(text: str) -> list[dict]:
    """The items of a payload; an error if it is anything but a list of objects with an alphanumeric id and a content."""
    items = json.loads(text)
    if not isinstance(items, list):
        raise ValueError("not a list")
    for place, item in enumerate(items):
        if not isinstance(item, dict):
            raise ValueError(f"item {place} is no object")
        for key in ("id", "content"):
            if not isinstance(item.get(key), str):
                raise ValueError(f"item {place} has no {key} that is a string")
        if not _ID.fullmatch(item["id"]):
            raise ValueError(f"item {place} has an id that is not alphanumeric")
    return items


@dataclass
class Payloads(InputPartition):
    paths: list[str]


class PayloadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options.get("taskbytes", TASK_BYTES))
        self.strict = options.get("mode", "report") == "strict"

    def partitions(self) -> list[Payloads]:
        from pyarrow import fs

        store, path = opened(self.path)
        infos = [store.get_file_info(path)]
        if infos[0].type == fs.FileType.Directory:
            infos = store.get_file_info(fs.FileSelector(path))
        elif infos[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.endswith(SUFFIX))
        parts: list[Payloads] = []
        room = 0
        for name, size in found:
            if not parts or size > room:
                parts.append(Payloads([]))
                room = self.limit
            parts[-1].paths.append(name)
            room -= size
        return parts or [Payloads([])]

    def read(self, partition: Payloads) -> Iterator[tuple]:
        store, _ = opened(self.path)
        for path in partition.paths:
            name = posixpath.basename(path)[: -len(SUFFIX)]
            try:
                with store.open_input_stream(path) as stream:
                    items = parse_payload(stream.read().decode("utf-8"))
            except (ValueError, RecursionError) as error:
                if self.strict:
                    raise ValueError(f"invalid payload {name}: {error}") from error
                yield name, None, None, None, f"{type(error).__name__}: {error}"
                continue
            for place, item in enumerate(items):
                yield name, place, item["id"], item["content"], None


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class PayloadWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def _pending(self) -> tuple:
        store, path = opened(self.path)
        return store, path, posixpath.join(path, PENDING, self.job)

    def write(self, iterator: Iterator) -> Written:
        store, _, pending = self._pending()
        folder = posixpath.join(pending, uuid.uuid4().hex)
        names: list[str] = []
        store.create_dir(folder, recursive=True)
        for row in iterator:
            if not row["name"] or not _NAME.fullmatch(row["name"]) or row["name"].startswith(("_", ".")):
                raise ValueError(f"no name for a file: {row['name']!r}")
            with store.open_output_stream(posixpath.join(folder, row["name"] + SUFFIX)) as stream:
                stream.write((row["payload"] or "[]").encode("utf-8"))
            names.append(row["name"])
        return Written(folder, names)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, path, pending = self._pending()
        written = [(m.folder, n) for m in messages if m is not None for n in m.names]
        if len({n for _, n in written}) != len(written):
            self.abort(messages)
            raise ValueError("two results have the same name")
        old = {posixpath.basename(i.path) for i in store.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File}
        for folder, name in written:
            store.move(posixpath.join(folder, name + SUFFIX), posixpath.join(path, name + SUFFIX))
        if self.overwrite:
            for name in old - {n + SUFFIX for _, n in written}:
                if name.endswith(SUFFIX):
                    store.delete_file(posixpath.join(path, name))
        store.delete_dir(pending)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, _, pending = self._pending()
        if store.get_file_info(pending).type == fs.FileType.Directory:
            store.delete_dir(pending)


class PayloadSource(DataSource):
    """``name, pos, id, content, rejected`` of payload files; ``rejected`` says why a file has no items.

    Options of reading: ``mode`` is ``report`` (a row for each bad file) or ``strict`` (it fails the job);
    ``taskBytes`` bounds what one task reads.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ITEM_ROWS

    def reader(self, schema) -> PayloadReader:
        return PayloadReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> PayloadWriter:
        return PayloadWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_payloads(spark: SparkSession, folder: str, mode: str = "report", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Items of the payload files of a folder, and the files that were rejected."""
    spark.dataSource.register(PayloadSource)
    return spark.read.format(FORMAT).option("mode", mode).option("taskBytes", task_bytes).load(folder)


def write_payloads(results: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A file for each row of ``name, payload``. Existing files of the same name are replaced; with ``overwrite`` all others go."""
    results.sparkSession.dataSource.register(PayloadSource)
    rows = results.select(F.col("name").cast("string").alias("name"), "payload")
    rows.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(folder)
