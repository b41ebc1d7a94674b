"""Observations of a service that gives them page by page, as a source for batches and streams, and a sink for scores.

A page is a file of JSON lines in a folder `page-<number>` of the service's store. A stream's offset is the number of pages that it has taken,
so a restart goes on with the next page. Scores are written to a staged file by each task and moved into the batch's folder by the commit;
a batch that is run again finds its folder and leaves it as it is, so no score is lost or there twice.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType, TimestampType


def _store(path: str):
    """(file system, path in it) of a folder; imported in the tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "file://" + path.removeprefix("file:"))


def _children(path: str) -> list[str]:
    from pyarrow import fs

    system, root = _store(path)
    if system.get_file_info(root).type != fs.FileType.Directory:
        return []
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root)))


def pages_of(path: str) -> int:
    """How many pages there are, without a gap, from 0."""
    there = set(_children(path))
    n = 0
    while f"page-{n:06d}" in there:
        n += 1
    return n


@dataclass
class _Page(InputPartition):
    number: int


def _rows(path: str, number: int, schema: StructType) -> Iterator[tuple]:
    system, root = _store(path)
    times = {f.name for f in schema if isinstance(f.dataType, TimestampType)}
    for name in _children(f"{path}/page-{number:06d}"):
        if name.startswith(("_", ".")):
            continue
        with system.open_input_stream(f"{root}/page-{number:06d}/{name}") as stream:
            for line in stream.read().decode().splitlines():
                row = json.loads(line)
                yield tuple(datetime.datetime.fromisoformat(row[f.name]) if f.name in times and row.get(f.name) else row.get(f.name) for f in schema)


class Observations(DataSource):
    """format("observations"), option path: the pages of a store, with the schema that is given; as a stream sink: scores."""

    @classmethod
    def name(cls) -> str:
        return "observations"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[_Page]:
        return [_Page(k) for k in range(pages_of(self.path))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return _rows(self.path, partition.number, self.schema)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": pages_of(self.path)}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        return [_Page(k) for k in range(start["pages"], end["pages"])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return _rows(self.path, partition.number, self.schema)

    def commit(self, end: dict) -> None:
        """Pages stay in the store: the offset alone says what was taken."""


@dataclass
class _Staged(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> _Staged:
        system, root = _store(self.path)
        name, n = f"{uuid.uuid4().hex}.json", 0
        system.create_dir(f"{root}/staged", recursive=True)
        with system.open_output_stream(f"{root}/staged/{name}") as out:
            for row in iterator:
                out.write((json.dumps(row.asDict(), default=str) + "\n").encode())
                n += 1
        return _Staged(name, n)

    def commit(self, messages: list[_Staged | None], batchId: int) -> None:
        from pyarrow import fs

        system, root = _store(self.path)
        done = f"{root}/scores/batch={batchId}"
        if system.get_file_info(f"{done}/_done").type == fs.FileType.File:
            return self.abort(messages, batchId)
        if system.get_file_info(done).type == fs.FileType.Directory:
            system.delete_dir(done)  # of a commit that was cut off
        system.create_dir(done, recursive=True)
        for m in messages:
            if m is not None:
                system.move(f"{root}/staged/{m.name}", f"{done}/{m.name}")
        with system.open_output_stream(f"{done}/_done") as out:
            out.write(b"")

    def abort(self, messages: list[_Staged | None], batchId: int) -> None:
        system, root = _store(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/staged/{m.name}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Observations)
