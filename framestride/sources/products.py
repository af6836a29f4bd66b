"""Files as products of a job: all of them become current at once, or none does.

``df.write.format("products").mode("overwrite").save(folder)`` writes rows ``name, content`` (in each task
as they come, one at a time) and ``spark.read.format("products").load(folder)`` reads them back. A write
goes to a version of its own, ``v-<id>``: files and, for each task, a list of them. Commit writes the
lists' names into ``CURRENT`` by one rename and then removes the version before, a failed job removes its
own; nothing else in the folder is touched. Files of lost or repeated attempts are on no committed list
and are never read. ``append`` keeps the lists of the version before, so both are read.

A name may contain ``/`` for folders below; names that are null, empty, absolute or climb up, and names written twice by
one task, fail the job. Null content is an empty file. No rows make a version without files. Two jobs
that write one folder at a time: the later commit wins.

This module imports nothing of the package, so that workers that plan a scan need not find it.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CURRENT = "CURRENT"
SCHEMA = "name string, content binary, bytes long"
ROWS = pa.schema([("name", pa.string()), ("content", pa.binary()), ("bytes", pa.int64())])
BATCH_BYTES = 16 << 20


def storage(path: str) -> tuple[pafs.FileSystem, str]:
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, inner.rstrip("/")


def current(fs: pafs.FileSystem, folder: str) -> dict:
    """``versions`` (folders) and ``lists`` (files within the folder) that are valid now."""
    if fs.get_file_info(f"{folder}/{CURRENT}").type != pafs.FileType.File:
        return {"versions": [], "lists": []}
    with fs.open_input_stream(f"{folder}/{CURRENT}", compression=None) as f:
        return json.loads(f.read())


def put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """A whole file under its name, or none."""
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)


@dataclass
class Listed(WriterCommitMessage):
    path: str | None


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.version = f"v-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Listed:
        fs, folder = storage(self.path)
        attempt = uuid.uuid4().hex
        names: dict[str, str] = {}
        for b in iterator:
            for i in range(b.num_rows):
                name, content = b.column("name")[i].as_py(), b.column("content")[i].as_py()
                if not name or name.startswith("/") or any(p in ("", ".", "..") for p in name.split("/")):
                    raise ValueError(f"{name!r} is no name of a file")
                if name in names:
                    raise ValueError(f"{name} is written twice")
                # a file of its own for each attempt: a repeat never meets another's files
                head, _, last = name.rpartition("/")
                names[name] = f"{self.version}/{attempt}/{head + '/' if head else ''}{last}"
                put(fs, f"{folder}/{names[name]}", content or b"")
        if not names:
            return Listed(None)
        where = f"{self.version}/_lists/{attempt}.json"
        put(fs, f"{folder}/{where}", json.dumps(names, ensure_ascii=False).encode())
        return Listed(where)

    def commit(self, messages: list[Listed | None]) -> None:
        fs, folder = storage(self.path)
        before = current(fs, folder)
        now = {"versions": [self.version], "lists": sorted(m.path for m in messages if m is not None and m.path)}
        if not self.overwrite:
            now = {k: before[k] + now[k] for k in now}
        put(fs, f"{folder}/{CURRENT}", json.dumps(now).encode())
        if self.overwrite:
            for old in before["versions"]:
                if fs.get_file_info(f"{folder}/{old}").type == pafs.FileType.Directory:
                    fs.delete_dir(f"{folder}/{old}")

    def abort(self, messages: list[Listed | None]) -> None:
        fs, folder = storage(self.path)
        if fs.get_file_info(f"{folder}/{self.version}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{folder}/{self.version}")


@dataclass
class Some(InputPartition):
    """A task's list, and which of its files to read."""

    path: str
    part: int
    parts: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        fs, folder = storage(self.path)
        return [Some(x, i, self.split) for x in current(fs, folder)["lists"] for i in range(self.split)]

    def read(self, part: Some) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        fs, folder = storage(self.path)
        with fs.open_input_stream(f"{folder}/{part.path}", compression=None) as f:
            names = sorted(json.loads(f.read()).items())[part.part :: part.parts]
        held, size = [], 0
        for name, where in names:
            with fs.open_input_stream(f"{folder}/{where}", compression=None) as f:
                content = f.read()
            held.append({"name": name, "content": content, "bytes": len(content)})
            size += len(content)
            if size >= BATCH_BYTES or len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, schema=ROWS)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=ROWS)


class Products(DataSource):
    @classmethod
    def name(cls) -> str:
        return "products"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split", 1)))

    def writer(self, schema, overwrite: bool) -> Writer:
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if kinds.get("name") != "string" or kinds.get("content") != "binary":
            raise ValueError(f"products are rows name string, content binary; not {kinds}")
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``products`` known to the session."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Products)
