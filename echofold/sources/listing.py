"""A data source that lists folders in parallel: ``spark.read.format("echofold_files")``.

Options: ``roots``, a JSON list of folders that every executor can reach, and ``recursive`` (true or
false).  A partition is a folder near the top of the tree with all below it, or the files that lie
directly in a folder above those, so tasks share the walk and the driver lists the top levels only.

Links are neither listed nor followed; device and inode tell several names of one file apart from
copies.  A folder or file that can't be read is left out, as one that was removed in the meantime.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "echofold_files"
SCHEMA = "path string, size long, mtime_ticks long, device long, inode long"
#: Partitions at which the driver stops going down, and the entries of one answer.
PARTS, ROWS = 64, 8192


@dataclass
class Folder(InputPartition):
    """A folder to list, with or without what lies below it."""

    path: str
    below: bool


def _inner(path: str) -> list[str]:
    """Folders in a folder, links left out, in order."""
    try:
        with os.scandir(path) as entries:
            return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
    except OSError:
        return []


def split(roots: list[str], recursive: bool, parts: int = PARTS) -> list[Folder]:
    """Folders that together hold everything below ``roots``, each file once: levels are opened until
    there are ``parts`` folders or none is left."""
    if not recursive:
        return [Folder(r, False) for r in dict.fromkeys(roots)]
    top = [r.rstrip("/") or "/" for r in dict.fromkeys(roots)]
    held = [r for r in dict.fromkeys(top) if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in top)]
    done: list[Folder] = []
    while held and len(done) + len(held) < parts:
        done += [Folder(f, False) for f in held]
        held = [inner for f in held for inner in _inner(f)]
    return done + [Folder(f, True) for f in held]


class FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = json.loads(options["roots"])
        self.recursive = options.get("recursive", "true").lower() == "true"

    def partitions(self) -> list[Folder]:
        return split(self.roots, self.recursive)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        rows: list[tuple] = []
        for folder, inner, _ in os.walk(partition.path, followlinks=False):
            inner[:] = sorted(d for d in inner if not os.path.islink(os.path.join(folder, d))) if partition.below else []
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                try:
                    if e.is_file(follow_symlinks=False):
                        s = e.stat(follow_symlinks=False)
                        rows.append((e.path, s.st_size, s.st_mtime_ns // 100, s.st_dev, s.st_ino))
                except OSError:
                    continue
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class FileSource(DataSource):
    """Files below folders, with size, time, device and inode."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:  # noqa: ANN001  a type of pyspark
        return FileReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(FileSource)
