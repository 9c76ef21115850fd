"""Patch files as a data source of their own: ``spark.read.format("patches")``.

Spark's file sources hide every name that starts with ``_``; here only names
that start with a period are hidden.  Files of about ``partitionBytes`` bytes
make a partition, so many small patches do not make many tasks, and a bound on
``n_bytes`` is applied to the listing, before any file is read.  As a stream, new
files come in the order of time and name.  Paths are local or any
that pyarrow's file systems know (``hdfs://``, ``s3://``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)

SCHEMA = "path string, repo string, patch_id string, label_dir string, text string, n_bytes long"


@dataclass
class Files(InputPartition):
    """Paths and sizes."""

    files: list[tuple[str, int]]

    def __init__(self, files):
        super().__init__(0)
        self.files = files


class _Folder:
    """What both readers know of the folder."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.depth = int(options.get("depth", "-1"))
        self.part = int(options.get("partitionBytes", 64 << 20))
        limit = options.get("maxFileKb")
        self.bounds = [lambda n: n <= int(limit) * 1024] if limit is not None else []

    def system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def listed(self) -> list[tuple[int, str, int]]:
        """Time, path and size of every wanted file, ascending; folder by folder, without the hidden ones."""
        system, top = self.system()
        found, todo = [], [(top.rstrip("/") or "/", 0)]
        while todo:
            folder, depth = todo.pop()
            for f in system.get_file_info(fs.FileSelector(folder)):
                if f.base_name.startswith("."):
                    continue
                if f.type == fs.FileType.Directory and self.recursive and depth != self.depth:
                    todo.append((f.path, depth + 1))
                elif f.type == fs.FileType.File and f.base_name.endswith(".diff") and depth >= self.depth and all(ok(f.size) for ok in self.bounds):
                    found.append((f.mtime_ns or 0, f.path, f.size))
        return sorted(found)

    def split(self, listed: list[tuple[int, str, int]]) -> list[Files]:
        parts, now, size = [], [], 0
        for _, path, n in listed:
            if now and size + n > self.part:
                parts.append(Files(now))
                now, size = [], 0
            now.append((path, n))
            size += n + 4096  # opening a file costs about as much as reading so many bytes
        return [*parts, Files(now)] if now else parts

    def rows(self, part: Files) -> Iterator[tuple]:
        system, _ = self.system()
        for path, n in part.files:
            with system.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            parent, name = path.rsplit("/", 2)[-2:] if path.count("/") > 1 else ("", path.rsplit("/", 1)[-1])
            yield path, parent, name[: -len(".diff")], parent, text, n


class PatchReader(DataSourceReader):
    def __init__(self, options):
        self.folder = _Folder(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of ``n_bytes`` are kept here; Spark applies the others."""
        tests = {
            LessThan: lambda v: lambda n: n < v, LessThanOrEqual: lambda v: lambda n: n <= v, EqualTo: lambda v: lambda n: n == v,
            GreaterThan: lambda v: lambda n: n > v, GreaterThanOrEqual: lambda v: lambda n: n >= v,
        }
        for f in filters:
            if type(f) in tests and f.attribute == ("n_bytes",):
                self.folder.bounds.append(tests[type(f)](f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        # Spark asks for one partition at least.
        return self.folder.split(self.folder.listed()) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.folder.rows(partition)


class PatchStreamReader(DataSourceStreamReader):
    """The offset is the time and path of the last file that was given out."""

    def __init__(self, options):
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"time": "-1", "path": ""}

    def latestOffset(self) -> dict:
        listed = self.folder.listed()
        return {"time": str(listed[-1][0]), "path": listed[-1][1]} if listed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((int(o["time"]), o["path"]) for o in (start, end))
        return self.folder.split([f for f in self.folder.listed() if low < f[:2] <= high])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.folder.rows(partition)


class PatchSource(DataSource):
    """Options: ``path``, ``recursive`` (true), ``depth`` (only files so many folders down; -1: all), ``maxFileKb``, ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "patches"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PatchReader:
        return PatchReader(self.options)

    def streamReader(self, schema) -> PatchStreamReader:
        return PatchStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``format("patches")`` known to the session and lets it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PatchSource)


def read_patches(spark: SparkSession, folder: str, **options) -> DataFrame:
    """``path, repo, patch_id, label_dir, text, n_bytes`` of every ``*.diff`` below ``folder`` but hidden ones.

    An empty folder gives no rows; an empty file a row with an empty text;
    bytes that are not UTF-8 become the replacement character; a missing
    folder fails.
    """
    register(spark)
    return spark.read.format("patches").options(**options).load(folder)


def read_dataset(spark: SparkSession, dataset: str, **options) -> DataFrame:
    """The patches directly in the repository folders of a dataset, as ``scan_dataset`` but with ``_`` names."""
    return read_patches(spark, dataset, depth=1, **options)


# Workers get this module's classes by value, so they need not find the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
