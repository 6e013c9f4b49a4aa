"""Listings of folders as a Spark data source, for batches and streams, and contents of listed files.

A stream's offset is the time of a round, and each round lists the roots whole: a mark by time of change would miss files
that were moved in with an old one. What a round means for a file is decided by who keeps its state (streaming/). A
batch that is run again after a failure lists anew, so it may hold later marks than the first run of it.

Tasks walk the folders, one directory at a time; the driver learns the names of a root's own subfolders at most.
Local paths need no scheme; others are opened by pyarrow's file systems.
"""

from __future__ import annotations

import datetime
import json
import os
import time
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "root string, path string, length long, modified timestamp, sha string, error string"
#: A listing that is not whole, a link that leaves its root, a file that changed between its listing and the end of its reading.
INCOMPLETE, OUTSIDE, CHANGED, TOO_LARGE = "scan_incomplete", "outside_root", "changed_while_reading", "too_large"
#: Bytes of content that go to the JVM at once, where files are smaller.
FRAME = 8 << 20


def opened(root: str) -> tuple[arrow_fs.FileSystem, str, bool]:
    """The file system of a root, its path there, and whether it is local."""
    if "://" not in root or root.startswith("file://"):
        return arrow_fs.LocalFileSystem(), root.removeprefix("file://").rstrip("/") or "/", True
    system, path = arrow_fs.FileSystem.from_uri(root)
    return system, path.rstrip("/"), False


def mark(info: arrow_fs.FileInfo) -> str:
    return f"{info.size}:{info.mtime_ns}"


class _Part(InputPartition):
    """A folder below a root: whole, or its own files only; or a root that can't be listed."""

    def __init__(self, root: str, inside: str, deep: bool, error: str | None = None):
        self.root, self.inside, self.deep, self.error = root, inside, deep, error


def _parts(roots: list[str]) -> list[_Part]:
    found = []
    for root in roots:
        system, base, local = opened(root)
        try:
            if local:
                with os.scandir(base) as entries:
                    inner = [e.name for e in entries if e.is_dir(follow_symlinks=False)]
            else:
                inner = [i.base_name for i in system.get_file_info(arrow_fs.FileSelector(base)) if i.type == arrow_fs.FileType.Directory]
        except OSError:
            found.append(_Part(root, "", False, INCOMPLETE))
            continue
        found += [_Part(root, "", False), *(_Part(root, name, True) for name in sorted(inner))]
    return found


def _walk(part: _Part) -> Iterator[tuple]:
    """Rows of SCHEMA. Links to folders are not followed; a folder that can't be read is a row of its root's error."""
    if part.error:
        yield part.root, None, None, None, None, part.error
        return
    system, base, local = opened(part.root)
    home, folders = os.path.realpath(base) if local else "", [f"{base}/{part.inside}".rstrip("/")]
    while folders:
        try:
            entries = system.get_file_info(arrow_fs.FileSelector(folders.pop()))
        except OSError:
            yield part.root, None, None, None, None, INCOMPLETE
            continue
        for info in entries:
            if info.type == arrow_fs.FileType.Directory:
                if part.deep and not (local and os.path.islink(info.path)):
                    folders.append(info.path)
            elif info.type == arrow_fs.FileType.File:
                inside = local and os.path.islink(info.path) and not os.path.realpath(info.path).startswith(home.rstrip("/") + "/")
                changed = datetime.datetime.fromtimestamp(info.mtime_ns // 1000 / 1e6, datetime.timezone.utc)
                yield part.root, info.path[len(base) :].lstrip("/"), info.size, changed, mark(info), OUTSIDE if inside else None


class _Once(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self):
        return _parts(self.roots)

    def read(self, partition):
        return _walk(partition)


class _Rounds(DataSourceStreamReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def initialOffset(self):
        return {"round": 0}

    def latestOffset(self):
        return {"round": time.time_ns() // 1000}

    def partitions(self, start, end):
        return _parts(self.roots)

    def read(self, partition):
        return _walk(partition)


class Listing(DataSource):
    """spark.read or spark.readStream, .format("fathom_listing").option("roots", '["/a", "/b"]').load(), after spark.dataSource.register(Listing)."""

    @classmethod
    def name(cls):
        return "fathom_listing"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Once(json.loads(self.options["roots"]))

    def streamReader(self, schema):
        return _Rounds(json.loads(self.options["roots"]))


def listed(spark: SparkSession, roots: list[str]) -> DataFrame:
    """One listing of some roots."""
    spark.dataSource.register(Listing)
    return spark.read.format("fathom_listing").option("roots", json.dumps(roots)).load()


def rounds(spark: SparkSession, roots: list[str]) -> DataFrame:
    """A stream of listings: all roots at each trigger."""
    spark.dataSource.register(Listing)
    return spark.readStream.format("fathom_listing").option("roots", json.dumps(roots)).load()


def contents(files: DataFrame, most_bytes: int) -> DataFrame:
    """(path, content, problem) of listed files (root, path, length, sha), read where the rows lie; a file with a problem has no content.

    A file counts as read only if its length and time are those of the listing before and after: otherwise it may be half old, half new.
    """

    def read(frames):
        rows, held = [], 0
        for frame in frames:
            for root, path, length, sha in zip(frame["root"], frame["path"], frame["length"], frame["sha"], strict=True):
                system, base, _ = opened(root)
                raw, problem = None, TOO_LARGE if length > most_bytes else None
                try:
                    if problem is None:
                        name = f"{base}/{path}"
                        with system.open_input_stream(name) as f:
                            raw = f.read(most_bytes + 1)
                        if len(raw) != length or mark(system.get_file_info(name)) != sha:
                            raw, problem = None, CHANGED
                except OSError as error:
                    raw, problem = None, f"not_read_{type(error).__name__}"
                rows.append((path, raw, problem))
                held += len(raw or b"")
                if held >= FRAME:
                    yield pd.DataFrame(rows, columns=["path", "content", "problem"])
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "content", "problem"])

    return files.select("root", "path", "length", "sha").mapInPandas(read, "path string, content binary, problem string")
