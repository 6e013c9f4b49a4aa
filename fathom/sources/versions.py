"""Numbered JSON files and table snapshots on any file system that Spark reaches.

A version exists once its file does. The file appears whole and only if absent, so of two writers one gets
Conflict; data that no version names is never seen.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(ValueError):
    """Another writer has added this version."""


def place(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def working_folder(spark: SparkSession) -> str:
    """Where driver and executors both write: spark.checkpoint.dir; only a local session may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(working_folder, "local"):
        working_folder.local = "file://" + tempfile.mkdtemp(prefix="fathom-work-")
    return working_folder.local


def latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the newest version; (0, {}) if there is none."""
    fs, path = place(spark, folder)
    if not fs.exists(path):
        return 0, {}
    numbers = [int(n[:-5]) for n in (f.getPath().getName() for f in fs.listStatus(path)) if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return 0, {}
    return max(numbers), json.loads(spark.read.text(f"{folder}/{max(numbers):012d}.json", wholetext=True).first().value)


def add(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Adds a version: the file is written under another name and put in its place whole, unless that is taken, so a reader meets
    all of it or none, and a writer that fails leaves the number free."""
    fs, path = place(spark, f"{folder}/{number:012d}.json")
    hadoop = spark._jvm.org.apache.hadoop.fs
    told, half = json.dumps(content, ensure_ascii=False).encode(), hadoop.Path(path.getParent(), f"_{uuid.uuid4().hex}.tmp")
    fs.mkdirs(path.getParent())
    out = fs.create(half, False)
    out.write(bytearray(told))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a rename would replace a file here, a link does not
            os.link(half.toUri().getPath(), path.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
            hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(half, path, none)
    except FileExistsError as error:
        raise Conflict(f"version {number} exists") from error
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        raise Conflict(f"version {number} exists") from error
    finally:
        fs.delete(half, False)


def clean(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Removes all versions but the newest `keep`, and data folders that none of those names; returns how many of these went. Readers of
    older versions lose them, and so does a writer that has not yet published: call it when none of either runs."""
    fs, path = place(spark, folder)
    names = sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
    numbers = [n for n in names if n.endswith(".json") and n[:-5].isdigit()]
    kept = "".join(spark.read.text([f"{folder}/{n}" for n in numbers[-keep:]], wholetext=True).toPandas()["value"]) if numbers else ""
    gone = [n for n in names if n.startswith("data-") and n not in kept]
    for n in [*numbers[:-keep], *gone]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, n), True)
    return len(gone)


def publish(
    spark: SparkSession, folder: str, tables: dict[str, DataFrame], partitioned: dict[str, list[str]] | None = None, facts: dict | None = None, after: int | None = None, added: dict[str, DataFrame] | None = None
) -> int:
    """Writes tables beside those of other versions, then names them in the version that follows `after` (the newest, if None).

    A table of None is that of the version before. Rows of `added` come to those of a table, which are not written anew.
    All tables change together or, on any failure, none does.
    """
    number, old = latest(spark, folder) if after is None else (after, latest(spark, folder)[1])
    data = f"{folder}/data-{uuid.uuid4().hex}"
    paths = dict(old.get("tables", {}))
    for name, rows in tables.items():
        if rows is None:
            continue
        paths[name] = f"{data}/{name}"
        rows.write.partitionBy(*(partitioned or {}).get(name, [])).option("compression", "zstd").parquet(paths[name])
    for name, rows in (added or {}).items():
        rows.write.parquet(f"{data}/{name}")
        paths[name] = [*_parts(paths.get(name, [])), f"{data}/{name}"]
    add(spark, folder, number + 1, {"tables": paths, "facts": {**old.get("facts", {}), **(facts or {})}})
    return number + 1


def _parts(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else paths


def tables(spark: SparkSession, folder: str) -> tuple[int, dict[str, DataFrame], dict]:
    """Number, tables and facts of the newest version."""
    number, content = latest(spark, folder)
    return number, {name: spark.read.parquet(*_parts(path)) for name, path in content.get("tables", {}).items()}, content.get("facts", {})
