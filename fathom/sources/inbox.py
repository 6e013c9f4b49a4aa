"""Batches of documents written whole: a Spark data source that appends numbered batches to a folder, and their intake by a hub.

Each task writes one Parquet file under a name of its own. A batch exists once its manifest does, and that names only the files that
committed tasks report: what a failed, repeated or speculative task has left is never read. Two writers get two numbers.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from fathom import hub as hubs
from fathom.sources import versions
from fathom.sources.connector import NAMES
from fathom.sources.listings import opened


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.batch = folder, f"data-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base, _ = opened(self.folder)
        name, rows, out = f"{self.batch}/{uuid.uuid4().hex}.parquet", 0, None
        system.create_dir(f"{base}/{self.batch}", recursive=True)
        try:
            for batch in iterator:
                out = out or pq.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=system)
                out.write_batch(batch)
                rows += batch.num_rows
            if out:
                out.close()
        except BaseException:
            if out:
                out.close()
                system.delete_file(f"{base}/{name}")
            raise
        return Written(name if out else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        told = {"files": [m.name for m in messages if m and m.name], "rows": sum(m.rows for m in messages if m)}
        system, base, local = opened(self.folder)
        half = f"{base}/_{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(half) as out:
            out.write(json.dumps(told).encode())
        names = [i.base_name for i in system.get_file_info(arrow_fs.FileSelector(base))]
        number = 1 + max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        while local:  # a move would replace a file here, a link does not
            try:
                os.link(half, f"{base}/{number:012d}.json")
                system.delete_file(half)
                return
            except FileExistsError:
                number += 1
        system.move(half, f"{base}/{number:012d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, base, _ = opened(self.folder)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{base}/{m.name}")


class Batches(DataSource):
    """df.write.format("fathom_batches").mode("append").save(folder) of documents (hub.INPUT), after spark.dataSource.register(Batches)."""

    @classmethod
    def name(cls):
        return "fathom_batches"

    def schema(self):
        return hubs.INPUT

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("batches are only appended")
        return _Writer(self.options["path"])


def write(documents: DataFrame, folder: str) -> None:
    """Appends documents (INPUT, whatever else they have) as one batch, all of them or none."""
    documents.sparkSession.dataSource.register(Batches)
    documents.select(*NAMES).write.format("fathom_batches").mode("append").save(folder)


def batch(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """The documents of a batch, or None if there is none of that number yet."""
    fs, path = versions.place(spark, f"{folder}/{number:012d}.json")
    if not fs.exists(path):
        return None
    found = json.loads(spark.read.text(f"{folder}/{number:012d}.json", wholetext=True).first().value)["files"]
    rows = spark.read.schema(hubs.INPUT)
    return rows.parquet(*(f"{folder}/{name}" for name in found)) if found else spark.createDataFrame([], hubs.INPUT)


def drain(hub: hubs.Hub, folder: str) -> list[dict]:
    """Takes the batches that the hub has not had, in their order, each whole or, if it breaks a rule, not at all; returns a report of each.

    What has been taken is kept beside the batches. A run that breaks off between a batch's intake and that note takes it once more, and finds it unchanged.
    """
    reports, spark = [], hub.spark
    number = versions.latest(spark, f"{folder}/taken")[0]
    while (rows := batch(spark, folder, number + 1)) is not None:
        number += 1
        try:
            report = {"number": number, **hub.ingest(rows), "error": None}
        except versions.Conflict:  # another writer of the hub was first: nothing is wrong with the batch
            break
        except ValueError as error:
            report = {"number": number, "created": 0, "updated": 0, "unchanged": 0, "error": str(error)}
        versions.add(spark, f"{folder}/taken", number, report)
        reports.append(report)
    return reports
