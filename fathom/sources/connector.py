"""Documents from a caller's iterator, as a Spark data source, and from pushed JSON."""

from __future__ import annotations

import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fathom.hub import INPUT

MOST_PUSHED = 12 << 20
NAMES = [x.split()[0] for x in INPUT.split(", ")]


class _Reader(DataSourceReader):
    def __init__(self, adapter: str, parts: int):
        self.adapter, self.parts = adapter, parts

    def partitions(self):
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition):
        module, _, name = self.adapter.partition(":")
        for doc in getattr(importlib.import_module(module), name)(partition.value, self.parts):
            yield tuple(doc.get(n) for n in NAMES)


class Documents(DataSource):
    """spark.read.format("fathom_documents").option("adapter", "module:function").load(), after spark.dataSource.register(Documents).

    function(part, parts) yields the documents of one of parts shares as dictionaries; option parts, 1 if not given.
    """

    @classmethod
    def name(cls):
        return "fathom_documents"

    def schema(self):
        return INPUT

    def reader(self, schema):
        return _Reader(self.options["adapter"], int(self.options.get("parts", "1")))


def pushed(spark: SparkSession, text: str) -> DataFrame:
    """A batch {"source_id": ..., "documents": [...]} as documents; a field that is none is an error, as is a batch of over 12 MB."""
    if len(text.encode()) > MOST_PUSHED:
        raise ValueError("the batch is over 12 MB")
    given = json.loads(text)
    if not isinstance(given, dict) or set(given) != {"source_id", "documents"} or not isinstance(given["documents"], list):
        raise ValueError("a batch has a source_id and documents")
    for doc in given["documents"]:
        if unknown := set(doc) - set(NAMES) | {"source"} & set(doc):
            raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    lines = [json.dumps({**doc, "source": given["source_id"]}) for doc in given["documents"]]
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    return rows.select(F.from_json("value", INPUT, {"mode": "FAILFAST"}).alias("d")).select("d.*")
