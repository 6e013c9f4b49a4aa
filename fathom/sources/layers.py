"""Tables of documents that change by small batches, as immutable layers under one manifest.

A batch adds a layer: its own rows, and tombstones of documents whose older rows they replace. A row is
alive unless a tombstone of a later version names its document; both keep the number of the version
that wrote them, so layers may be merged in any grouping. Aggregates (tokens) are differences
that are summed when read. What a batch writes depends on the batch alone; merging layers of like
size keeps their number logarithmic.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, types
from pyspark.sql import functions as F

from fathom.sources import versions

#: Layers of one size class that are merged, and the factor between classes.
FAN = 4
#: Tombstones: `whole` ones end chunks, postings and vectors too, others only what is stated of a document.
GONE = "doc_id string, whole boolean, layer long"


def _columns(schema: str) -> list[str]:
    return types._parse_datatype_string(schema).fieldNames()


@dataclass(frozen=True)
class Snapshot:
    """One version, pinned: whatever is published meanwhile, its tables stay the same. Only tables that are asked for are opened."""

    spark: SparkSession
    folder: str
    schemas: dict[str, str]
    number: int
    content: dict

    @property
    def layers(self) -> list[dict]:
        return self.content.get("layers", [])

    @property
    def facts(self) -> dict:
        return self.content.get("facts", {})

    def whole(self, name: str) -> DataFrame:
        """A small table that each change writes anew."""
        path = self.content.get("tables", {}).get(name)
        return self.spark.read.schema(self.schemas[name]).parquet(path) if path else self.spark.createDataFrame([], self.schemas[name])

    def rows(self, name: str, layers: list[dict] | None = None) -> DataFrame:
        """All rows of layers, dead ones too, with the number of the version that wrote them."""
        schema = GONE if name == "gone" else f"{self.schemas[name]}, layer long"
        paths = [f"{x['path']}/{name}" for x in (self.layers if layers is None else layers) if name in x["tables"]]
        # folders by partition have a root each; layers are few
        read = [self.spark.read.schema(schema).parquet(path).select(*_columns(schema)) for path in paths]
        return reduce(DataFrame.union, read) if read else self.spark.createDataFrame([], schema)

    def alive(self, name: str, layers: list[dict] | None = None) -> DataFrame:
        """The rows of a table that no later version has ended."""
        rows = self.rows(name, layers)
        if not any("gone" in x["tables"] for x in self.layers):
            return rows
        gone = self.rows("gone") if name == "documents" else self.rows("gone").where("whole")
        last = gone.groupBy("doc_id").agg(F.max("layer").alias("until")).withColumnRenamed("doc_id", "__doc")
        return rows.join(last, (F.col("doc_id") == F.col("__doc")) & (F.col("layer") < F.col("until")), "left_anti")

    def table(self, name: str) -> DataFrame:
        return self.alive(name).drop("layer")

    def tokens(self, layers: list[dict] | None = None) -> DataFrame:
        """(token, bucket, n_with, total): differences summed; filters on both keys reach the scan."""
        found = self.rows("tokens", layers).groupBy("token", "bucket").agg(F.sum("n_with").alias("n_with"), F.sum("total").alias("total"))
        return found.select("token", "n_with", "total", "bucket").where("n_with <> 0" if layers is None else "n_with <> 0 or total <> 0")


def pin(spark: SparkSession, folder: str, schemas: dict[str, str]) -> Snapshot:
    return Snapshot(spark, folder, schemas, *versions.latest(spark, folder))


def write(snapshot: Snapshot, tables: dict[str, DataFrame], partitioned: dict[str, list[str]], size: int, data: str | None = None, stamped: bool = True) -> dict:
    """Writes a layer; its rows get the number of the version after snapshot, unless they have one. size is what its class goes by."""
    path = data or f"{snapshot.folder}/data-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows = rows.withColumn("layer", F.lit(snapshot.number + 1).cast("long")) if stamped else rows
        rows.write.partitionBy(*partitioned.get(name, [])).option("compression", "zstd").parquet(f"{path}/{name}")
    return {"path": path, "tables": sorted(tables), "size": size}


def publish(snapshot: Snapshot, layers: list[dict] | None = None, tables: dict[str, str] | None = None, facts: dict | None = None) -> Snapshot:
    """The version after snapshot, with other layers, whole tables or facts; Conflict if there is one already."""
    content = {"tables": {**snapshot.content.get("tables", {}), **(tables or {})}, "layers": snapshot.layers if layers is None else layers, "facts": {**snapshot.facts, **(facts or {})}}
    versions.add(snapshot.spark, snapshot.folder, snapshot.number + 1, content)
    return Snapshot(snapshot.spark, snapshot.folder, snapshot.schemas, snapshot.number + 1, content)


def due(layers: list[dict], fan: int = FAN) -> list[int]:
    """Places of layers to merge: those of the smallest size class that has `fan` of them, or none."""
    classes: dict[int, list[int]] = {}
    for i, x in enumerate(layers):
        classes.setdefault(int(math.log(max(1, x["size"]), fan)), []).append(i)
    full = [c for c, places in classes.items() if len(places) >= fan]
    return classes[min(full)] if full else []


def merged(snapshot: Snapshot, places: list[int], partitioned: dict[str, list[str]], arranged) -> list[dict]:
    """The layers of snapshot with those at some places written as one: their live rows, and, unless all layers are merged,
    their tombstones, which may still end rows of other layers. arranged(name, rows) lays rows out for writing."""
    some = [snapshot.layers[i] for i in places]
    every, names = len(some) == len(snapshot.layers), {n for x in some for n in x["tables"]}
    tables = {n: arranged(n, snapshot.alive(n, some)) for n in names - {"gone", "tokens"}}
    if "tokens" in names:
        tables["tokens"] = arranged("tokens", snapshot.tokens(some).withColumn("layer", F.lit(snapshot.number).cast("long")))
    if "gone" in names and not every:
        tables["gone"] = snapshot.rows("gone", some).groupBy("doc_id", "whole").agg(F.max("layer").alias("layer"))
    one = write(snapshot, tables, partitioned, sum(x["size"] for x in some), stamped=False)
    return [x for i, x in enumerate(snapshot.layers) if i not in places] + [one]
