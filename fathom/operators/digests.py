"""Comparison of tables by digest trees: parts that agree are told by their digests and never read.

A row's place is the head of a hash of its key, four bits a level, so a node's rows are those of its children and a shallower
tree is the head of a deeper one. A node's digest is its number of rows and two sums of row hashes: those of its children
added up. Rows lie in folders by the first two levels and in the order of their leaves in them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.sources import versions

STEP = 4
#: Levels whose nodes are folders, rows a leaf is meant to hold, and the most levels.
FOLDERS, LEAF_ROWS, DEEPEST = 2, 1000, 12
#: Places of differing leaves up to which they are told to the scan, so that it passes over pages without any; more are joined.
TOLD = 1000
NODES = "node long, n long, a decimal(38,0), b decimal(38,0)"


def _place(key: Column, level: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - STEP * level) if level else F.lit(0).cast("long")


def _digest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def write(rows: DataFrame, key: str, folder: str, leaf_rows: int = LEAF_ROWS) -> int:
    """Keeps a table with its digests as the next version of a folder; returns its number.

    Keys may be null or repeat: a leaf holds all rows of a key. A row's hash is of all its columns by name, whatever their order. Ranges of places, and
    of row hashes where a place is full, go to tasks, so neither a folder nor a frequent key is one task's. Columns must not be named __leaf, __folder, __a or __b.
    """
    spark = rows.sparkSession
    depth = 1
    n = rows.count()
    while depth < DEEPEST and n > leaf_rows * 2 ** (STEP * depth):
        depth += 1
    whole = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    placed = rows.withColumn("__leaf", _place(F.col(key), depth)).withColumn("__a", F.xxhash64(whole)).withColumn("__b", F.xxhash64(F.lit("second"), whole))
    placed = placed.withColumn("__folder", F.shiftright("__leaf", STEP * max(0, depth - FOLDERS)).cast("int"))
    number, data = versions.latest(spark, folder)[0], f"{folder}/data-{uuid.uuid4().hex}"
    placed.repartitionByRange("__folder", "__leaf", "__a").sortWithinPartitions("__folder", "__leaf").write.partitionBy("__folder").parquet(f"{data}/rows")
    kept = spark.read.schema(placed.schema).parquet(f"{data}/rows")
    level = kept.select(F.col("__leaf").alias("node"), F.lit(1).cast("long").alias("n"), *(F.col(f"__{c}").cast("decimal(38,0)").alias(c) for c in ("a", "b")))
    for d in range(depth, -1, -1):  # sums of sums: the table is not read again for each level
        _digest(level).write.parquet(f"{data}/level-{d}")
        level = spark.read.schema(NODES).parquet(f"{data}/level-{d}").withColumn("node", F.shiftright("node", STEP))
    versions.add(spark, folder, number + 1, {"tables": {}, "facts": {"depth": depth, "data": data, "schema": placed.schema.json()}})
    return number + 1


def _opened(spark: SparkSession, folder: str) -> tuple[int, DataFrame, list[DataFrame]]:
    """Depth, rows and levels of a folder's newest version."""
    facts = versions.latest(spark, folder)[1].get("facts", {})
    if not facts.get("depth"):
        raise ValueError("a table without digests")
    rows = spark.read.schema(T.StructType.fromJson(json.loads(facts["schema"]))).parquet(f"{facts['data']}/rows")
    return facts["depth"], rows, [spark.read.schema(NODES).parquet(f"{facts['data']}/level-{d}") for d in range(facts["depth"] + 1)]


@dataclass(frozen=True)
class Difference:
    """What may differ of two tables: differing nodes of the deepest common level, and the rows that lie in them."""

    depth: int
    nodes: DataFrame
    left: DataFrame
    right: DataFrame


def _differing(left: DataFrame, right: DataFrame, above: DataFrame | None) -> DataFrame:
    """Nodes whose digests differ, of the children of those above; a side without a node has no rows there."""
    if above is not None:
        left, right = (side.join(above.select(F.col("node").alias("up")), F.shiftright("node", STEP) == F.col("up"), "left_semi") for side in (left, right))
    told = lambda side, name: side.select("node", F.struct("n", "a", "b").alias(name))
    return told(left, "l").join(told(right, "r"), "node", "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select("node")


def difference(spark: SparkSession, left: str, right: str) -> Difference:
    """Descends the trees of two folders' newest versions from their roots, level by level, where digests differ."""
    (deep_a, rows_a, levels_a), (deep_b, rows_b, levels_b) = _opened(spark, left), _opened(spark, right)
    depth, above = min(deep_a, deep_b), None
    for a, b in zip(levels_a[: depth + 1], levels_b, strict=False):
        above = _differing(a, b, above)
    nodes = above.persist()
    few = [r.node for r in nodes.limit(TOLD + 1).collect()]
    folders = [r.f for r in nodes.select(F.shiftright("node", STEP * max(0, depth - FOLDERS)).alias("f")).distinct().collect()]  # 256 at most

    def side(rows: DataFrame, own: int) -> DataFrame:
        # a shallower tree's folders are heads of a deeper one's
        spread = STEP * (min(FOLDERS, own) - min(FOLDERS, depth))
        rows = rows.where(F.shiftright("__folder", spread).isin(folders) if spread else F.col("__folder").isin(folders))
        node = F.shiftright("__leaf", STEP * (own - depth)) if own > depth else F.col("__leaf")
        if len(few) <= TOLD:
            return rows.where(node.isin(few))
        return rows.join(nodes.select(F.col("node").alias("__node")), node == F.col("__node"), "left_semi")

    return Difference(depth, nodes, side(rows_a, deep_a), side(rows_b, deep_b))


def changed(spark: SparkSession, left: str, right: str, key: str) -> DataFrame:
    """(key, state) of keys whose rows differ: missing_left, missing_right or changed, as changes.snapshot_diff tells them of whole tables.

    Rows that repeat count: a key is the same if both sides hold the same rows of it as often.
    """
    found = difference(spark, left, right)
    sums = lambda rows, name: rows.groupBy(key).agg(F.struct(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("__a", "__b"))).alias(name))
    l, r = sums(found.left, "__l"), sums(found.right, "__r").withColumnRenamed(key, "__key")
    rows = l.join(r, F.col(key).eqNullSafe(F.col("__key")), "full_outer").where(~F.col("__l").eqNullSafe(F.col("__r")))
    state = F.when(F.col("__l").isNull(), "missing_left").when(F.col("__r").isNull(), "missing_right").otherwise("changed")
    return rows.select(F.coalesce(key, "__key").alias(key), state.alias("state"))
