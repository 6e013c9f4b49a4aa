"""Nearest vectors from a persisted partition into cells: exact, without reading every vector.

Pivots are chosen once from a bounded sample; each vector lies in the cell of its nearest pivot, in blocks sorted by
that distance, with the least and greatest distance of their members to every pivot. A search
goes to each query's nearest cells for a threshold, then only to cells, and in them to blocks, that
the triangle inequality can't rule out. Queries go in batches: those of a cell meet its blocks as one matrix product.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import scoring
from fathom.sources import versions

#: Vectors from which pivots are chosen, the most pivots, vectors of a block, queries of a block, and vectors that the first pass looks at, at least.
SAMPLE, MOST_PIVOTS, BLOCK, QUERIES, FIRST = 4096, 256, 1024, 256, 64
#: Distances of unit vectors come from their products in doubles; bounds are eased by this much, far beyond rounding.
EASE = 1e-6
PLACES = 12


def far_apart(points: np.ndarray, k: int) -> np.ndarray:
    """k points, each farthest from those before it."""
    chosen, gap = [0], np.full(len(points), np.inf)
    while len(chosen) < min(k, len(points)):
        gap = np.minimum(gap, 2 - 2 * points @ points[chosen[-1]])
        chosen.append(int(gap.argmax()))
    return points[chosen]


def _between(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * points @ pivots.T))


def _points(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _placed(pivots):
    """(key, u, cell, r) of vectors."""

    def run(batches):
        for batch in batches:
            d = _between(_points(batch.column("u"), pivots.value.shape[1]), pivots.value)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("u"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["key", "u", "cell", "r"])

    return run


def _packed(pivots):
    """Sorted vectors as blocks of one cell each."""

    def run(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                for at in range(a, b, BLOCK):
                    part = batch.slice(at, min(BLOCK, b - at))
                    x = _points(part.column("u"), pivots.value.shape[1])
                    d = _between(x, pivots.value)
                    told = {"cell": pa.array([int(cell[at])], pa.int32()), "n": pa.array([len(x)], pa.int32()), "low": pa.array([d.min(0).tolist()]), "high": pa.array([d.max(0).tolist()]), "keys": pa.array([part.column("key").to_pylist()], pa.list_(part.column("key").type)), "points": pa.array([x.tobytes()], pa.binary())}
                    yield pa.RecordBatch.from_arrays(list(told.values()), list(told))

    return run


def build(spark: SparkSession, folder: str, vectors: DataFrame, pivots: int | None = None) -> int:
    """Publishes the cells of vectors (key, embedding) and returns the version; vectors without a cosine (null, zero, not finite) are left out,
    and all others must be of one dimension. Keys are unique."""
    rows = vectors.select("key", scoring.unit(F.col("embedding")).alias("u")).where("u is not null")
    n, kinds = rows.count(), rows.select(F.size("u").alias("d")).groupBy("d").count().limit(2).collect()
    if len(kinds) > 1:
        raise ValueError("vectors are of several dimensions")
    dim, key = kinds[0].d if kinds else 0, vectors.schema["key"].dataType.simpleString()
    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // SAMPLE))) == 0).orderBy("key").limit(2 * SAMPLE).collect() or rows.limit(1).collect()
    chosen = far_apart(np.array([r.u for r in some]), pivots or min(MOST_PIVOTS, max(1, int(n**0.5)))) if n else np.zeros((0, dim))
    shared, data = spark.sparkContext.broadcast(chosen), f"{folder}/data-{uuid.uuid4().hex}"
    placed = rows.mapInArrow(_placed(shared), f"key {key}, u array<double>, cell int, r double")
    # a cell may hold a third of all vectors: ranges of distance to its pivot part it
    blocks = placed.repartitionByRange("cell", "r").sortWithinPartitions("cell", "r").mapInArrow(_packed(shared), f"cell int, n int, low array<double>, high array<double>, keys array<{key}>, points binary")
    blocks.write.partitionBy("cell").parquet(f"{data}/blocks")
    blocks = spark.read.schema(blocks.schema).parquet(f"{data}/blocks")
    bounds = blocks.select("cell", "n", F.posexplode(F.arrays_zip("low", "high")).alias("i", "b")).groupBy("cell", "i").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"), F.sum("n").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "low", "high")))  # a number for each pivot
    bounds.groupBy("cell").agg(F.max("n").alias("n"), ordered.alias("b")).select("cell", "n", F.col("b.low").alias("low"), F.col("b.high").alias("high")).write.parquet(f"{data}/cells")
    spark.createDataFrame([(i, x) for i, x in enumerate(chosen.tolist())], "pivot int, u array<double>").write.parquet(f"{data}/pivots")
    number = versions.latest(spark, folder)[0] + 1
    versions.add(spark, folder, number, {"tables": {t: f"{data}/{t}" for t in ("blocks", "cells", "pivots")}, "facts": {"dim": dim}})
    return number


class _Bounds:
    """Pivots and, for each cell that has vectors, how many and the range of their distances to each pivot: at most MOST_PIVOTS squared numbers."""

    def __init__(self, pivots, cells):
        self.pivots, self.cell = pivots, np.array([c.cell for c in cells], int)
        self.n, self.low, self.high = np.array([c.n for c in cells], int), np.array([c.low for c in cells]), np.array([c.high for c in cells])

    def least(self, to: np.ndarray, low=None, high=None) -> np.ndarray:
        """The least distance that points at `to` from the pivots can have to members of each cell."""
        low, high = self.low if low is None else low, self.high if high is None else high
        return np.stack([np.maximum(low - x, x - high).max(1) for x in to]) if len(to) else np.zeros((0, len(low)))

    def first(self, to: np.ndarray, wanted: int) -> np.ndarray:
        """For each point its nearest cells that together hold as many vectors as are wanted."""
        order = np.argsort(self.least(to), 1, kind="stable")
        taken = np.cumsum(self.n[order], 1) - self.n[order] < wanted
        out = np.zeros_like(taken)
        np.put_along_axis(out, order, taken, 1)
        return out


def _paired(bounds, wanted, second):
    """(query, u, cell, reach): the cells each query visits first, or, with what the first pass gave it (`reach`), those it must visit still."""

    def run(batches):
        for batch in batches:
            u = _points(batch.column("u"), bounds.value.pivots.shape[1])
            to = _between(u, bounds.value.pivots)
            visit, reach = bounds.value.first(to, wanted), np.full(len(u), 2.0)
            if second:
                reach = batch.column("reach").to_numpy(zero_copy_only=False)
                visit = ~visit & (bounds.value.least(to) <= reach[:, None] + EASE)
            q, c = np.nonzero(visit)
            yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(q)), batch.column("u").take(pa.array(q)), pa.array(bounds.value.cell[c], pa.int32()), pa.array(reach[q])], ["query", "u", "cell", "reach"])

    return run


def _gathered(dim):
    """Sorted queries of a cell as blocks."""

    def run(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                for at in range(a, b, QUERIES):
                    part = batch.slice(at, min(QUERIES, b - at))
                    told = {"at": pa.array([int(cell[at])], pa.int32()), "queries": pa.array([part.column("query").to_pylist()], pa.list_(part.column("query").type)), "q": pa.array([_points(part.column("u"), dim).tobytes()], pa.binary()), "reach": pa.array([part.column("reach").to_pylist()], pa.list_(pa.float64()))}
                    yield pa.RecordBatch.from_arrays(list(told.values()), list(told))

    return run


def _compared(bounds, limit):
    """The `limit` nearest of a block to each of a block of queries whose reach it meets."""

    def run(batches):
        dim = bounds.value.pivots.shape[1]
        for batch in batches:
            for i in range(len(batch)):
                q, x = (np.frombuffer(batch.column(n)[i].as_py(), float).reshape(-1, dim) for n in ("q", "points"))
                low, high, reach = (np.array(batch.column(n)[i].as_py()) for n in ("low", "high", "reach"))
                meets = np.flatnonzero(bounds.value.least(_between(q, bounds.value.pivots), low[None], high[None])[:, 0] <= reach + EASE)
                if not len(meets):
                    continue
                near = np.round(np.clip(q[meets] @ x.T, -1, 1), PLACES)
                keys = batch.column("keys")[i].values
                rank = np.argsort(np.array(keys.to_pylist()), kind="stable").argsort()
                best = np.lexsort((np.broadcast_to(rank, near.shape), -near), axis=1)[:, :limit]
                names = batch.column("queries")[i].values.take(pa.array(np.repeat(meets, best.shape[1])))
                yield pa.RecordBatch.from_arrays([names, keys.take(pa.array(best.ravel())), pa.array(np.take_along_axis(near, best, 1).ravel())], ["query", "key", "similarity"])

    return run


def kept(rows: DataFrame) -> DataFrame:
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(versions.working_folder(rows.sparkSession))
    return rows.checkpoint()


def nearest(spark: SparkSession, folder: str, queries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(found, visits): (query, key, similarity, rank) of the nearest vectors by cosine, exactly those that search.nearest finds, and
    (query, cell) of the cells that were visited for it. Queries (query, embedding) are unique; those without a cosine, or of another
    dimension, find nothing. Similarities are rounded to PLACES before they rank; ties go to the smaller key."""
    content = versions.latest(spark, folder)[1]
    table = lambda name: spark.read.parquet(content["tables"][name])
    if not (dim := content["facts"]["dim"]):
        none = queries.select("query").limit(0)
        return none.withColumns({"key": F.col("query"), "similarity": F.lit(0.0), "rank": F.lit(0)}), none.withColumn("cell", F.lit(0))
    pivots = np.array([r.u for r in sorted(table("pivots").collect(), key=lambda r: r.pivot)]).reshape(-1, dim)
    bounds = spark.sparkContext.broadcast(_Bounds(pivots, table("cells").collect()))
    blocks = table("blocks")
    query, key = queries.schema["query"].dataType.simpleString(), blocks.schema["keys"].dataType.elementType.simpleString()
    asked = queries.select("query", scoring.unit(F.col("embedding")).alias("u")).where(F.size("u") == dim)
    pairs_schema, sides = f"query {query}, u array<double>, cell int, reach double", F.pmod(F.xxhash64("query"), F.lit(8))

    def visited(pairs: DataFrame) -> DataFrame:
        of_cells = pairs.repartition("cell", sides).sortWithinPartitions("cell").mapInArrow(_gathered(dim), f"at int, queries array<{query}>, q binary, reach array<double>")
        met = blocks.join(of_cells, F.col("cell") == F.col("at")).select("keys", "points", "low", "high", "queries", "q", "reach")
        return met.mapInArrow(_compared(bounds, limit), f"query {query}, key {key}, similarity double")

    def best(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "key"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= limit)

    wanted = max(limit, FIRST)
    first = asked.mapInArrow(_paired(bounds, wanted, False), pairs_schema)
    found = kept(best(visited(first)))
    worst = found.groupBy("query").agg(F.when(F.count(F.lit(1)) == limit, F.min("similarity")).alias("s"))
    reach = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s"))), F.lit(2.0)).alias("reach")
    second = asked.join(worst, "query", "left").select("query", "u", reach).mapInArrow(_paired(bounds, wanted, True), pairs_schema)
    rows = best(found.drop("rank").unionByName(visited(second)))
    return rows, first.select("query", "cell").unionByName(second.select("query", "cell"))
