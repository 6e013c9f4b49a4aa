"""Nearest vectors from cells are those of an exact search, from fewer cells where vectors lie in clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import cells, search

SCHEMA = "key long, embedding array<double>"


def _clustered(n, middles, noise, seed=3):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(middles, 16))[rng.integers(0, middles, n)] + rng.normal(size=(n, 16)) * noise
    return [(i, x) for i, x in enumerate(points.tolist())]


def _same(spark, folder, vectors, queries, limit):
    found, visits = cells.nearest(spark, folder, queries, limit)
    told = lambda df: sorted((r.query, r["rank"], r.key, r.similarity) for r in df.collect())
    want = told(search.nearest(queries, vectors.where("key is not null"), limit))
    got = told(found)
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-11)
    return visits


def test_clusters(spark, tmp_path):
    rows = _clustered(3000, 30, 0.15)
    rows += [(5000 + i, rows[7][1]) for i in range(60)]  # many at one place: ties beyond the limit
    rows += [(6000, [0.0] * 16), (6001, [float("nan")] * 16), (6002, None)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    folder = f"file://{tmp_path}/cells"
    assert cells.build(spark, folder, vectors) == 1
    queries = vectors.where((F.col("key") % 50 == 0) | (F.col("key") == 7)).select(F.col("key").alias("query"), "embedding")
    visits = _same(spark, folder, vectors, queries, 10)
    asked = queries.where("query < 6000").count()
    assert visits.count() == visits.distinct().count() < asked * spark.read.parquet(f"{folder}/data-*/cells").count() / 4  # under a quarter of the cells
    assert cells.nearest(spark, folder, spark.createDataFrame([(1, [1.0] * 3), (2, None), (3, [0.0] * 16)], "query long, embedding array<double>"), 3)[0].count() == 0
    _same(spark, folder, vectors, queries.limit(3), 5000)  # more than there are


def test_small_and_even_tables(spark, tmp_path):
    rng = np.random.default_rng(1)
    few = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(7, 4)).tolist())], SCHEMA)
    for n, (vectors, pivots) in enumerate([(few, None), (few, 1), (few.limit(1), None), (spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(400, 4)).tolist())], SCHEMA), 40)]):
        folder = f"file://{tmp_path}/{n}"
        cells.build(spark, folder, vectors, pivots)
        _same(spark, folder, vectors, vectors.limit(5).select(F.col("key").alias("query"), "embedding"), 3)
    cells.build(spark, f"file://{tmp_path}/none", few.limit(0))
    assert cells.nearest(spark, f"file://{tmp_path}/none", few.select(F.col("key").alias("query"), "embedding"), 3)[0].count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        cells.build(spark, f"file://{tmp_path}/odd", few.union(spark.createDataFrame([(9, [1.0])], SCHEMA)))
