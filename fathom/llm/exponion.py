"""Centroid clustering (Lloyd's rounds) with exponion search.

Each vector carries an upper bound on the distance to its centroid and a lower bound on that to any
other. A vector whose bounds can't decide scans only the centroids inside a ball around its current
centroid, a prefix of that centroid's list of others sorted by distance; the radius is inclusive, so
that ties are seen and the smaller number wins. Coordinates are integers and all distances that
decide are exact; bounds are rounded outwards.

Vectors lie in packed blocks, which each round rewrites with their bounds in the shared folder: no
vector is shuffled, each task sends one sum for each of its clusters, and the driver holds the
centroids only.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.shared import remove, shared_dir

DIM, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Scaled components lie inside this bound on either side, so that squared distances of up to 64 components fit a long.
BOUND = 1 << 27
#: Vectors of one packed block.
BLOCK = 1024
#: Bounds are moved outwards by this share, which is far beyond what rounding of doubles may add.
SLACK = 1e-9
_STATE = "ids array<long>, points binary, owner binary, upper binary, lower binary"


def scaled(docs: DataFrame, id_col: str, vector_col: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors of exactly dim finite components, each as floor(scale * x); others, and such with a scaled
    component of BOUND or more, whose squared distances a long can't hold, are left out."""
    x = F.transform(F.col(vector_col), lambda e: F.lit(scale) * e.cast("double"))
    fits = (F.size(vector_col) == dim) & F.forall("x", lambda e: F.coalesce((e > -BOUND) & (e < BOUND), F.lit(False)))
    rows = docs.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col), x.alias("x")).where(F.coalesce(fits, F.lit(False)))
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(e).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = "3:") -> np.ndarray:
    """The vectors of the k smallest SHA-256 of seed and id; equal hashes (repeated ids) by components, null ids last.
    Only hashes of each partition's smallest are compared; vectors are fetched for those that can be among the k."""
    hashed = vectors.select(F.coalesce(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256), F.lit("~")).alias("h"), "v")
    least = [r.h for r in hashed.select("h").orderBy("h").limit(k).collect()]  # k hashes
    if not least:
        return np.zeros((0, 0), np.int64)
    rows = hashed.where(F.col("h") <= least[-1]).orderBy("h", "v").limit(k).collect()  # k vectors
    return np.array([r.v for r in rows], np.int64)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all centroids. Sums of products that doubles hold exactly go by a matrix
    product, others by differences; both give the same numbers."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if top * top * 4 * points.shape[1] < 1 << 53:
        p, c = points.astype(float), centroids.astype(float)
        return ((p * p).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (p @ c.T)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


class Centroids:
    """Centroids of a round, each with its list of all centroids by distance, and how far they moved since the last round."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        between = np.sqrt(squared(now, now).astype(float))
        k = len(now)
        #: For each centroid: all centroids by distance (itself first), and these distances, a little low so that ties are inside.
        self.order = np.array([np.lexsort((np.arange(k), np.arange(k) != j, between[j])) for j in range(k)])
        self.far = np.take_along_axis(between, self.order, 1) * (1 - SLACK)
        self.nearest = np.array([self.far[j, 1] if k > 1 else np.inf for j in range(k)])
        moved = np.zeros(k) if before is None else np.sqrt(((now - before).astype(float) ** 2).sum(1)) * (1 + SLACK)
        self.moved = moved
        most = np.argsort(-moved)[:2]
        #: The farthest move among the others of each centroid.
        self.others = np.array([moved[most[1]] if j == most[0] and k > 1 else (moved[most[0]] if k > 1 else 0.0) for j in range(k)])

    def assign(self, points: np.ndarray, owner: np.ndarray | None, upper=None, lower=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(owner, upper, lower, distances computed) of points after this round's moves; without an owner all are scanned."""
        if owner is None:
            owner, upper, lower = np.zeros(len(points), np.int32), np.full(len(points), np.inf), np.zeros(len(points))
            todo, work = np.arange(len(points)), 0
        else:
            owner, upper, lower = owner.copy(), upper + self.moved[owner], lower - self.others[owner]
            unsure = upper >= np.maximum(lower, self.nearest[owner] / 2)  # equality is a tie to look at
            todo, work = np.flatnonzero(unsure), int(unsure.sum())
            upper[todo] = np.sqrt(((points[todo] - self.now[owner[todo]]) ** 2).sum(1).astype(float)) * (1 + SLACK)
            todo = todo[upper[todo] >= np.maximum(lower[todo], self.nearest[owner[todo]] / 2)]
        for j in np.unique(owner[todo]).tolist():
            mine = todo[owner[todo] == j]
            # inside the ball: whatever is nearer or as near, and the second nearest, which is the new lower bound
            reach = np.searchsorted(self.far[j], 2 * upper[mine] + self.nearest[j], side="right")
            width = 1 << np.ceil(np.log2(np.maximum(reach, 1))).astype(int)  # prefixes of like length are scanned together
            for w in np.unique(width).tolist():
                some, inside = mine[width == w], np.sort(self.order[j, :w])
                d = squared(points[some], self.now[inside])
                work += d.size
                best = d.argmin(1)  # the first of equal ones: the smaller number
                owner[some] = inside[best]
                upper[some] = np.sqrt(d[np.arange(len(some)), best].astype(float)) * (1 + SLACK)
                if len(inside) > 1:
                    lower[some] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(float)) * (1 - SLACK)
                else:
                    lower[some] = np.inf if len(self.now) == 1 else self.far[j, 1] - upper[some]
        return owner, upper, lower, work


def _pack(dim):
    """Rows of vectors as blocks of at most BLOCK."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                points = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (points.tobytes(), None, None, None))], ["ids", "points", "owner", "upper", "lower"]
                )

    return run


def _state(batch, dim):
    for i in range(len(batch)):
        points, *rest = (batch.column(n)[i].as_py() for n in ("points", "owner", "upper", "lower"))
        kinds = (np.int32, float, float)
        yield i, np.frombuffer(points, np.int32).reshape(-1, dim).astype(np.int64), *(None if x is None else np.frombuffer(x, t) for x, t in zip(rest, kinds, strict=True))


def _step(shared, dim):
    """Blocks with the owners and bounds of this round."""

    def run(batches):
        for batch in batches:
            found = [shared.value.assign(*x[1:])[:3] for x in _state(batch, dim)]
            told = [pa.array([np.ascontiguousarray(f[n]).tobytes() for f in found], pa.binary()) for n in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("points"), *told], ["ids", "points", "owner", "upper", "lower"])

    return run


def _sums(dim):
    """One row for each cluster of a task: number of vectors, and sums of their components."""

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for _, points, owner, _, _ in _state(batch, dim):
                for j in np.unique(owner).tolist():
                    mine = points[owner == j]
                    have = total.setdefault(j, [0, np.zeros(dim, np.int64)])
                    have[0] += len(mine)
                    have[1] += mine.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1].tolist() for x in total.values()], pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _moved(blocks: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """The floored means of the clusters; an empty cluster keeps its centroid. Comes to the driver as one row a cluster."""
    parts = blocks.mapInArrow(_sums(dim), "cluster int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
        out[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(dim)]  # // floors, below zero too
    return out


def _told(shared, dim):
    def run(batches):
        for batch in batches:
            for i, points, owner, _, _ in _state(batch, dim):
                distance = ((points - shared.value[owner]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(owner, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, id_col="vec_id", vector_col="embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = "3:", start: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): a row (vec_id, cluster, distance) for each kept vector, and the final centroids.

    scaled says which vectors are kept; the others have no row. Ids may be null or repeat: each row is a vector of its
    own. Fewer kept vectors than k give as many centroids; none give no rows. Equal distances go to the smaller number, also
    between equal centroids. `start` takes the place of the first centroids. Other columns are ignored. rows read a folder in
    the shared one, which holds the final blocks and is the caller's to remove.
    """
    spark = vectors.sparkSession
    kept = scaled(vectors, id_col, vector_col, dim, scale)
    centroids = first_centroids(kept, k, seed) if start is None else np.asarray(start, np.int64)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    folder = f"{shared_dir(spark)}/exponion-{uuid.uuid4().hex}"
    kept.mapInArrow(_pack(dim), _STATE).write.parquet(f"{folder}/0")
    before = None
    for number in range(1, rounds + 2):
        shared = spark.sparkContext.broadcast(Centroids(centroids, before))  # k * dim integers and k * k distances
        spark.read.schema(_STATE).parquet(f"{folder}/{number - 1}").mapInArrow(_step(shared, dim), _STATE).write.parquet(f"{folder}/{number}")
        remove(spark, f"{folder}/{number - 1}")
        blocks = spark.read.schema(_STATE).parquet(f"{folder}/{number}")
        if number <= rounds:
            before, centroids = centroids, _moved(blocks, centroids, dim)
    final = spark.sparkContext.broadcast(centroids)
    return blocks.mapInArrow(_told(final, dim), "vec_id long, cluster int, distance long"), centroids


def described(spark: SparkSession, rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with cluster_inertia, inertia (distances summed over the cluster, and over all) and centroid_sha256."""
    told = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per = sums.join(F.broadcast(spark.createDataFrame(told, "cluster int, centroid_sha256 string")), "cluster")
    whole = sums.agg(F.sum("cluster_inertia").alias("inertia"))  # one row
    return rows.join(F.broadcast(per.crossJoin(F.broadcast(whole))), "cluster")  # a row for each centroid
