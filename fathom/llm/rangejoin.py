"""Embedding near-duplicates: an exact metric range join over pivot cells.

Vectors of equal components are joined once. Pivots are chosen farthest-first from a sample by
digest. Each distinct unit vector belongs to the cell of its nearest pivot; for each cell the
smallest and greatest distance of its vectors to every pivot are known. With the chord distance d
and eps, that of the least cosine, a vector x visits cell j only if d(x, p_j) <= d(x, p_home) + 2 eps
and every d(x, p) lies within eps of cell j's bounds for that pivot: by the triangle inequality no
other cell can hold a partner. Of two cells only one is visited by the other, chosen as in a
round-robin so that cells share the work. Cells are joined independently; a large cell is cut into
slices, and inside a slice only vectors whose distances to the cell's pivot differ by at most eps
are compared. A cell reports counts and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.shared import components, cut, mix64, partitions

#: Vectors in one slice of a cell, and sampled vectors for each pivot.
SLICE, SAMPLED = 4096, 16
SALT = 16
_SLACK = 1e-6


def pivots_for(n: int) -> int:
    """Pivots for n distinct vectors: their cube root over 1.5, so cells grow slower than the table and so does replication."""
    return max(1, math.ceil(n ** (1 / 3) / 1.5))


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """k of the vectors, each as far as can be from those before it."""
    at = [0]
    near = _chord(x, x[:1])[:, 0]
    while len(at) < min(k, len(x)):
        at.append(int(near.argmax()))
        near = np.minimum(near, _chord(x, x[at[-1:]])[:, 0])
    return x[at]


def _matrix(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _packed(dtype):
    def run(batches):
        for batch in batches:
            raw = [np.asarray(v, dtype) + dtype(0) for v in batch.column("v").to_pylist()]  # + 0: -0 becomes 0
            data = [x.tobytes() for x in raw]
            keys = [hashlib.blake2b(x, digest_size=16).digest() for x in data]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in raw], pa.int32()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["id", "dim", "digest", "v"])

    return run


def _by_dim(batch):
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def _chord(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ p.T), 0))


def _homes(pivots, dtype):
    def run(batches):
        for whole in batches:
            for dim, batch in _by_dim(whole):
                d = _chord(_unit(_matrix(batch.column("v"), dtype)), pivots.value[dim])
                home = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "dim", "n", "v")), pa.array(home, pa.int32())], ["node", "dim", "n", "v", "home"])

    return run


def _bounds(pivots, dtype):
    """Count of each cell, and its least and greatest distance to each pivot, among the vectors of one task."""

    def run(batches):
        seen: dict[int, list] = {}
        for whole in batches:
            for dim, batch in _by_dim(whole):
                k = len(pivots.value[dim])
                if dim not in seen:
                    seen[dim] = [np.zeros(k, np.int64), np.full((k, k), np.inf), np.full((k, k), -np.inf)]
                d, home = _chord(_unit(_matrix(batch.column("v"), dtype)), pivots.value[dim]), batch.column("home").to_numpy()
                seen[dim][0] += np.bincount(home, minlength=k)
                np.minimum.at(seen[dim][1], home, d), np.maximum.at(seen[dim][2], home, d)
        for dim, (n, low, high) in seen.items():
            at = np.flatnonzero(n)
            cell, pivot = np.repeat(at, len(n)), np.tile(np.arange(len(n)), len(at))
            columns = [pa.array(np.full(len(cell), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(pivot, pa.int32()), pa.array(n[cell]), pa.array(low[at].reshape(-1)), pa.array(high[at].reshape(-1))]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "cell", "pivot", "n", "low", "high"])

    return run


def visits(d: np.ndarray, home: np.ndarray, low: np.ndarray, high: np.ndarray, eps: float) -> np.ndarray:
    """Whether a vector with distances d to all pivots may have a partner in each cell [vector, cell]."""
    near = d <= d[np.arange(len(d)), home][:, None] + 2 * eps + _SLACK
    for j in range(d.shape[1]):
        near[:, j] &= ((d >= low[j] - eps - _SLACK) & (d <= high[j] + eps + _SLACK)).all(1)  # an empty cell's bounds hold nothing
    return near


def _dealt(pivots, cells, eps, dtype, slice_size):
    names = ["dim", "cell", "slice", "role", "node", "n", "d", "v"]

    def run(batches):
        for whole in batches:
            for dim, batch in _by_dim(whole):
                p = pivots.value[dim]
                size, low, high = cells.value[dim]
                slices = -(-size // slice_size)
                nodes, home = batch.column("node").to_numpy(), batch.column("home").to_numpy()
                d = _chord(_unit(_matrix(batch.column("v"), dtype)), p)
                near = visits(d, home, low, high, eps)
                k = len(p)
                ahead = (np.arange(k)[None, :] - home[:, None]) % k
                near &= (ahead > 0) & ((2 * ahead < k) | ((2 * ahead == k) & (home[:, None] < np.arange(k)[None, :])))
                own = (mix64(nodes.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % slices[home]
                # role 0 is matched against, 1 are the cell's own seeking partners, 2 are visitors
                row = np.arange(len(nodes))
                guest, to = np.nonzero(near)
                parts = [(row, home, own, 0)]
                for rows, cell, role in ((row, home, 1), (guest, to, 2)):
                    times = slices[cell]
                    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    parts.append((np.repeat(rows, times), np.repeat(cell, times), nth, role))
                for rows, cell, nth, role in parts:
                    for a in range(0, len(rows), 4096):
                        at = slice(a, a + 4096)
                        take = pa.array(rows[at])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(take), dim), pa.int32()), pa.array(cell[at], pa.int32()), pa.array(nth[at], pa.int32()), pa.array(np.full(len(take), role), pa.int32()), *(batch.column(c).take(take) for c in ("node", "n")), pa.array(d[rows[at], cell[at]]), batch.column("v").take(take)], names
                        )

    return run


class _Cell:
    """One slice of a cell: the vectors to match against, and what has been found on them."""

    def __init__(self, eps: float):
        self.id, self.n, self.d, self.x, self.eps = [], [], [], [], eps

    def close(self):
        self.id, self.n, self.d, self.x = np.concatenate(self.id), np.concatenate(self.n), np.concatenate(self.d), np.concatenate(self.x)
        order = np.argsort(self.d, kind="stable")
        self.id, self.n, self.d, self.x = self.id[order], self.n[order], self.d[order], self.x[order]
        self.small = self.x.astype(np.float32)
        self.links = np.zeros(len(self.id), np.int64)
        self.parent = np.arange(len(self.id))

    def root(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[i]
            if (up == i).all():
                return i
            i = up

    def seek(self, ids, n, d, x, guests: np.ndarray, least: float):
        """(seeker, links) and edges of some seekers; d are their distances to the cell's pivot."""
        low, high = np.searchsorted(self.d, (d.min() - self.eps - _SLACK, d.max() + self.eps + _SLACK))
        rough = x.astype(np.float32) @ self.small[low:high].T >= least - 1e-4
        row, col = np.nonzero(rough)
        col = col + low
        exact = np.concatenate([np.einsum("ij,ij->i", x[row[a : a + 65536]], self.x[col[a : a + 65536]]) for a in range(0, len(row), 65536)]) if len(row) else np.zeros(0)
        ok = (exact >= least) & (ids[row] != self.id[col])
        row, col = row[ok], col[ok]
        links = np.bincount(row, self.n[col], len(ids)).astype(np.int64)
        np.add.at(self.links, col[guests[row]], n[row[guests[row]]])
        at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
        for a, b in zip(at, [*at[1:], len(row)], strict=False):
            roots = np.unique(self.root(col[a:b]))
            self.parent[roots] = roots[0]
        return links, ids[row[at]], self.id[col[at]]

    def forest(self):
        root = self.root(np.arange(len(self.id)))
        other = root != np.arange(len(root))
        return self.id[other], self.id[root[other]]


def _joined(least, eps, dtype):
    names = ["a", "b", "links"]

    def told(a, b, links):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names)

    def counts(ids, links):
        some = links > 0
        return told(ids[some], pa.nulls(int(some.sum()), pa.int64()), links[some])

    def edges(a, b):
        return told(a, b, np.zeros(len(a), np.int64))

    def run(batches):
        group, cell, open_ = None, None, True

        def end():
            if cell is not None and not open_:
                yield counts(cell.id, cell.links)
                yield edges(*cell.forest())

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "cell", "slice", "role")], 1)
            if not len(keys):
                continue
            at = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
            for a, b in zip(at, [*at[1:], len(keys)], strict=True):
                key, role = tuple(keys[a, :3]), keys[a, 3]
                if key != group:
                    yield from end()
                    group, cell, open_ = key, _Cell(eps), True
                part = batch.slice(a, b - a)
                ids, n, d, x = part.column("node").to_numpy(), part.column("n").to_numpy(), part.column("d").to_numpy(), _unit(_matrix(part.column("v"), dtype))
                if role == 0:
                    cell.id.append(ids), cell.n.append(n), cell.d.append(d), cell.x.append(x)
                    continue
                if open_:
                    if not cell.id:
                        continue  # a slice without vectors
                    cell.close()
                    open_ = False
                for c in range(0, len(ids), 512):  # rows come sorted by d, so neighbours seek in one ring
                    s = slice(c, c + 512)
                    links, u, v = cell.seek(ids[s], n[s], d[s], x[s], np.full(len(ids[s]), role == 2), least)
                    yield counts(ids[s], links)
                    yield edges(u, v)
        yield from end()

    return run


def near_vectors(vectors: DataFrame, id_col="vec_id", vector_col="embedding", least: float = 0.9, pivots: int | None = None, slice_size: int = SLICE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link if their cosine in double precision is at least `least`. Vectors that are
    null, empty, zero or hold a null or non-finite component link with nothing, nor do vectors of
    different lengths. Rows that repeat an id are vectors of their own: each has its own links, and
    its component is the smallest id that its own vector reaches. A row without an id links with
    nothing and is returned with a null component and kept. No rows give no rows; other columns
    are ignored. pivots: how many each vector length has, by pivots_for if None.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    dtype = np.float32 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.coalesce(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", odd) & F.exists("v", lambda x: x != 0), F.lit(False))
    alone = rows.where(~fine).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    keyed = rows.where(fine).mapInArrow(_packed(dtype), "id long, dim int, digest binary, v binary")
    groups = keyed.groupBy("dim", "digest").agg(F.min("id").alias("id"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.withColumn("node", F.monotonically_increasing_id()))  # a number for each distinct vector
    chosen = _pivots(groups, dtype, pivots)
    shared = spark.sparkContext.broadcast(chosen)
    homes = cut(groups.mapInArrow(_homes(shared, dtype), "node long, dim int, n long, v binary, home int"))
    cells = {dim: (np.zeros(len(p), np.int64), np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for dim, p in chosen.items()}
    bounds = homes.mapInArrow(_bounds(shared, dtype), "dim int, cell int, pivot int, n long, low double, high double")
    for r in bounds.groupBy("dim", "cell", "pivot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator():  # a row for two pivots
        size, low, high = cells[r.dim]
        size[r.cell], low[r.cell, r.pivot], high[r.cell, r.pivot] = r.n, r.low, r.high
    eps = math.sqrt(2 - 2 * least)
    dealt = homes.mapInArrow(_dealt(shared, spark.sparkContext.broadcast(cells), eps, dtype, slice_size), "dim int, cell int, slice int, role int, node long, n long, d double, v binary")
    dealt = dealt.repartition(partitions(spark), "dim", "cell", "slice").sortWithinPartitions("dim", "cell", "slice", "role", "d")
    found = cut(dealt.mapInArrow(_joined(least, eps, dtype), "a long, b long, links long"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    roots = cut(components(found.where("b is not null").select("a", "b")))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALT)).cast("int").alias("salt")
    salts = F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt")
    # the smallest id of each component, which may hold a third of all vectors
    linked = groups.select("node", "id", salt("node")).join(roots, "node")
    linked = linked.join(linked.groupBy("component").agg(F.min("id").alias("component_id")).select("component", "component_id", salts), ["component", "salt"])
    named = groups.join(linked.select("node", "component_id"), "node", "left").join(links.withColumnRenamed("a", "node"), "node", "left")
    named = named.select("dim", "digest", "n", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    single = named.where("n = 1").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    many = named.where("n > 1").select("dim", "digest", "n_links", "component_id", salts)
    copies = keyed.select("id", "dim", "digest", salt("id")).join(many, ["dim", "digest", "salt"])
    everyone = single.union(copies.select(F.col("id").alias("vec_id"), "n_links", "component_id"))
    return everyone.withColumn("kept", F.col("vec_id") == F.col("component_id")).union(alone)


def _pivots(groups: DataFrame, dtype, pivots: int | None) -> dict[int, np.ndarray]:
    """Pivots of each vector length, farthest-first among about SAMPLED for each, sampled by digest in one job."""
    wanted = {r["dim"]: (min(r["count"], pivots or pivots_for(r["count"])), r["count"]) for r in groups.groupBy("dim").count().collect()}  # a row for each length
    if not wanted:
        return {}
    share = groups.sparkSession.createDataFrame([(dim, min(1.0, k * SAMPLED / n)) for dim, (k, n) in wanted.items()], "dim int, share double")
    spot = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    sample: dict[int, list] = {}
    for r in groups.join(F.broadcast(share), "dim").where(spot < F.col("share")).select("dim", "digest", "v").collect():  # some SAMPLED for each pivot
        sample.setdefault(r["dim"], []).append((bytes(r["digest"]), bytes(r["v"])))
    first = lambda dim: [np.eye(1, dim).astype(dtype).tobytes()]  # noqa: E731 - any point will do where the sample came out empty
    return {dim: farthest_first(_unit(np.frombuffer(b"".join([v for _, v in sorted(sample.get(dim, []))] or first(dim)), dtype).reshape(-1, dim)), k) for dim, (k, _) in wanted.items()}
