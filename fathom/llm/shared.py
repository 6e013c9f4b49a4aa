"""Pieces that several corpus operators need: shared storage, lineage cuts, word scanning, components.

Nothing here holds more than one Arrow batch, one model of bounded size or one integer per
partition outside of Spark.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of a task in the rounds of components, until all shuffle partitions are in use.
EDGES = 4096
#: Texts are scanned in pieces of at most this many bytes (a longer text is one piece of its own).
CHUNK_BYTES = 2 << 20
#: Rows of keys, some 20 bytes each, that are broadcast at most.
MOST_BROADCAST = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session takes a
    temporary one, as its executors are this machine; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="fathom-")
        shared_dir.own = folder
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate data, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(rows: DataFrame, gone: DataFrame, condition, most: int = MOST_BROADCAST) -> DataFrame:
    """The rows that meet none of gone (keys of a few bytes): gone is broadcast if it has at most `most` rows, else both sides are shuffled."""
    return rows.join(F.broadcast(gone) if gone.count() <= most else gone, condition, "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- words over Arrow buffers

def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for bytes inside any of the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Runs of letters, digits and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Runs of anything but white space.
NONSPACE = ~byte_class((0x09, 0x0D), (0x20, 0x20))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9FB21C651E98DF25)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix64(np.arange(256, dtype=np.uint64)) | np.uint64(1)


class Words:
    """The words of a slice of texts: owner (row), start and end (byte offsets into data), hash."""

    __slots__ = ("data", "offsets", "owner", "start", "end", "hash", "rows")

    def __init__(self, data, offsets, owner, start, end, hashes):
        self.data, self.offsets, self.owner, self.start, self.end, self.hash = data, offsets, owner, start, end, hashes
        self.rows = len(offsets) - 1

    def bounds(self) -> np.ndarray:
        """Word index at which each row begins, and the total at the end."""
        return np.searchsorted(self.owner, np.arange(self.rows + 1))

    def counts(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.rows)

    def bytes_of(self, i: int) -> bytes:
        return LOWER[self.data[self.start[i] : self.end[i]]].tobytes()


def text_slices(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for pieces of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def scan_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, hashes: bool = True) -> Words:
    """Maximal runs of bytes of a kind inside each text; hashes are over A-Z lower-cased bytes.

    Word hashes are 64-bit polynomials over the word's bytes, finalised with its length, so they
    depend on nothing but the word.
    """
    inside = kind[data]
    edges = offsets[1:-1]
    first, last = inside.copy(), inside.copy()
    if len(data):
        cuts = edges[(edges > 0) & (edges < len(data))]
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(offsets, start, "right") - 1
    out = None
    if hashes:
        length = end - start
        if len(start):
            at = np.concatenate(([0], np.cumsum(length)[:-1]))
            position = np.arange(int(length.sum())) - np.repeat(at, length)
            with np.errstate(over="ignore"):
                power = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
                code = _BYTE_CODE[LOWER[data[inside]]] * power[position]
                out = mix64(np.add.reduceat(code, at) ^ length.astype(np.uint64))
        else:
            out = np.zeros(0, np.uint64)
    return Words(data, offsets, owner, start, end, out)


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b: long): a row (node, component) for each node.

    The component is its smallest node. Large-star and small-star rounds: each round replaces
    edges by edges to the smallest neighbour, so the edge set never grows, and no vertex's
    neighbours are gathered in one place: every step is an aggregate that combines map-side and an
    equi-join that AQE can split. Self edges and nulls are ignored; no edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = cut(edges)
    number = edges.count()
    if not number:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # shuffle partitions are set for the texts; edges are few beside them and never become more
    few = lambda df: df.coalesce(max(1, min(partitions(df.sparkSession), -(-number // EDGES))))
    edges, seen = few(edges), None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = few(few(both.where("v > u").join(low, "u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = few(large.join(low, "a").select("a", "b", "m"))
        edges = cut(few(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b"))).distinct()
        ))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    # both kinds of star leave each node with one edge to its smallest; roots get their own row
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
