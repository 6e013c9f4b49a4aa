"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of the test strings (WINDOW consecutive words; a shorter string is one
window). For windows of m words a table gives, for the two words that end at a position, how far
the search may jump: m - 1 where they occur in no window, else their distance to a window's end.
Where it says 0, the windows with that last pair are taken from their suffix bucket, compared by
their first pair and then directly, byte by byte. All texts of a piece are searched at once, one
cursor for each text or stretch of a long one.

The windows are gathered in shards of at most `shard` windows, so what is broadcast is bounded; a
larger benchmark is searched shard by shard, each adding to the word marks of the one before.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import ALNUM, cut, mix64, scan_words, text_slices

WINDOW = 10
#: Windows in one broadcast: about 100 bytes each.
SHARD = 500_000
#: Words searched by one cursor.
STRETCH = 2048
_BITS = 20
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(first * _PAIR ^ second)


class Index:
    """Shift tables and suffix buckets for some windows: {normalised window: its items}."""

    def __init__(self, windows: dict[bytes, list[str]]):
        self.tables = []
        by_length = defaultdict(list)
        for w in windows:
            by_length[w.count(b" ") + 1].append(w)
        for m, own in sorted(by_length.items()):
            raw = np.frombuffer(b" ".join(own), np.uint8)
            words = scan_words(raw, np.array([0, len(raw)]), ALNUM).hash.reshape(len(own), m)
            block = min(2, m)
            ends = [words[:, j] if block == 1 else _pair(words[:, j - 1], words[:, j]) for j in range(block - 1, m)]
            shift = np.full(1 << _BITS, m - block + 1, np.int8)
            for k, ending in enumerate(ends):  # later ends give smaller shifts
                at = (ending & np.uint64((1 << _BITS) - 1)).astype(np.int64)
                shift[at] = np.minimum(shift[at], len(ends) - 1 - k)
            order = np.argsort(ends[-1], kind="stable")
            self.tables.append((m, block, shift, ends[-1][order], ends[0][order], [own[i] for i in order], [windows[own[i]] for i in order]))

    def search(self, words):
        """(first word, length, items) of each occurrence of a window."""
        n = len(words.hash)
        counts, bounds = words.counts(), words.bounds()
        pairs = np.concatenate((words.hash[:1], _pair(words.hash[:-1], words.hash[1:]))) if n else words.hash
        for m, block, shift, suffix, prefix, own, items in self.tables:
            rows = np.flatnonzero(counts >= m)
            if not len(rows):
                continue
            ends = words.hash if block == 1 else pairs
            jump = shift[(ends & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
            first, last = bounds[rows] + m - 1, bounds[rows + 1] - 1
            pieces = (last - first) // STRETCH + 1
            which = np.repeat(np.arange(len(rows)), pieces)
            cursor = first[which] + (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
            stop = np.minimum(cursor + STRETCH - 1, last[which])
            found = []
            while len(cursor):
                step = jump[cursor]
                found.append(cursor[step == 0])
                cursor = cursor + np.maximum(step, 1)
                live = cursor <= stop
                cursor, stop = cursor[live], stop[live]
            at = np.concatenate(found)
            low, high = np.searchsorted(suffix, ends[at], "left"), np.searchsorted(suffix, ends[at], "right")
            size = high - low
            pos = np.repeat(at, size)
            pattern = np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            begin = ends[pos - m + block]
            same = prefix[pattern] == begin
            for p, k in zip(pos[same].tolist(), pattern[same].tolist(), strict=True):
                if b" ".join(words.bytes_of(i) for i in range(p - m + 1, p + 1)) == own[k]:
                    yield p - m + 1, m, items[k]


def _windows(window: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                words = scan_words(data, offsets, ALNUM)
                ids, bounds = batch.column("item").slice(a, b - a).to_pylist(), words.bounds()
                out = [
                    (ids[row], b" ".join(words.bytes_of(i) for i in range(j, min(j + window, bounds[row + 1]))))
                    for row in range(b - a)
                    for j in range(bounds[row], max(bounds[row] + 1, bounds[row + 1] - window + 1))
                    if bounds[row] < bounds[row + 1]
                ]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], ["item", "window"])

    return run


def _scan(index):
    def run(batches):
        for batch in batches:
            known = batch.schema.get_field_index("marks") >= 0
            for a, b, data, offsets in text_slices(batch.column("text")):
                words = scan_words(data, offsets, ALNUM)
                counts, bounds = words.counts(), words.bounds()
                edge = np.zeros(len(words.hash) + 1, np.int64)
                items = [set(x) for x in batch.column("items").slice(a, b - a).to_pylist()] if known else [set() for _ in range(b - a)]
                for start, m, found in index.value.search(words):
                    edge[start] += 1
                    edge[start + m] -= 1
                    items[words.owner[start]].update(found)
                hit = np.cumsum(edge[:-1]) > 0
                if known:
                    for row, marks in enumerate(batch.column("marks").slice(a, b - a).to_pylist()):
                        n = counts[row]
                        hit[bounds[row] : bounds[row + 1]] |= np.unpackbits(np.frombuffer(marks, np.uint8), count=n).astype(bool)
                marks = [np.packbits(hit[bounds[i] : bounds[i + 1]]).tobytes() if items[i] else bytes((int(counts[i]) + 7) // 8) for i in range(b - a)]
                n_hit = np.bincount(words.owner[hit], minlength=b - a)
                columns = [
                    batch.column("id").slice(a, b - a), batch.column("text").slice(a, b - a), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(marks, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text", "n_words", "n_hit", "items", "marks"])

    return run


def _digest(batches):
    """The same without texts and marks, for the last shard."""
    for batch in batches:
        items = batch.column("items").to_pylist()
        sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
        n_hit = batch.column("n_hit")
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("n_words"), n_hit, pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array([x > 0 for x in n_hit.to_pylist()]), batch.column("items")],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
        )


def _indexes(items: DataFrame, item_col: str, text_col: str, window: int, shard: int):
    """A broadcast index for each shard of the distinct windows of the items; there is at least one."""
    sc = items.sparkSession.sparkContext
    windows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null")
    windows = cut(windows.mapInArrow(_windows(window), "item string, window binary").distinct())
    shards = max(1, -(-windows.count() // shard))
    for k in range(shards):
        own: dict[bytes, list[str]] = defaultdict(list)
        for item, w in windows.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == k).toLocalIterator():
            own[bytes(w)].append(item)
        yield k == shards - 1, sc.broadcast(Index(own))


def without_windows(docs: DataFrame, items: DataFrame, text_col="text", item_col="item_id", item_text_col="text", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """The rows of docs in whose text no window occurs, with all columns as they are; null texts stay."""

    def keep(index):
        def run(batches):
            for batch in batches:
                at = batch.schema.get_field_index(text_col)
                clean = np.ones(batch.num_rows, bool)
                for a, _, data, offsets in text_slices(batch.column(at)):
                    words = scan_words(data, offsets, ALNUM)
                    for start, _, _ in index.value.search(words):
                        clean[a + words.owner[start]] = False
                yield batch.filter(pa.array(clean))

        return run

    for last, index in _indexes(items, item_col, item_text_col, window, shard):
        docs = docs.mapInArrow(keep(index), docs.schema)
        if not last:  # one index is in memory at a time
            docs = cut(docs)
            index.unpersist()
    return docs


def find_windows(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. A word is hit
    if it lies in any occurrence of a window. Null and wordless texts have no words and no hits;
    items without words have no windows; items with equal windows all count. No items: nothing is
    hit. Rows that repeat an id, or have none, are each returned; no rows give no rows; other columns are
    ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    for last, index in _indexes(items, item_col, item_text_col, window, shard):
        found = docs.mapInArrow(_scan(index), "id long, text string, n_words long, n_hit long, items array<string>, marks binary")
        if not last:
            docs = cut(found)
            index.unpersist()
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")
