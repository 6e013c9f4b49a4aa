"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few dozen surface features. Shallow trees are boosted cyclically, one feature
after the other at a small step, so that each feature ends with a lookup table over its bins; then
the pairs of features whose coarse grids explain most of what is left get tables of their own.
Scoring looks up bins and adds. The fit uses at most `sample` labelled rows; scoring covers all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import ALNUM, NONSPACE, byte_class, mix64, scan_words, text_slices

#: Most labelled rows that one fit uses, chosen by hash.
SAMPLE = 20_000
BINS, GRID, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, STEP, LEAST = 150, 60, 0.15, 20

FEATURES = (
    "log_bytes", "log_words", "letters", "digits", "upper", "spaces", "sentence_marks", "symbols", "high_bytes", "mean_word", "max_word", "sd_word",
    "short_words", "wordless", "marked_words", "distinct_words", "distinct_pairs", "lines_per_word", "distinct_lines", "mean_line", "top_word", "capital_words",
)
_LETTERS, _DIGITS, _UPPER = byte_class((0x41, 0x5A), (0x61, 0x7A)), byte_class((0x30, 0x39)), byte_class((0x41, 0x5A))
_SPACES, _MARKS, _HIGH = byte_class((0x09, 0x0D), (0x20, 0x20)), byte_class((0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)), byte_class((0x80, 0xFF))
_SYMBOLS = ~(_LETTERS | _DIGITS | _SPACES | _MARKS | _HIGH)
_LINE = ~byte_class((0x0A, 0x0A), (0x0D, 0x0D))


def _distinct(owner: np.ndarray, values: np.ndarray, n: int):
    """(distinct values, most repeats of one value) of each row."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    at = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1]))))
    repeats = np.diff(np.append(at, len(v)))
    most = np.zeros(n)
    np.maximum.at(most, o[at], repeats)
    return np.bincount(o[at], minlength=n).astype(float), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    share = lambda kind: np.diff(np.concatenate(([0], np.cumsum(kind[data], dtype=np.int64)))[offsets]) / np.maximum(size, 1)
    words = scan_words(data, offsets, NONSPACE)
    count = words.counts().astype(float)
    some = np.maximum(count, 1)
    length = (words.end - words.start).astype(float)
    per_word = lambda x: np.bincount(words.owner, x, n) / some
    mean = per_word(length)
    longest = np.zeros(n)
    np.maximum.at(longest, words.owner, length)
    core = ALNUM[data[words.start]] if len(words.start) else np.zeros(0, bool)
    tail = _SYMBOLS[data[words.end - 1]] if len(words.start) else np.zeros(0, bool)
    capital = _UPPER[data[words.start]] if len(words.start) else np.zeros(0, bool)
    distinct, top = _distinct(words.owner, words.hash, n)
    same = words.owner[1:] == words.owner[:-1]
    with np.errstate(over="ignore"):
        pairs = mix64(words.hash[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ words.hash[1:])[same] if len(words.hash) > 1 else words.hash[:0]
    pair_owner = words.owner[:-1][same] if len(words.hash) > 1 else words.owner[:0]
    distinct_pairs, _ = _distinct(pair_owner, pairs, n)
    lines = scan_words(data, offsets, _LINE)
    n_lines = lines.counts().astype(float)
    distinct_lines, _ = _distinct(lines.owner, lines.hash, n)
    return np.stack([
        np.log1p(size), np.log1p(count), share(_LETTERS), share(_DIGITS), share(_UPPER), share(_SPACES), share(_MARKS), share(_SYMBOLS), share(_HIGH), mean, np.log1p(longest),
        np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)), per_word(length <= 3), per_word(~core), per_word(tail), distinct / some,
        distinct_pairs / np.maximum(np.bincount(pair_owner, minlength=n), 1), n_lines / some, distinct_lines / np.maximum(n_lines, 1), np.log1p(size / np.maximum(n_lines, 1)), top / some, per_word(capital),
    ], axis=1)


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray):
    """(gain, cut) of the best split of a histogram; cut 0 if none leaves LEAST rows on both sides."""
    cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = cg**2 / (ch + 1) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain = np.where((cn >= LEAST) & (n.sum() - cn >= LEAST), gain, -1.0)
    k = int(gain.argmax()) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) and gain[k] > 0 else (0.0, 0)


def _tree(g, h, n, leaves: int = 3) -> np.ndarray:
    """Leaf values by bin of a tree of at most so many leaves."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        options = [(*_best_cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in parts]
        gain, cut_, a, b = max(options)
        if not cut_:
            break
        parts.remove((a, b))
        parts += [(a, a + cut_), (a + cut_, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quad(g, h, n) -> np.ndarray:
    """Leaf values of a tree that cuts a grid by one feature, then each side by the other."""
    out = np.zeros(g.shape)
    gain, cut_ = _best_cut(g.sum(1), h.sum(1), n.sum(1))
    for rows in (slice(0, cut_), slice(cut_, None)) if cut_ else (slice(None),):
        _, side = _best_cut(g[rows].sum(0), h[rows].sum(0), n[rows].sum(0))
        for cols in (slice(0, side), slice(side, None)) if side else (slice(None),):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return out


class Additive:
    """Intercept, one lookup table for each feature, and grids for a few pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate / (1 - rate)))
        d = len(FEATURES)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for j in range(d)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.coarse = [np.arange(len(e) + 1) * GRID // (len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if len(y) < 2 * LEAST or y.min() == y.max():
            return
        bins = self.bins(x)
        f = np.full(len(y), self.base)
        counts = [np.bincount(bins[:, j], minlength=len(self.tables[j])) for j in range(d)]
        for _ in range(ROUNDS):
            for j in range(d):
                p = 1 / (1 + np.exp(-f))
                size = len(self.tables[j])
                change = STEP * _tree(np.bincount(bins[:, j], y - p, size), np.bincount(bins[:, j], p * (1 - p), size), counts[j])
                self.tables[j] += change
                f += change[bins[:, j]]
        small = np.stack([c[bins[:, j]] for j, c in enumerate(self.coarse)], 1)
        residual = y - 1 / (1 + np.exp(-f))
        gains = []
        for i in range(d):
            for j in range(i + 1, d):
                cell = small[:, i] * GRID + small[:, j]
                n, r = np.bincount(cell, minlength=GRID**2), np.bincount(cell, residual, GRID**2)
                gains.append((float((r**2 / (n + LEAST)).sum()), i, j, cell, n.reshape(GRID, GRID)))
        chosen = sorted(gains, key=lambda t: -t[0])[:PAIRS]
        grids = [np.zeros((GRID, GRID)) for _ in chosen]
        for _ in range(PAIR_ROUNDS):
            for k, (_, _, _, cell, n) in enumerate(chosen):
                p = 1 / (1 + np.exp(-f))
                change = STEP * _quad(np.bincount(cell, y - p, GRID**2).reshape(GRID, GRID), np.bincount(cell, p * (1 - p), GRID**2).reshape(GRID, GRID), n)
                grids[k] += change
                f += change.reshape(-1)[cell]
        self.pairs = [(i, j, g) for (_, i, j, _, _), g in zip(chosen, grids, strict=True)]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        f = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            f += table[bins[:, j]]
        for i, j, grid in self.pairs:
            f += grid[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return 1 / (1 + np.exp(-f))


def _featured(batches):
    for batch in batches:
        for a, b, data, offsets in text_slices(batch.column("text")):
            x = features(data, offsets)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(a, b - a), rows], ["quality", "x"])


def held_out(id_) -> F.Column:
    return F.crc32(id_.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample: int = SAMPLE) -> Additive:
    """Fits on at most `sample` labelled documents outside the held-out third; null ids and labels don't count. Labels of one id that
    differ count as the larger; of texts that share an id the least one (null: empty) is learned from, so that many are no more rows."""
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("quality")).where("id is not null and quality in (0, 1)")
    chosen = chosen.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most `sample` ids, so the broadcast is bounded
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "quality").agg(F.min("text").alias("text")).select("text", "quality").mapInArrow(_featured, "quality int, x array<double>").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    order = np.lexsort(x.T) if len(rows) else []
    return Additive(x[order], rows["quality"].to_numpy(float)[order])


def score(docs: DataFrame, model: Additive, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Nothing but the text is an input. A null text scores as an empty one; without labels of both
    kinds every score is the smoothed share of label 1. A null id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                s = shared.value.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(s)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
