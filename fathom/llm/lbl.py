"""Language-model scores: a two-level log-bilinear model trained with noise-contrastive estimation.

Every counted token is in the model. The commonest tokens are classes of their own; all others are
dealt to groups, and inside a group to leaves: one leaf a token by rank, as many leaves as the
counted vocabulary asks for, and from LEAVES on tokens beyond the ranked ones share leaves by hash.
The model predicts a class from the two before it: context vectors pass a matrix for each place,
and their sum's products with the class vectors, plus biases, are scores. A second softmax, from
the class just before and the vectors of a group's leaves, predicts the leaf. Counts are dealt by
hash into shards, as many as the counts ask for; a shard trains the classes in numpy, with noise
from the class frequencies, and the shards' parameters are averaged by weight, round by round; then
each group's leaves are trained on the group's counts. The model is a function of the rows alone,
whatever their partitions. Batched matrix products give the logarithm of the normaliser of every
context over all classes, and of every context and group over all leaves; a token's score is a dot
product less its normalisers. Tokens that share a leaf divide it by smoothed count, so that a
text's probabilities are normalised over all tokens, with one unseen token for each shared leaf.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import NONSPACE, cut, mix64, partitions, scan_words, text_slices

CLASSES, WIDTH = 512, 24
#: Leaves of a group that its vocabulary doesn't go beyond; from there on, a quarter of them is shared by hash.
LEAVES = 512
#: Tokens whose counts are broadcast (16 bytes each); the others meet their counts in a join.
COMMON = 1 << 18
ROUNDS, LEAF_ROUNDS, BATCH, NOISE, STEP = 2, 2, 1024, 32, 0.1
#: Training tokens that ask for another shard, and the most shards: as many models meet in the driver.
PER_SHARD, SHARDS = 1 << 19, 32
#: Least steps that a group's leaves are trained for: a group of few different counts is gone over more often.
LEAF_STEPS = 64
#: Counts that a merging task holds before it adds them up, and that one row carries at most.
MERGED, PIECE = 1 << 22, 1 << 20
SMOOTH = 0.1
#: Distinct values that a task holds before it passes them on.
HELD = 1 << 21
END = np.uint64(0x5851F42D4C957F2D)


def held_out(id_) -> F.Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(row, hash) of each token: lower-cased runs of anything but white space, then one end for each text."""
    words = scan_words(data, offsets, NONSPACE)
    ends = words.bounds()[1:]
    return np.insert(words.owner, ends, np.arange(words.rows)), np.insert(words.hash, ends, END)


class _Counter:
    """Counts of integers, passed on when many."""

    def __init__(self, name: str):
        self.name, self.keys, self.counts, self.size = name, [], [], 0

    def add(self, values: np.ndarray) -> None:
        keys, counts = np.unique(values, return_counts=True)
        self.keys.append(keys), self.counts.append(counts)
        self.size += len(keys)

    def drain(self, least: int = 0):
        """(keys, counts) to pass on, or None."""
        if self.size <= least or not self.size:
            return None
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(at, np.concatenate(self.counts)).astype(np.int64)
        self.keys, self.counts, self.size = [keys], [counts], len(keys)
        if len(keys) <= least // 2:
            return None  # merging was enough
        self.keys, self.counts, self.size = [], [], 0
        return keys, counts

    def take(self, least: int = 0):
        keys, counts = self.drain(least) or ((), ())
        for a in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000].view(np.int64)), pa.array(counts[a : a + 100_000])], [self.name, "c"])


def _counted(batches):
    counter = _Counter("h")
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column("text")):
            counter.add(tokens(data, offsets)[1])
            yield from counter.take(HELD)
    yield from counter.take()


class Tree:
    """Classes and leaves of a vocabulary: single tokens 0, 1, ... by rank, then groups with their leaves."""

    def __init__(self, types: int, classes: int):
        self.classes, self.singles = classes, max(0, classes // 2 - 1)
        self.groups = classes - self.singles
        need = -(-max(0, types - self.singles) // self.groups)
        self.own = need if need < LEAVES else LEAVES * 3 // 4
        self.shared = 1 if need < LEAVES else LEAVES - self.own
        self.leaves = self.own + self.shared
        self.size = self.singles + self.groups * self.leaves

    def place(self, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Leaf of each token; a token without a rank (-1) or beyond the own leaves has a shared one by hash."""
        r, m = rank - self.singles, mix64(h)
        group = np.where(r < self.groups * self.own, r % self.groups, 0)
        found = np.where(r < 0, rank, self.singles + group * self.leaves + r // self.groups)
        hashed = self.singles + (m % np.uint64(self.groups)).astype(np.int64) * self.leaves + self.own + (m // np.uint64(self.groups) % np.uint64(self.shared)).astype(np.int64)
        return np.where((rank < 0) | (r >= self.groups * self.own), hashed, found)

    def kind(self, leaf: np.ndarray) -> np.ndarray:
        """Class of each leaf."""
        return np.where(leaf < self.singles, leaf, self.singles + (leaf - self.singles) // self.leaves)

    def is_shared(self, leaf: np.ndarray) -> np.ndarray:
        return (leaf >= self.singles) & ((leaf - self.singles) % self.leaves >= self.own)


class Common:
    """Counts of the commonest tokens, and the leaf of any token."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tree: Tree):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.rank, self.tree = hashes[order], counts[order], order, tree

    def look_up(self, h: np.ndarray):
        """(known here, count or 0, leaf) of each token."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), self.tree.place(np.full(len(h), -1), h)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return known, np.where(known, self.counts[at], 0), self.tree.place(np.where(known, self.rank[at], -1), h)


def _shared_leaves(common):
    def run(batches):
        for batch in batches:
            h, c = batch.column("h").to_numpy().view(np.uint64), batch.column("c")
            leaf = common.value.look_up(h)[2]
            keep = common.value.tree.is_shared(leaf)
            yield pa.RecordBatch.from_arrays([pa.array(leaf[keep]), c.filter(pa.array(keep))], ["leaf", "c"])

    return run


def _contexts(row: np.ndarray, kind: np.ndarray, classes: int):
    """Classes one and two places before each token; `classes` stands for the start."""
    one, two = np.full(len(kind), classes), np.full(len(kind), classes)
    one[1:] = np.where(row[1:] == row[:-1], kind[:-1], classes)
    two[2:] = np.where(row[2:] == row[:-2], kind[:-2], classes)
    return one, two


def _pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys under 2^31 as their compressed differences, and compressed counts."""
    return pa.compress(np.diff(keys, prepend=0).astype(np.int32).tobytes(), "zstd", asbytes=True), pa.compress(counts.astype(np.int64).tobytes(), "zstd", asbytes=True)


def _unpack(n: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(pa.decompress(keys, 4 * n, "zstd", asbytes=True), np.int32)
    return np.cumsum(keys, dtype=np.int64), np.frombuffer(pa.decompress(counts, 8 * n, "zstd", asbytes=True), np.int64)


def _rows(groups: list[tuple], names: list[str]) -> pa.RecordBatch:
    """A batch of rows (group columns ..., n, keys, counts) from (group ..., keys, counts)."""
    packed = [(*g[:-2], len(g[-2]), *_pack(*g[-2:])) for g in groups]
    kinds = [pa.int64()] * (len(names) + 1) + [pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in packed], kind) for k, kind in enumerate(kinds)], [*names, "size", "codes", "c"])


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _trigrams(common, shards: int, parts: int):
    """Counts of class trigrams, dealt by hash into shards and each shard into parts."""

    def told(keys, counts):
        place = (mix64(keys.astype(np.uint64)) % np.uint64(shards * parts)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(shards * parts + 1))
        some = np.flatnonzero(np.diff(bounds)).tolist()
        return _rows([(p % shards, p // shards, keys[order[bounds[p] : bounds[p + 1]]], counts[order[bounds[p] : bounds[p + 1]]]) for p in some], ["shard", "part"])

    def run(batches):
        counter, tree = _Counter("code"), common.value.tree
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                row, h = tokens(data, offsets)
                kind = tree.kind(common.value.look_up(h)[2])
                one, two = _contexts(row, kind, tree.classes)
                counter.add((two * (tree.classes + 1) + one) * (tree.classes + 1) + kind)
                if found := counter.drain(HELD):
                    yield told(*found)
        if found := counter.drain():
            yield told(*found)

    return run


def _summed(batches):
    """Adds up the counts of each part of a shard, from rows sorted by both."""
    held, keys, counts = None, [], []

    def done():
        k, c = _added(keys, counts)
        for a in range(0, len(k), PIECE):
            yield _rows([(*held, k[a : a + PIECE], c[a : a + PIECE])], ["shard", "part"])

    for batch in batches:
        for shard, part, n, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (shard, part) != held:
                if held is not None:
                    yield from done()
                held, keys, counts = (shard, part), [], []
            x, y = _unpack(n, k, c)
            keys.append(x), counts.append(y)
            if sum(map(len, keys)) > MERGED and len(keys) > 1:
                x, y = _added(keys, counts)
                keys, counts = [x], [y]
    if held is not None:
        yield from done()


def _targets(classes: int):
    """Counts by target class."""

    def run(batches):
        total = np.zeros(classes + 1)
        for batch in batches:
            for n, k, c in zip(*(batch.column(x).to_pylist() for x in ("size", "codes", "c")), strict=True):
                keys, counts = _unpack(n, k, c)
                total += np.bincount(keys % (classes + 1), counts, classes + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    return run


def _leaf_counts(common):
    """Counts of leaves after a class: for each group, leaves and contexts in one number, with their counts."""

    def packed(keys, counts, tree):
        group, code = np.divmod(keys, tree.leaves * (tree.classes + 1))
        bounds = np.searchsorted(group, np.arange(tree.groups + 1))
        return _rows([(g, code[bounds[g] : bounds[g + 1]], counts[bounds[g] : bounds[g + 1]]) for g in np.flatnonzero(np.diff(bounds)).tolist()], ["g"])

    def run(batches):
        counter, tree = _Counter("code"), common.value.tree
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                row, h = tokens(data, offsets)
                leaf = common.value.look_up(h)[2]
                one, _ = _contexts(row, tree.kind(leaf), tree.classes)
                inner = leaf >= tree.singles
                counter.add(((leaf - tree.singles) * (tree.classes + 1) + one)[inner])
                if found := counter.drain(HELD):
                    yield packed(*found, tree)
        if found := counter.drain():
            yield packed(*found, tree)

    return run


def _add_rows(out: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out[at[first]] += np.add.reduceat(x[order], first)


def _log_sums(logits: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials of each row."""
    top = logits.max(1, keepdims=True)
    return top[:, 0] + np.log(np.exp(logits - top).sum(1))


def nce(q, r, bias, log_noise, y, w, drawn):
    """(up, down) of a batch of noise-contrastive estimation: the gradient of the scores of the data and of the noise.

    q are context vectors, y their targets with weights w, drawn the noise that the batch shares.
    """
    shift = log_noise + math.log(len(drawn))
    data = np.einsum("ij,ij->i", q, r[y]) + (bias - shift)[y]
    fake = q @ r[drawn].T + (bias - shift)[drawn]
    return w / (1 + np.exp(np.clip(data, -30, 30))), -w[:, None] / (1 + np.exp(-np.clip(fake, -30, 30)))


def _adagrad(pairs, squares, n: int, step: float) -> None:
    for (x, g), s in zip(pairs, squares, strict=True):
        g = g / n
        s += g * g
        x += step * g / np.sqrt(s)


class LogBilinear:
    """Parameters: class vectors (the last is the start), a matrix for each context place, biases."""

    def __init__(self, classes: int = CLASSES, width: int = WIDTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.r = rng.normal(0, 0.1, (classes + 1, width)).astype(np.float32)
        self.one, self.two = np.eye(width, dtype=np.float32) * 0.5, np.eye(width, dtype=np.float32) * 0.3
        self.bias = np.zeros(classes, np.float32)

    def parameters(self):
        return [self.r, self.one, self.two, self.bias]

    def packed(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.parameters()]).astype(np.float64)

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for x in self.parameters():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def gradients(self, two, one, y, w, drawn, log_noise):
        """The NCE gradient of a batch for each parameter, summed."""
        classes = len(self.bias)
        x1, x2 = self.r[one], self.r[two]
        q = x1 @ self.one + x2 @ self.two
        up, down = nce(q, self.r, self.bias, log_noise, y, w, drawn)
        dq = up[:, None] * self.r[y] + down @ self.r[drawn]
        vectors = np.zeros(self.r.shape, np.float32)
        _add_rows(vectors, np.concatenate((y, drawn, one, two)), np.concatenate((up[:, None] * q, down.T @ q, dq @ self.one.T, dq @ self.two.T)))
        biases = np.bincount(y, up, classes) + np.bincount(drawn, down.sum(0), classes)
        return [vectors, x1.T @ dq, x2.T @ dq, biases.astype(np.float32)]

    def train(self, two, one, target, weight, noise: np.ndarray, step: float, seed: int) -> None:
        """One pass of NCE over weighted trigrams, with noise classes shared by a batch and Adagrad steps."""
        rng = np.random.default_rng(seed)
        squares = [np.full(x.shape, 1e-6, np.float32) for x in self.parameters()]
        log_noise = np.log(noise).astype(np.float32)
        order = rng.permutation(len(target))
        drawn = rng.choice(len(self.bias), (-(-len(order) // BATCH), NOISE), p=noise)
        scale = (weight / weight.mean()).astype(np.float32)
        for k, a in enumerate(range(0, len(order), BATCH)):
            at = order[a : a + BATCH]
            grads = self.gradients(two[at], one[at], target[at], scale[at], drawn[k], log_noise)
            _adagrad(zip(self.parameters(), grads, strict=True), squares, len(at), step)

    def normalisers(self) -> np.ndarray:
        """Log of the normaliser over all classes after each pair of classes [two, one]."""
        first, second, r = self.r @ self.one, self.r @ self.two, self.r[:-1].T
        return np.stack([_log_sums((first + x) @ r + self.bias) for x in second]).astype(np.float32)


class Leaves:
    """Vectors and biases of the leaves of each group, over the contexts of a trained class model."""

    def __init__(self, model: LogBilinear, tree: Tree):
        self.tree, self.context = tree, model.r @ model.one
        self.r = np.zeros((tree.groups, tree.leaves, self.context.shape[1]), np.float32)
        self.bias = np.full((tree.groups, tree.leaves), -math.log(tree.leaves), np.float32)

    def train(self, group: int, counts: np.ndarray) -> None:
        """NCE over the counts (leaves x contexts) of one group; starts from its unigram shares, which the noise has too."""
        rng = np.random.default_rng(group)
        target, one = np.nonzero(counts)
        weight = counts[target, one].astype(np.float64)
        noise = counts.sum(1) + SMOOTH
        noise = noise / noise.sum()
        log_noise = np.log(noise).astype(np.float32)
        r, bias = self.r[group], log_noise.copy()
        squares = [np.full(r.shape, 1e-4, np.float32), np.full(bias.shape, 1e-4, np.float32)]
        scale = (weight / weight.mean()).astype(np.float32)
        rounds = max(LEAF_ROUNDS, -(-LEAF_STEPS // -(-len(target) // BATCH)))
        for k in range(rounds):
            order = rng.permutation(len(target))
            drawn = rng.choice(len(bias), (-(-len(order) // BATCH), NOISE), p=noise)
            for j, a in enumerate(range(0, len(order), BATCH)):
                at = order[a : a + BATCH]
                q, y = self.context[one[at]], target[at]
                up, down = nce(q, r, bias, log_noise, y, scale[at], drawn[j])
                grad = np.zeros(r.shape, np.float32)
                _add_rows(grad, np.concatenate((y, drawn[j])), np.concatenate((up[:, None] * q, down.T @ q)))
                grad_b = np.bincount(y, up, len(bias)) + np.bincount(drawn[j], down.sum(0), len(bias))
                _adagrad(((r, grad), (bias, grad_b.astype(np.float32))), squares, len(at), STEP / (1 + 2 * k / rounds))
        self.bias[group] = bias

    def normalisers(self) -> np.ndarray:
        """Log of the normaliser over the leaves of each group after each class [group, one]."""
        return np.stack([_log_sums(self.context @ r.T + b) for r, b in zip(self.r, self.bias, strict=True)]).astype(np.float32)


class Scorer:
    """Normalised log10 probabilities of tokens from the two levels and the tables of their normalisers."""

    def __init__(self, model: LogBilinear, leaves: Leaves):
        self.tree = leaves.tree
        self.first, self.second, self.r, self.bias, self.whole = model.r @ model.one, model.r @ model.two, model.r, model.bias, model.normalisers()
        self.leaf_r, self.leaf_bias = leaves.r.reshape(-1, leaves.r.shape[2]), leaves.bias.reshape(-1)
        self.inside = leaves.normalisers()

    def of_class(self, two: np.ndarray, one: np.ndarray, kind: np.ndarray) -> np.ndarray:
        score = np.einsum("ij,ij->i", self.first[one] + self.second[two], self.r[kind]) + self.bias[kind]
        return (score - self.whole[two, one]).astype(float) / math.log(10)

    def of_leaf(self, one: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """0 for a class of a single token."""
        out = np.zeros(len(leaf))
        inner = leaf >= self.tree.singles
        spot, before = leaf[inner] - self.tree.singles, one[inner]
        score = np.einsum("ij,ij->i", self.first[before], self.leaf_r[spot]) + self.leaf_bias[spot]
        out[inner] = (score - self.inside[spot // self.tree.leaves, before]).astype(float) / math.log(10)
        return out


def _shared(model, noise, step, round_, classes):
    def run(batches):
        def done():
            code, count = _added(*zip(*parts, strict=True))
            code = code.astype(np.int32)
            own = LogBilinear(classes).load(model.value)
            own.train(code // (classes + 1) ** 2, code // (classes + 1) % (classes + 1), code % (classes + 1), count.astype(np.float32), noise, step, round_)
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([float(count.sum())]), pa.array([own.packed().tobytes()], pa.binary())], ["shard", "weight", "model"])

        held, parts = None, []
        for batch in batches:
            for shard, _, n, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if shard != held and parts:
                    yield done()
                    parts = []
                held = shard
                parts.append(_unpack(n, k, c))
        if parts:
            yield done()

    return run


_PACKED = "size long, codes binary, c binary"


def count_trigrams(training: DataFrame, common, n_tokens: int) -> DataFrame:
    """Counts of class trigrams in shards (shard, part, size, codes, c); rows of a shard lie in one partition.

    Shards are as many as the tokens ask for, so which model comes out depends on the rows alone. Each is added up in
    several parts where there are more partitions than shards; all counts together are at most (classes + 1)^3.
    """
    shards = min(SHARDS, 1 + n_tokens // PER_SHARD)
    parts = -(-partitions(training.sparkSession) // shards) if shards == SHARDS else 1
    rows = training.mapInArrow(_trigrams(common, shards, parts), "shard long, part long, " + _PACKED)
    rows = rows.repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part").mapInArrow(_summed, "shard long, part long, " + _PACKED)
    if parts > 1:
        rows = rows.repartition(shards, "shard").sortWithinPartitions("shard")
    return cut(rows)


def fit(trigrams: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> LogBilinear:
    """Trains on the shards of count_trigrams."""
    spark = trigrams.sparkSession
    model = LogBilinear(classes)
    rows = trigrams.mapInArrow(_targets(classes), "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()  # a row for each class
    if not rows:
        return model
    noise = np.ones(classes)
    for r in rows:
        noise[r.k] += r.n
    noise /= noise.sum()
    model.bias[:] = np.log(noise)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model.packed())
        done = trigrams.mapInArrow(_shared(shared, noise, STEP / (1 + k), k, classes), "shard long, weight double, model binary").collect()  # a model for each shard
        done.sort(key=lambda r: r.shard)
        total = sum(r.weight for r in done)
        model.load(sum(np.frombuffer(r.model) * (r.weight / total) for r in done))
        shared.unpersist()
    return model


def _grown(model, tree):
    def run(batches):
        leaves, held, counts = Leaves(LogBilinear(tree.classes).load(model.value), tree), None, None

        def done():
            leaves.train(held, counts)
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([leaves.r[held].tobytes()], pa.binary()), pa.array([leaves.bias[held].tobytes()], pa.binary())], ["g", "r", "bias"])

        for batch in batches:
            for g, n, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if g != held:
                    if held is not None:
                        yield done()
                    held, counts = g, np.zeros((tree.leaves, tree.classes + 1), np.int64)
                code, c = _unpack(n, k, c)
                counts.reshape(-1)[code] += c  # a piece names each place once
        if held is not None:
            yield done()

    return run


def fit_leaves(counts: DataFrame, model: LogBilinear, tree: Tree) -> Leaves:
    """Trains the leaves of each group on the packed counts of leaves after a class, a group in one task; counts add up to
    one table of leaves and contexts however many pieces there are."""
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast(model.packed())
    counts = counts.repartition(min(tree.groups, partitions(spark)), "g").sortWithinPartitions("g")
    leaves = Leaves(model, tree)
    for r in counts.mapInArrow(_grown(shared, tree), "g long, r binary, bias binary").collect():  # the model once, 13 MB at most
        leaves.r[r.g], leaves.bias[r.g] = np.frombuffer(r.r, np.float32).reshape(leaves.r[r.g].shape), np.frombuffer(r.bias, np.float32)
    return leaves


def _scored(common, scorer, leaf_total):
    names = ["row", "id", "n_tokens", "n_known", "base", "lm", "n_rest", "rest"]

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                row, h = tokens(data, offsets)
                n = b - a
                known, count, leaf = common.value.look_up(h)
                tree = common.value.tree
                kind = tree.kind(leaf)
                one, two = _contexts(row, kind, tree.classes)
                lm = scorer.value.of_class(two, one, kind) + scorer.value.of_leaf(one, leaf)
                own = np.where(known, np.log10(count + SMOOTH), 0.0)
                lm = lm + np.where(tree.is_shared(leaf), own - np.log10(leaf_total.value[leaf]), 0.0)
                rest = ~known
                r, g = row[rest], h[rest]
                order = np.lexsort((g, r))
                r, g = r[order], g[order]
                at = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])))) if len(g) else np.zeros(0, np.int64)
                times = np.diff(np.append(at, len(g)))
                items = pa.StructArray.from_arrays([pa.array(g[at].view(np.int64)), pa.array(times, pa.int64())], ["h", "times"])
                rests = pa.ListArray.from_arrays(pa.array(np.searchsorted(r[at], np.arange(n + 1)), pa.int32()), items)
                sums = lambda x: np.bincount(row, x, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(a, n), batch.column("id").slice(a, n), pa.array(np.bincount(row, minlength=n), pa.int64()), pa.array(sums(known).astype(np.int64)), pa.array(sums(own)), pa.array(sums(lm)), pa.array(sums(rest).astype(np.int64)), rests], names
                )

    return run


def commonest(counts: DataFrame, size: int) -> DataFrame:
    """At most `size` tokens (h, c), from the highest counts on, chosen by histograms and not by sorting.

    Counts fall into eighths of octaves. The octave part in which the tokens become too many is
    divided by hash, so which of its tokens are taken does not depend on partitions.
    """
    part, spot = F.floor(F.log2("c") * 8), F.pmod("h", F.lit(4096))
    taken, edge = 0, -1
    for r in sorted(counts.groupBy(part.alias("part")).count().collect(), key=lambda r: -r.part):  # some 500 rows at most
        if taken + r["count"] > size:
            edge = r.part
            break
        taken += r["count"]
    if edge < 0:
        return counts
    below = 0
    for r in sorted(counts.where(part == edge).groupBy(spot.alias("spot")).count().collect(), key=lambda r: r.spot):  # 4096 rows at most
        if taken + r["count"] > size:
            break
        taken, below = taken + r["count"], r.spot + 1
    return counts.where((part > edge) | ((part == edge) & (spot < below)))


def score(docs: DataFrame, id_col="doc_id", text_col="text", classes: int = CLASSES, common_size: int = COMMON) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id, modulo 10, is 0 are held out of all counts and training; those
    without an id are not. A null text is an empty one: its only token is the end. Token identity
    is a 64-bit hash of the lower-cased bytes. Rows that repeat an id count and are returned singly;
    other columns are ignored. Without training rows all counts are 0 and the model is untrained; no rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    training = docs.where(~held_out(F.col("id"))).select("text")
    counts = cut(training.mapInArrow(_counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    sizes = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(sizes.n or 0), int(sizes.v)
    top = commonest(counts, common_size).toPandas().sort_values(["c", "h"], ascending=[False, True])  # at most common_size tokens
    hashes, freq = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    tree = Tree(v, classes)
    common = spark.sparkContext.broadcast(Common(hashes, freq, tree))
    packed = training.mapInArrow(_leaf_counts(common), "g long, " + _PACKED)
    model = fit(count_trigrams(training, common, n), classes)
    scorer = spark.sparkContext.broadcast(Scorer(model, fit_leaves(packed, model, tree)))
    totals = np.full(tree.size, SMOOTH)
    for r in counts.mapInArrow(_shared_leaves(common), "leaf long, c long").groupBy("leaf").agg(F.sum(F.col("c") + SMOOTH).alias("t")).collect():  # groups times shared leaves at most
        totals[r.leaf] += r.t
    totals = spark.sparkContext.broadcast(totals)
    schema = "row long, id long, n_tokens long, n_known long, base double, lm double, n_rest long, rest array<struct<h:long,times:long>>"
    scored = cut(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_scored(common, scorer, totals), schema))
    # the rest: tokens beyond the common ones, counted or never seen
    rest = scored.select("row", F.explode("rest").alias("x")).select("row", "x.h", "x.times").join(counts, "h", "left")
    c = F.coalesce("c", F.lit(0))
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.log10(c + SMOOTH)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("found"))
    whole = math.log10(n + SMOOTH * (v + 1))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rest").join(rest, "row", "left").select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("lm") + more).alias("score"),
    )
