"""Near-duplicate texts by weighted Jaccard: BagMinHash signatures, banding, exact verification.

A document is the multiset of its five-word shingles (lower-cased runs of letters and digits; a
text of one to four words is one shingle). For each shingle a Poisson process runs over dyadic
slabs of the discretised weight axis, [0,1), [1,2), [2,4), ...; each slab has a process of its own
(together they are one process on the axis, from which a weight takes what lies under it). Each point carries a time, a height
inside its slab and a signature slot, and counts if its height lies under the shingle's weight. A
slot keeps its earliest point, so two slots agree with probability sum(min)/sum(max). Points are
made only up to a time by which all slots are expected to be full; a text that still has an empty
slot is run again to twice that time, so the early stop never changes a signature.

What is compared are distinct texts, not ids: each has a number of its own, so an id that repeats
with other words is several texts. Candidates come from bands of the signature and every link is
confirmed on the multisets themselves. A bucket is first compared with its smallest member only (a
star). In a bucket whose members then still belong to different components, members outside the
commonest component seek partners in other components: the bucket is dealt by hash into parts, each
member once, and the seekers go to every part. They are compared on their signatures, each pair in
the first band that it shares only; the texts of members that look alike are then compared in the
part, and a part reports a forest of links. So a bucket of n copies costs about n pairs, and still
no pair across components goes unseen.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import ALNUM, MOST_BROADCAST, components, cut, mix64, partitions, scan_words, text_slices, without

SLOTS, ROWS = 96, 4
BANDS = SLOTS // ROWS
#: Signature agreement from which a pair across components is verified: five standard deviations under 0.8.
LOOKS_ALIKE = 0.6
#: Members of one part of a star, and of one part of a bucket.
STAR, PART = 256, 512
#: Keys of texts that must move are broadcast up to this many; beyond, all texts are shuffled to meet them.
BROADCAST_IDS = MOST_BROADCAST
#: A digest shared by many rows is joined over so many partitions.
SALT = 16
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of `width` words; a shorter non-empty row has one of all its words."""
    h, owner = words.hash, words.owner
    n = len(h)
    with np.errstate(over="ignore"):
        coded = [mix64(h ^ _K[i % 5] * np.uint64(i // 5 + 1)) for i in range(width)]
        if n >= width:
            ok = owner[: n - width + 1] == owner[width - 1 :]
            total = sum((coded[i][i : n - width + 1 + i] for i in range(1, width)), coded[0][: n - width + 1])
            rows, out = owner[: n - width + 1][ok], mix64(total[ok])
        else:
            rows, out = owner[:0], h[:0]
        counts, bounds = words.counts(), words.bounds()
        for row in np.flatnonzero((counts > 0) & (counts < width)):
            at = bounds[row]
            short = sum((coded[i][at + i] for i in range(1, counts[row])), coded[0][at])
            rows, out = np.append(rows, row), np.append(out, mix64(np.array([short ^ np.uint64(counts[row])])))
    return rows, out


def bags(data: np.ndarray, offsets: np.ndarray, width: int = 5):
    """Multisets of shingles of some texts: words, and (row, shingle, weight) sorted by row and shingle."""
    words = scan_words(data, offsets, ALNUM)
    rows, sh = shingles(words, width)
    order = np.lexsort((sh, rows))
    rows, sh = rows[order], sh[order]
    if not len(sh):
        return words, rows, sh, np.zeros(0, np.int64)
    new = np.concatenate(([True], (sh[1:] != sh[:-1]) | (rows[1:] != rows[:-1])))
    at = np.flatnonzero(new)
    return words, rows[at], sh[at], np.diff(np.append(at, len(sh)))


def signatures(rows: np.ndarray, sh: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash signatures (n x slots, uint32) of the bags given as (row, shingle, weight)."""
    out = np.zeros((n, slots), np.uint32)
    if not len(rows):
        return out
    slabs = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(rows)), slabs)
    level = np.arange(len(at)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    owner, limit = rows[at], weight[at].astype(float)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    with np.errstate(over="ignore"):
        key = mix64(sh[at] ^ (level.astype(np.uint64) * _K[1]))
    total = np.bincount(rows, weight, n)
    stop = slots * (math.log(slots) + 4) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[owner])
        time, step = np.zeros(len(live)), 0
        slot_, time_, mark_ = [], [], []
        while len(live):
            with np.errstate(over="ignore"):
                r = mix64(key[live] + np.uint64(step) * _K[2])
                s = mix64(r ^ _K[3])
            time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width[live]
            ok = time <= stop[owner[live]]
            live, time, s = live[ok], time[ok], s[ok]
            under = low[live] + width[live] * (s >> np.uint64(40)).astype(float) * 2.0**-24 < limit[live]
            slot_.append(owner[live][under] * slots + ((s[under] >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64) * slots // 65536)
            time_.append(time[under])
            mark_.append((mix64(s[under]) >> np.uint64(32)).astype(np.uint32))
            step += 1
        slot, time, mark = map(np.concatenate, (slot_, time_, mark_))
        order = np.lexsort((time, slot))
        slot, mark = slot[order], mark[order]
        first = np.concatenate(([True], slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, bool)
        full = np.bincount(slot[first] // slots, minlength=n) == slots
        keep = first & full[slot // slots]
        out.reshape(-1)[slot[keep]] = mark[keep]
        todo &= ~full
        stop = stop * 2
    return out


def _signed(batches):
    for batch in batches:
        for a, b, data, offsets in text_slices(batch.column("text")):
            ids, null = batch.column("id").slice(a, b - a), batch.column("text").slice(a, b - a).is_null().to_numpy(False)
            words, rows, sh, weight = bags(data, offsets)
            sig = signatures(rows, sh, weight, b - a)
            counts, bounds = words.counts(), words.bounds()
            digest = []
            for i, doc in enumerate(ids.to_pylist()):
                if counts[i]:
                    raw = words.hash[bounds[i] : bounds[i + 1]].tobytes()
                else:
                    raw = b"null %d" % doc if null[i] and doc is not None else b"null" if null[i] else b"text " + data[offsets[i] : offsets[i + 1]].tobytes()
                digest.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("t").slice(a, b - a), pa.array(digest, pa.binary()), pa.array([s.tobytes() if c else None for s, c in zip(sig, counts, strict=True)], pa.binary())],
                ["id", "t", "digest", "sig"],
            )


def _banded(batches):
    for batch in batches:
        ids = batch.column("node").to_numpy()
        if not len(ids):
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(ids), BANDS, ROWS).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = mix64(np.arange(BANDS, dtype=np.uint64) * _K[4])[None, :]
            for k in range(ROWS):
                key = mix64(key ^ sig[:, :, k])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, BANDS)), pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(ids)))], ["node", "bucket", "band"])


def _verified(threshold: float):
    def run(batches):
        group, hub = None, None
        for batch in batches:
            names = {c: batch.column(c) for c in ("hub", "parts", "part", "role", "node")}
            cols = {c: v.to_numpy() for c, v in names.items()}
            for a, b, data, offsets in text_slices(batch.column("text")):
                _, rows, sh, weight = bags(data, offsets)
                at = np.searchsorted(rows, np.arange(b - a + 1))
                left, right = [], []
                for i in range(b - a):
                    bag = sh[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]
                    key = tuple(int(cols[c][a + i]) for c in ("hub", "parts", "part"))
                    if cols["role"][a + i] == 0:
                        group, hub = key, (bag[0].copy(), bag[1].copy(), int(bag[1].sum()))
                        continue
                    if key != group:
                        raise ValueError(f"no text for the star of {key}")
                    if not len(hub[0]):
                        continue
                    where = np.minimum(np.searchsorted(hub[0], bag[0]), len(hub[0]) - 1)
                    same = hub[0][where] == bag[0]
                    shared = int(np.minimum(hub[1][where[same]], bag[1][same]).sum())
                    if shared >= threshold * (hub[2] + int(bag[1].sum()) - shared) - 1e-9:
                        left.append(int(cols["node"][a + i]))
                        right.append(key[0])
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _needed(texts: DataFrame, keys: DataFrame, broadcast: int) -> DataFrame:
    """The texts of some keys (id, t), filtered before any shuffle where the keys are few."""
    keys = keys.select(*KEY).distinct()
    return texts.join(F.broadcast(keys), _same(texts, keys), "left_semi") if keys.count() <= broadcast else texts


KEY = ["id", "t"]


def _same(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["t"] == b["t"])


def _with_text(texts: DataFrame, rows: DataFrame, broadcast: int) -> DataFrame:
    own = _needed(texts, rows, broadcast)
    return rows.join(own, _same(rows, own)).select(*(rows[c] for c in rows.columns), own["text"])


def _verify(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float, broadcast: int) -> DataFrame:
    """Links (a, b) among pairs (node, hub, n): each part of a star meets one copy of its hub's text.

    Stars of many members are dealt in parts of about STAR.
    """
    stars = pairs.withColumn("parts", F.ceil(F.col("n") / STAR)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    stars = cut(stars.select("node", "hub", "parts", "part"))
    need = stars.withColumn("role", F.lit(1)).unionByName(stars.select(F.col("hub").alias("node"), "hub", "parts", "part").distinct().withColumn("role", F.lit(0)))
    rows = _with_text(texts, need.join(nodes, "node"), broadcast)
    rows = rows.repartition(partitions(texts.sparkSession), "hub", "parts", "part").sortWithinPartitions("hub", "parts", "part", "role")
    return rows.select("hub", "parts", "part", "role", "node", "text").mapInArrow(_verified(threshold), "a long, b long")


class _Part:
    """The members of one part of a bucket, and the seekers that pass by; bags are there in the second pass only."""

    def __init__(self, band: int):
        self.band, self.node, self.comp, self.outer, self.sig, self.bag = band, [], [], [], [], []
        self.open = True

    def add(self, node, comp, outer, sig, bag) -> None:
        for have, more in zip((self.node, self.comp, self.outer, self.sig), (node, comp, outer, sig), strict=True):
            have.append(more)
        self.bag += bag

    def close(self) -> None:
        self.open = False
        self.node, self.comp, self.outer, self.sig = (np.concatenate(x) for x in (self.node, self.comp, self.outer, self.sig))
        self.hope, self.merged = np.zeros(len(self.node), bool), {}

    def likely(self, node, comp, sig):
        """(seeker, member) of other components that look alike and share no earlier band; of two seekers the smaller seeks."""
        for a in range(0, len(node), 128):
            same = sig[a : a + 128, None, :] == self.sig[None, :, :]
            ok = (same.mean(2) >= LOOKS_ALIKE) & (comp[a : a + 128, None] != self.comp) & ~(self.outer & (self.node <= node[a : a + 128, None]))
            i, j = np.nonzero(ok)
            first = same[i, j].reshape(len(i), BANDS, ROWS).all(2).argmax(1) == self.band
            yield from zip((i[first] + a).tolist(), j[first].tolist(), strict=True)

    def current(self, comp: int) -> int:
        while comp in self.merged:
            comp = self.merged[comp]
        return comp

    def links(self, node, comp, sig, bag, threshold: float):
        """Verified links; once two components have met in a part, there are no more between them."""
        for i, j in self.likely(node, comp, sig):
            x, y = self.current(int(comp[i])), self.current(int(self.comp[j]))
            if x == y:
                continue
            (sh, weight), (other, times) = bag[i], self.bag[j]
            at = np.minimum(np.searchsorted(sh, other), len(sh) - 1)
            same = sh[at] == other
            shared = int(np.minimum(weight[at[same]], times[same]).sum())
            if shared >= threshold * (int(weight.sum()) + int(times.sum()) - shared) - 1e-9:
                self.merged[y] = x
                yield int(node[i]), int(self.node[j])


_PART_KEY = ["bucket", "band", "part"]


def _runs(batches, text: bool):
    """(part, None or seekers) from rows sorted by part and role; a part without further rows comes with None."""
    key, part = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*_PART_KEY, "role")], 1)
        node, comp, outer = batch.column("node").to_numpy(), batch.column("comp").to_numpy(), batch.column("outer").to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(node), SLOTS)
        bag = []
        if text:
            for a, b, data, offsets in text_slices(batch.column("text")):
                _, rows, sh, weight = bags(data, offsets)
                at = np.searchsorted(rows, np.arange(b - a + 1))
                bag += [(sh[x:y].copy(), weight[x:y].copy()) for x, y in zip(at[:-1], at[1:], strict=True)]
        at = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
        for a, b in zip(at, [*at[1:], len(keys)], strict=True):
            if tuple(keys[a, :3]) != key:
                if part is not None:
                    yield key, part, None
                key, part = tuple(keys[a, :3]), _Part(int(keys[a, 1]))
            rows = node[a:b], comp[a:b], outer[a:b], sig[a:b], bag[a:b]
            if keys[a, 3] == 0:
                part.add(*rows)
            elif part.node is not None and (part.open is False or part.node):
                if part.open:
                    part.close()
                yield key, part, rows
    if part is not None:
        yield key, part, None


def _hopeful(batches):
    """Rows of a part (seekers: role 1) with a likely partner."""

    def told(key, role, node, comp, outer, sig):
        n = len(node)
        columns = [pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int32()), pa.array([key[2]] * n, pa.int32()), pa.array([role] * n, pa.int32()), pa.array(node), pa.array(comp), pa.array(outer), pa.array([x.tobytes() for x in sig], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [*_PART_KEY, "role", "node", "comp", "outer", "sig"])

    for key, part, seekers in _runs(batches, False):
        if seekers is None:
            if not part.open and part.hope.any():
                yield told(key, 0, *(x[part.hope] for x in (part.node, part.comp, part.outer, part.sig)))
            continue
        node, comp, outer, sig, _ = seekers
        hope = np.zeros(len(node), bool)
        for i, j in part.likely(node, comp, sig):
            hope[i] = part.hope[j] = True
        if hope.any():
            yield told(key, 1, node[hope], comp[hope], outer[hope], sig[hope])


def _across(threshold: float):
    """Links across components inside a part, verified on the bags."""

    def run(batches):
        for _, part, seekers in _runs(batches, True):
            if seekers is None:
                continue
            node, comp, _, sig, bag = seekers
            found = list(part.links(node, comp, sig, bag, threshold))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def text_key(text) -> F.Column:
    """With the id, what tells the texts of rows apart."""
    return F.xxhash64(text.isNull(), text)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, part: int = PART, broadcast: int = BROADCAST_IDS) -> DataFrame:
    """One row per row of docs: id, t (text_key), class_id, first: whether no (id, t) of the class is smaller, null ids last."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("t", text_key(F.col("text")))
    signed = cut(docs.mapInArrow(_signed, "id long, t long, digest binary, sig binary"))
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "t")
    groups = signed.groupBy("digest").agg(F.min(order).alias("r"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.select("digest", "n", "r.id", "r.t", "sig", F.monotonically_increasing_id().alias("node")))
    nodes = groups.select("node", *KEY)
    banded = cut(groups.where("sig is not null").select("node", "sig").mapInArrow(_banded, "node long, bucket long, band int"))

    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALT)).cast("int").alias("salt")
    salts = F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt")
    stars = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("*", salts)
    # only rows of buckets with company go further; most buckets hold one text
    met = cut(banded.select("*", salt("node")).join(stars, ["bucket", "salt"]).select("node", "bucket", "band", "salt", "hub", "n"))
    pairs = met.where("node <> hub").groupBy("node", "hub").agg(F.max("n").alias("n"))
    # rows that repeat both id and text have one text here
    repeats = signed.groupBy(*KEY).count().where("count > 1")
    texts = docs if repeats.isEmpty() else _needed(docs, nodes, broadcast).groupBy(*KEY).agg(F.first("text").alias("text"))
    links = cut(_verify(texts, nodes, pairs, threshold, broadcast))

    roots = cut(components(links))
    named = met.join(roots, "node", "left").select("node", "bucket", "band", "salt", "n", F.coalesce("component", "node").alias("comp"))
    kinds = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("of")).groupBy("bucket").agg(F.max_by("comp", F.struct("of", "comp")).alias("commonest"), F.count(F.lit(1)).alias("kinds"))
    mixed = named.join(kinds.where("kinds > 1").select("bucket", "commonest", salts), ["bucket", "salt"]).join(groups.select("node", "sig"), "node")
    mixed = mixed.withColumn("outer", F.col("comp") != F.col("commonest")).withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    rows = lambda df, role, at: df.select("bucket", "band", at.alias("part"), F.lit(role).alias("role"), "node", "comp", "outer", "sig")
    rest = rows(mixed, 0, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).unionByName(rows(mixed.where("outer"), 1, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    together = lambda df: df.repartition(partitions(docs.sparkSession), *_PART_KEY).sortWithinPartitions(*_PART_KEY, "role", "node")
    hopeful = cut(together(rest).mapInArrow(_hopeful, "bucket long, band int, part int, role int, node long, comp long, outer boolean, sig binary"))
    if not hopeful.isEmpty():
        more = _with_text(texts, hopeful.join(nodes, "node"), broadcast).select(*_PART_KEY, "role", "node", "comp", "outer", "sig", "text")
        links = cut(links.union(together(more).mapInArrow(_across(threshold), "a long, b long")))
        roots = cut(components(links))

    # the class of a component is its smallest id; a component may hold a third of all texts, so it is met in many places
    linked = groups.select("node", *KEY, salt("node")).join(roots, "node")
    firsts = linked.groupBy("component").agg(F.min(order).alias("least")).select("component", "least", salts)
    linked = linked.join(firsts, ["component", "salt"]).select("node", "least")
    named = groups.join(linked, "node", "left").select("digest", "n", *KEY, F.coalesce("least", order).alias("least"))
    shared = named.where("n > 1").select("digest", "least", salts)
    copies = signed.select(*KEY, "digest", salt(*KEY)).join(shared, ["digest", "salt"]).select(*KEY, "least")
    found = named.where("n = 1").select(*KEY, "least").union(copies)
    return found.select(*KEY, F.col("least.id").alias("class_id"), (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("t") == F.col("least.t"))).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, part: int = PART, broadcast: int = BROADCAST_IDS) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), kept (it is that one).

    Classes are the components of links of weighted Jaccard >= threshold over five-word shingles.
    Texts with equal words are one text from the start. A null text is alone; empty or wordless
    texts meet only exact copies of themselves. Rows that repeat an id with other words are texts of
    their own, and may be of several classes. A row without an id is of the class of its text, and
    kept only if that has no id at all; the class is then null. No rows give no rows; other columns
    are ignored.
    """
    found = classes(docs, id_col, text_col, threshold, part, broadcast)
    return found.select(F.col("id").alias("doc_id"), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row of docs for each class, with all columns: that of the smallest id, null ids last.

    Rows that share an id and differ in words are different documents. Of rows that repeat both id
    and text, one stays, that whose other columns come first as JSON.
    """
    names = docs.columns
    keyed = docs.withColumn("__i", F.col(id_col).cast("long")).withColumn("__t", text_key(F.col(text_col).cast("string")))
    found = cut(classes(docs, id_col, text_col, threshold).select(F.col("id").alias("__a"), F.col("t").alias("__b"), "first"))
    same = F.col("__i").eqNullSafe(F.col("__a")) & (F.col("__t") == F.col("__b"))
    kept = without(keyed, cut(found.where("not first").select("__a", "__b").distinct()), same)
    again = found.where("first").groupBy("__a", "__b").count().where("count > 1").select("__a", "__b")
    if not again.isEmpty():
        row = F.struct(*names)
        once = kept.join(again, same, "left_semi").groupBy("__i", "__t").agg(F.min_by(row, F.to_json(row)).alias("row"))
        kept = kept.join(again, same, "left_anti").select(*names).unionByName(once.select(*(F.col("row")[c].alias(c) for c in names)))
    return kept.select(*names)
