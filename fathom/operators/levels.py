"""The best chunks by BM25 without reading all postings of common words: exact.

A posting adds its token's idf times a gain, a number under K1 + 1 that grows with tf and falls with the chunk's length.
Postings are written by level, an equal part of that range, and a small table holds for each level of a token how many
postings it has and the greatest gain among them. A search reads the topmost levels of its tokens for a threshold that
the last of the wanted chunks reaches at least. It then reads on until what is unread can't add up to that threshold:
any chunk of the answer stands in some level that is read. Few of those chunks can still reach it, and
only for them are the levels below looked up, token by token, by slices of a hash of the chunk.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import scoring
from fathom.operators import index
from fathom.operators.cells import kept
from fathom.operators.search import Filters
from fathom.sources import versions

#: Levels of a token, slices of a level, postings that are first read of a token for each wanted chunk, and how many times more if they don't suffice.
LEVELS, SLICES, FIRST, MORE = 32, 4096, 4, 8
#: Rows of a Parquet page, which is what a scan leaves out; ranges of slices that a scan is given at most.
PAGE, RANGES = 1024, 256
#: Bytes of postings that a task sorts into levels: some millions.
SPLIT = 8 << 20
#: Thresholds are eased by this share, far beyond rounding; scores are rounded to so many places before they rank.
EASE, PLACES = 1e-9, 12


@dataclass(frozen=True)
class Levels:
    """Tables of one version: ranked (token, level, slice, chunk, doc_id, gain, bucket), levels (token, level, n, most, bucket) and facts."""

    ranked: DataFrame
    levels: DataFrame
    buckets: int
    n_chunks: int


@dataclass(frozen=True)
class Found:
    """hits (chunk, doc_id, relevance) in order, and the postings that were read for them: of the first and second pass, and looked up."""

    hits: DataFrame
    read: DataFrame


def _slice(chunk: Column) -> Column:
    return F.pmod(F.crc32(chunk.cast("binary")), F.lit(SLICES)).cast("int")


@contextmanager
def _small_splits(spark: SparkSession):
    """Scans read at most SPLIT bytes in a task."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, str(SPLIT))
        yield
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)


def build(spark: SparkSession, folder: str, ix: index.Index) -> Levels:
    """Publishes the levels of an index's postings; gains are by the mean length of its chunks."""
    known = ix.corpus.first()
    mean = known.n_tokens / known.n_chunks if known.n_chunks and known.n_tokens else 1.0
    gain = scoring.bm25(F.lit(1.0), F.col("tf"), F.col("dl"), F.lit(mean))
    rows = ix.postings.select("token", "chunk", "doc_id", gain.alias("gain"), "bucket")
    rows = rows.withColumns({"level": F.least(F.floor(F.col("gain") * (LEVELS / (scoring.K1 + 1))), F.lit(LEVELS - 1)).cast("int"), "slice": _slice(F.col("chunk"))})
    data, columns = f"{folder}/data-{uuid.uuid4().hex}", lambda df: ", ".join(f"{n} {t}" for n, t in df.dtypes)
    placed = rows.sortWithinPartitions("bucket", "token", "level", "slice")
    with _small_splits(spark):  # postings lie by bucket and token already: each task sorts what it reads, and holds it
        placed.write.partitionBy("bucket").option("parquet.page.row.count.limit", PAGE).option("compression", "zstd").parquet(f"{data}/ranked")
    counted = spark.read.schema(placed.schema).parquet(f"{data}/ranked").groupBy("token", "bucket", "level").agg(F.count(F.lit(1)).alias("n"), F.max("gain").alias("most"))
    counted.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{data}/levels")
    versions.add(spark, folder, versions.latest(spark, folder)[0] + 1, {"tables": {t: f"{data}/{t}" for t in ("ranked", "levels")}, "facts": {"buckets": ix.buckets, "n_chunks": known.n_chunks, "columns": {"ranked": columns(placed), "levels": columns(counted)}}})
    return read(spark, folder)


def read(spark: SparkSession, folder: str) -> Levels:
    content = versions.latest(spark, folder)[1]
    facts = content["facts"]
    table = lambda name: spark.read.schema(facts["columns"][name]).parquet(content["tables"][name])  # noqa: E731 - tables without rows have no files
    return Levels(table("ranked"), table("levels"), facts["buckets"], facts["n_chunks"])


class _Plan:
    """Which levels of each token are read: those of its steps (level, n, most the posting adds), greatest first, before `upto`."""

    def __init__(self, steps: dict[str, list[tuple[int, int, float]]]):
        self.steps, self.upto = steps, dict.fromkeys(steps, 0)

    def unread(self, token: str) -> float:
        """The most that an unread posting of a token adds."""
        at = self.upto[token]
        return self.steps[token][at][2] if at < len(self.steps[token]) else 0.0

    def whole(self) -> bool:
        return all(self.upto[t] == len(s) for t, s in self.steps.items())

    def take(self, rows: int) -> None:
        """So many postings, at least, from the levels that add most."""
        while not self.whole() and sum(n for t, s in self.steps.items() for _, n, _ in s[: self.upto[t]]) < rows:
            self.upto[max(self.steps, key=self.unread)] += 1

    def lower(self, threshold: float) -> None:
        """Reads on, where a posting read lowers the bound most, until unread postings of all tokens add up to less than the threshold."""
        while not self.whole() and sum(map(self.unread, self.steps)) >= threshold:
            gain = {}
            for token, steps in self.steps.items():
                if (at := self.upto[token]) < len(steps):
                    below = steps[at + 1][2] if at + 1 < len(steps) else 0.0
                    gain[token] = (steps[at][2] - below) / steps[at][1]
            self.upto[max(gain, key=gain.get)] += 1

    def condition(self) -> Column:
        """Postings that are read."""
        parts = [(F.col("token") == t) & (F.col("level") >= s[self.upto[t] - 1][0]) for t, s in self.steps.items() if self.upto[t]]
        return reduce(lambda a, b: a | b, parts, F.lit(False))

    def below(self, token: str) -> Column:
        """Postings of a token that are not."""
        return (F.col("token") == token) & (F.col("level") <= self.steps[token][self.upto[token]][0])


def _in_slices(values: list[int]) -> Column:
    """Rows of some slices, and for the scan at most RANGES ranges that hold them: the narrowest gaps are closed."""
    gaps = sorted(range(1, len(values)), key=lambda i: values[i - 1] - values[i])[: RANGES - 1]
    cuts = [0, *sorted(i for i in gaps if values[i] > values[i - 1] + 1), len(values)]
    parts = [F.col("slice").between(values[a], values[b - 1]) for a, b in zip(cuts, cuts[1:]) if a < b]
    while len(parts) > 1:  # a balanced tree
        parts = [a[0] | a[1] if len(a) == 2 else a[0] for a in (parts[i : i + 2] for i in range(0, len(parts), 2))]
    return parts[0] & F.col("slice").isin(*values) if parts else F.lit(False)


def top(lv: Levels, tokens: list[str], limit: int, every: bool = False, documents: DataFrame | None = None, filters: Filters | None = None) -> Found:
    """The `limit` best chunks with any of the tokens, or with every one, of documents that pass the filters; exactly the first of search.lexical.

    A token given twice counts twice. Ties go to the smaller chunk. Statistics are over all chunks whatever the filters.
    The driver holds a row for each level of a token, the limit's scores and the numbers of slices.
    """
    names = list(dict.fromkeys(tokens))
    of_names = F.col("bucket").isin(*sorted({index.bucket_of(t, lv.buckets) for t in names}))
    told = lv.levels.where(of_names & F.col("token").isin(*names)).orderBy("token", F.col("level").desc()).collect()
    n_with = {t: sum(r.n for r in told if r.token == t) for t in names}
    none = lv.ranked.where(F.lit(False))
    if limit < 1 or not any(n_with.values()) or (every and not all(n_with.values())):
        return Found(none.select("chunk", "doc_id", F.lit(0.0).alias("relevance")), none)
    names = [t for t in names if n_with[t]]
    ratio = {t: (lv.n_chunks - n_with[t] + 0.5) / (n_with[t] + 0.5) for t in names}
    weight = {t: (math.log(ratio[t]) if ratio[t] > 1 else scoring.LEAST_IDF) * tokens.count(t) for t in names}
    plan = _Plan({t: [(r.level, r.n, weight[t] * r.most) for r in told if r.token == t] for t in names})
    ranked = lv.ranked.where(of_names)
    number = lambda table: F.create_map(*(F.lit(x) for t in names for x in (t, table[t])))[F.col("token")]
    part = (F.col("gain") * number(weight)).alias("part")

    def seen() -> DataFrame:
        """(chunk, doc_id, part, had): chunks that stand in levels which are read, what their postings there add, and of which tokens these are."""
        rows = ranked.where(plan.condition()).select("chunk", "doc_id", "token", part).groupBy("chunk")
        rows = rows.agg(F.max("doc_id").alias("doc_id"), F.sum("part").alias("part"), F.collect_list("token").alias("had"))
        return rows.join(documents.where(filters.condition()).select("doc_id"), "doc_id", "left_semi") if filters else rows

    def able(rows: DataFrame, pending: list[str], threshold: float | None) -> DataFrame:
        """Chunks that can reach the threshold with what is unread of pending tokens."""
        rest = scoring.total([F.when(~F.array_contains("had", t), plan.unread(t)).otherwise(0.0) for t in pending])
        return rows.where(F.col("part") + rest >= threshold) if threshold is not None else rows

    def reached(rows: DataFrame) -> float | None:
        """What the last of the wanted chunks reaches at least; None if too few are known."""
        rows = rows.where(F.size("had") == len(names)) if every else rows
        best = [r.part for r in rows.select("part").orderBy(F.col("part").desc()).limit(limit).collect()]
        return min(best) * (1 - EASE) if len(best) == limit else None

    rare = min(names, key=n_with.get)
    wanted, threshold = FIRST * limit, None
    if every and n_with[rare] <= MORE * wanted:
        plan.upto[rare] = len(plan.steps[rare])  # what is sought has this token: no threshold is needed
    else:
        plan.take(wanted)
        while (threshold := reached(seen())) is None and not plan.whole():
            wanted *= MORE
            plan.take(wanted)
    if threshold is not None:
        plan.lower(threshold)
    pending = sorted((t for t in names if plan.upto[t] < len(plan.steps[t])), key=plan.unread, reverse=True)
    known, read_ = kept(able(seen(), pending, threshold)), ranked.where(plan.condition())
    while pending:
        token, *pending = pending
        known = able(known, [token, *pending], reached(known))
        lacks = known.where(~F.array_contains("had", token))
        slices = sorted(r[0] for r in lacks.select(_slice(F.col("chunk"))).distinct().collect())  # at most SLICES
        if not slices:
            continue
        looked_up = ranked.where(plan.below(token)).where(_in_slices(slices))
        read_ = read_.unionByName(looked_up)
        met = known.join(looked_up.select("chunk", part.alias("more")), "chunk", "left")
        had = F.when(F.col("more").isNotNull(), F.concat("had", F.array(F.lit(token)))).otherwise(F.col("had"))
        known = met.select("chunk", "doc_id", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("part"), had.alias("had"))
        known = kept(known.where(F.array_contains("had", token)) if every else known)
    rows = known.where(F.size("had") == len(names)) if every else known
    hits = rows.select("chunk", "doc_id", F.round("part", PLACES).alias("relevance")).orderBy(F.col("relevance").desc(), "chunk").limit(limit)
    return Found(hits, read_)
