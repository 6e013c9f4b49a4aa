"""Filtered lexical and dense search, fusion, policy and one hit per document."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import scoring
from fathom.operators import index


@dataclass(frozen=True)
class Filters:
    """source_ids: empty means no restriction; eligible: the sources that policy allows, None for all."""

    source_ids: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    eligible: tuple[str, ...] | None = None

    def __post_init__(self):
        if unknown := [k for k in self.metadata if not isinstance(k, str)]:
            raise ValueError(f"metadata keys must be names: {unknown}")
        if self.since and self.until and self.since >= self.until:
            raise ValueError("since must be before until")

    @classmethod
    def of(cls, given: dict) -> Filters:
        """From a caller's dictionary; a key that is no filter is an error."""
        known = {"source_ids", "since", "until", "metadata"}
        if unknown := sorted(set(given) - known):
            raise ValueError(f"unknown filters: {', '.join(unknown)}")
        return cls(tuple(given.get("source_ids") or ()), given.get("since"), given.get("until"), dict(given.get("metadata") or {}))

    def condition(self) -> Column:
        """Half-open dates; an unknown date is outside any range; no eligible source matches nothing."""
        found = F.lit(True)
        if self.source_ids:
            found &= F.col("source").isin(*self.source_ids)
        if self.eligible is not None:
            found &= F.col("source").isin(*self.eligible) if self.eligible else F.lit(False)
        if self.since:
            found &= F.col("published_at") >= F.lit(self.since).cast("timestamp")
        if self.until:
            found &= F.col("published_at") < F.lit(self.until).cast("timestamp")
        for key, value in sorted(self.metadata.items()):
            found &= F.col("metadata")[key] == value
        return found


def branch_score(expression, tokens: list[str], part: dict[str, Column], has: dict[str, Column]) -> tuple[Column, Column]:
    """(match, score) of an AND/OR tree over tokens: only satisfied branches score, each occurrence of a token once."""
    if isinstance(expression, str):
        return has[expression], part[expression]
    kind, *children = expression
    pairs = [branch_score(c, tokens, part, has) for c in children]
    match = pairs[0][0]
    for m, _ in pairs[1:]:
        match = (match & m) if kind == "and" else (match | m)
    return match, F.when(match, scoring.total([F.when(m, s).otherwise(0.0) for m, s in pairs])).otherwise(0.0)


def tokens_in(expression) -> list[str]:
    if isinstance(expression, str):
        return [expression]
    return list(dict.fromkeys(t for child in expression[1:] for t in tokens_in(child)))


def _described(hits: DataFrame, ix: index.Index, filters: Filters) -> DataFrame:
    """hits with what their documents state, of documents that pass the filters."""
    return hits.join(ix.documents.where(filters.condition()), "doc_id")


def lexical(ix: index.Index, expression, filters: Filters | None = None) -> DataFrame:
    """(chunk, doc_id, relevance) of chunks that match, by BM25, and what their documents state if there are filters.

    Statistics are over all chunks whatever the filters. An empty expression matches nothing.
    """
    if not expression:
        none = ix.chunks.where(F.lit(False)).select("chunk", "doc_id", F.lit(0.0).alias("relevance"))
        return _described(none, ix, filters) if filters else none
    tokens = tokens_in(expression)
    part = scoring.bm25(scoring.idf(F.col("n_chunks"), F.col("n_with")), F.col("tf"), F.col("dl"), F.col("mean_length"))
    rows = ix.found(tokens).withColumn("part", part).groupBy("chunk")
    if isinstance(expression, str) or all(isinstance(x, str) for x in expression[1:]):
        # one level: parts add up, and a token that stands there twice counts twice
        given = [expression] if isinstance(expression, str) else list(expression[1:])
        again = [t for t in tokens if given.count(t) > 1]
        times = F.coalesce(F.create_map(*(F.lit(x) for t in again for x in (t, given.count(t))))[F.col("token")], F.lit(1)) if again else F.lit(1)
        hits = rows.agg(F.max("doc_id").alias("doc_id"), F.sum(F.col("part") * times).alias("relevance"), F.count(F.lit(1)).alias("n"))
        hits = hits.where(F.col("n") == len(tokens)) if expression[0] == "and" and not isinstance(expression, str) else hits
    else:
        hits = rows.agg(F.max("doc_id").alias("doc_id"), F.map_from_entries(F.collect_list(F.struct("token", "part"))).alias("parts"))
        match, score = branch_score(expression, tokens, {t: F.coalesce(F.col("parts")[t], F.lit(0.0)) for t in tokens}, {t: F.map_contains_key("parts", F.lit(t)) for t in tokens})
        hits = hits.where(match).withColumn("relevance", score)
    hits = hits.select("chunk", "doc_id", "relevance")
    return _described(hits, ix, filters) if filters else hits


def ranked_text(ix: index.Index, tokens: list[str], filters: Filters | None = None) -> DataFrame:
    """(chunk, doc_id, relevance) of chunks with any token, by text-search rank, and what their documents state if there are filters."""
    parts = ix.of_tokens(ix.postings, tokens).groupBy("chunk")
    hits = parts.agg(F.max("doc_id").alias("doc_id"), F.sum(scoring.ts_rank(F.col("tf"), len(tokens))).alias("relevance"))
    return _described(hits, ix, filters) if filters else hits


def eligible_sources(sources: DataFrame, weights: dict[str, float], asked: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Enabled sources that are asked for and whose weight is not 0: what a limited search is held to before its limit."""
    rows = sources.where("enabled").where(F.col("source").isin(*asked) if asked else F.lit(True))
    return tuple(sorted(r.source for r in rows.where(scoring.weight_of(F.col("source"), weights) > 0).select("source").collect()))  # a row for each source


def results(ix: index.Index, hits: DataFrame, policy, now: str, limit: int, url: Column) -> tuple[DataFrame, DataFrame]:
    """(results, totals) from hits (chunk, doc_id, relevance): best chunk of each document under a policy, with what a reader is shown."""
    described = hits.join(ix.documents, "doc_id")
    scored = apply_policy(described, policy.weights, policy.freshness_boost, policy.half_life_days, now)
    totals = described.agg(F.count(F.lit(1)).alias("matched_chunks")).crossJoin(scored.agg(F.countDistinct("doc_id").alias("total")))
    best = top(best_per_document(scored, "doc_id", "score", "chunk"), "score", "doc_id", limit)
    pages = ["page"] if "page" in ix.chunks.columns else []
    shown = ix.texts(best, "start", "end", "text", *pages)
    details = F.struct("relevance", "source_weight", "freshness", (1 + policy.freshness_boost * F.col("freshness")).alias("recency_multiplier"))
    rows = shown.select(
        F.col("doc_id").alias("id"), "title", url.alias("url"), F.col("source").alias("source_id"), "published_at", F.col("text").alias("snippet"), F.struct("start", "end", *pages).alias("citation"), "score", details.alias("score_details"),
    )
    return rows.orderBy(F.col("score").desc(), "id"), totals


def compact(rows: DataFrame) -> DataFrame:
    return rows.select("id", "title", "url")


def apply_policy(hits: DataFrame, weights: dict[str, float], boost: float, half_life_days: float, now: str) -> DataFrame:
    """Adds source_weight, freshness and score; sources of weight 0 go."""
    rows = hits.withColumn("source_weight", scoring.weight_of(F.col("source"), weights)).where("source_weight > 0")
    rows = rows.withColumn("freshness", scoring.freshness(F.col("published_at"), F.lit(now).cast("timestamp"), half_life_days))
    return rows.withColumn("score", scoring.policy_score(F.col("relevance"), F.col("source_weight"), boost, F.col("freshness")))


def best_per_document(hits: DataFrame, document: str, score: str, tie: str) -> DataFrame:
    """The best chunk of each document; the smallest tie key wins among equals."""
    w = Window.partitionBy(document).orderBy(F.col(score).desc(), F.col(tie))
    return hits.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def top(hits: DataFrame, score: str, tie: str, limit: int) -> DataFrame:
    return hits.orderBy(F.col(score).desc(), F.col(tie)).limit(limit)


def fuse(lists: DataFrame, method: str = "rrf", k: int = 60) -> DataFrame:
    """Fuses rows (list_id, item, score) into (item, score): reciprocal ranks, or scores over their list's greatest.

    An item counts once a list, at its best place.
    """
    once = lists.groupBy("list_id", "item").agg(F.max("score").alias("score"))
    if method == "rrf":
        rank = F.row_number().over(Window.partitionBy("list_id").orderBy(F.col("score").desc(), "item"))
        part = once.withColumn("part", 1.0 / (k + rank))
    else:
        positive = F.greatest(F.col("score"), F.lit(0.0))
        peaks = once.groupBy("list_id").agg(F.max(positive).alias("peak"))
        part = once.join(F.broadcast(peaks), "list_id").withColumn("part", positive / F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0))
    return part.groupBy("item").agg(F.sum("part").alias("score"))


def metrics(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Recall, MRR and nDCG at k of each query: ranked (query, item, rank), qrels (query, item, grade)."""
    gains = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = qrels.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("grade").desc(), "item")))
    ideal = ideal.groupBy("query").agg(F.sum((F.col("grade") > 0).cast("int")).alias("positives"), F.sum(F.when(F.col("r") <= k, gains / F.log2(F.col("r") + 1.0))).alias("ideal"))
    hits = ranked.where(F.col("rank") <= k).join(qrels.where("grade > 0"), ["query", "item"])
    hits = hits.groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(gains / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    rows = ideal.where("positives > 0").join(hits, "query", "left")
    return rows.select("query", (F.coalesce("hits", F.lit(0)) / F.col("positives")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def blend(lexical_hits: DataFrame, near: DataFrame, key: str, minimum: float) -> DataFrame:
    """(key, relevance): 0.4 of the lexical relevance over its greatest, and 0.6 of a positive similarity.

    Rows that only near (key, similarity) has need a similarity of at least `minimum`.
    """
    lex = lexical_hits.select(key, F.greatest(F.col("relevance"), F.lit(0.0)).alias("l"))
    peak = lex.agg(F.max("l").alias("peak"))  # one row
    rows = lex.join(near.select(key, F.col("similarity").alias("s")), key, "full_outer").crossJoin(F.broadcast(peak))
    worded = 0.4 * F.coalesce("l", F.lit(0.0)) / F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0)
    meant = 0.6 * F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0))
    return rows.where(F.col("l").isNotNull() | (F.col("s") >= minimum)).select(key, (worded + meant).alias("relevance"))


def nearest(queries: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """(query, key, similarity, rank) of the nearest vectors (key, embedding) of each of a few queries (query, embedding), by exact cosine.

    The queries are broadcast, so the vectors are read once for all of them, and each task passes on `limit` rows a query.
    """
    few = queries.select("query", F.col("embedding").alias("q"))
    near = vectors.select("key", "embedding").crossJoin(F.broadcast(few)).select("query", "key", F.round(scoring.cosine(F.col("embedding"), F.col("q")), 12).alias("similarity")).where("similarity is not null")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "key"))
    return near.withColumn("rank", rank).where(F.col("rank") <= limit)


def page(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def against_baseline(measures: DataFrame, key: str, baseline: str, names: list[str]) -> DataFrame:
    """Difference and relative change of each measure against the row of the baseline; null where that is 0."""
    base = measures.where(F.col(key) == baseline).select(*(F.col(n).alias(f"{n}_base") for n in names)).limit(1)
    rows = measures.crossJoin(F.broadcast(base))
    out = [(F.col(n) - F.col(f"{n}_base")).alias(f"{n}_change") for n in names]
    return rows.select(key, *out, *(F.when(F.col(f"{n}_base") != 0, F.col(n) / F.col(f"{n}_base") - 1).alias(f"{n}_relative") for n in names))
