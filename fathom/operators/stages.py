"""Staged retrieval over chunks and vectors: lexical, dense, hybrid, rrf, rerank and rewrite.

Ranking runs on narrow columns; text joins only the candidates. Every list holds at most `candidates`
rows (1,000 at most) and there are at most three phrasings with two lists each, so the broadcast of
candidates has at most 6,000 rows. Scores are rounded to 12 places before they rank, as sums of
doubles may differ in their last bits from run to run.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import scoring
from fathom.functions.text import lexical_query_tokens
from fathom.operators import index, search

STAGES = ("lexical", "dense", "hybrid", "rrf", "rerank", "rewrite")
MOST_CANDIDATES, POOL, MOST_PHRASINGS, LONGEST_PHRASING = 1000, 50, 3, 500

Embed = Callable[[str], Sequence[float]]
Rewrite = Callable[[str], list[str]]
Rerank = Callable[[str, list[str]], Sequence[float]]


def phrasings(query: str, rewrite: Rewrite | None) -> list[str]:
    """The query and at most two distinct variants; an invalid answer or an error of the rewriter leaves the query alone."""
    if rewrite is None:
        return [query]
    try:
        variants = rewrite(query)
        if not all(isinstance(v, str) and v.strip() and len(v) <= LONGEST_PHRASING for v in variants):
            return [query]
    except Exception:  # noqa: BLE001 - a caller's function must not stop the search
        return [query]
    return list(dict.fromkeys([query, *variants]))[:MOST_PHRASINGS]


def unit_or_error(vector: Sequence[float]) -> list[float]:
    """A query vector as doubles; an empty, zero or non-finite one is an error."""
    found = [float(x) for x in vector]
    if not found or not all(map(math.isfinite, found)) or not any(found):
        raise ValueError("a query vector must be finite and not zero")
    return found


def dense(ix: index.Index, vectors: DataFrame, query_vector: Sequence[float], limit: int, filters: search.Filters | None = None, model: str | None = None) -> DataFrame:
    """(chunk, similarity) of the nearest chunks that have a vector (of one model, if named), by exact cosine; filters hold before the limit."""
    target = F.array(*map(F.lit, unit_or_error(query_vector)))
    vectors = vectors.where(F.col("model_digest") == model) if model is not None else vectors
    owned = ix.chunks.select("chunk", "doc_id")
    owned = owned.join(ix.documents.where(filters.condition()).select("doc_id"), "doc_id", "left_semi") if filters else owned
    near = vectors.join(owned, "chunk", "left_semi").select("chunk", F.round(scoring.cosine(F.col("embedding"), target), 12).alias("similarity"))
    return search.top(near.where("similarity is not null"), "similarity", "chunk", limit)


def candidate_lists(ix: index.Index, vectors: DataFrame | None, stage: str, queries: list[str], embed: Embed | None, candidates: int, filters: search.Filters | None, model: str | None = None) -> DataFrame:
    """(list_id, item, score): the top of each branch for each phrasing; filters hold before the limit."""
    lists = []
    for i, query in enumerate(queries):
        tokens = lexical_query_tokens(query)
        if stage != "dense" and tokens:
            found = search.ranked_text(ix, tokens, filters).select("chunk", F.round("relevance", 12).alias("score"))
            lists.append(search.top(found, "score", "chunk", candidates).select(F.lit(f"lexical{i}").alias("list_id"), F.col("chunk").alias("item"), "score"))
        if stage != "lexical" and vectors is not None and embed is not None:
            found = dense(ix, vectors, embed(query), candidates, filters, model)
            lists.append(found.select(F.lit(f"dense{i}").alias("list_id"), F.col("chunk").alias("item"), F.col("similarity").alias("score")))
    if not lists:
        return ix.chunks.where(F.lit(False)).select(F.lit("").alias("list_id"), F.col("chunk").alias("item"), F.lit(0.0).alias("score"))
    return reduce(DataFrame.unionByName, lists)


def rerank_pool(pool: DataFrame, query: str, score: Rerank) -> DataFrame:
    """Scores a pool of at most POOL rows in one task. Scores that fail, are too few or not finite leave the order as it was."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "chunk"], ascending=[False, True])
        try:
            found = [float(x) for x in score(query, rows["text"].tolist())]
            good = len(found) == len(rows) and all(map(math.isfinite, found))
        except Exception:  # noqa: BLE001 - a caller's function must not stop the search
            good = False
        return rows.assign(score=found if good else rows["score"], reranked=good)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema.fields) + ", reranked boolean"
    return pool.groupBy().applyInPandas(run, schema)


def staged(
    ix: index.Index, vectors: DataFrame | None, query: str, stage: str = "rrf", *, limit: int = 10, candidates: int = 100,
    embed: Embed | None = None, rewrite: Rewrite | None = None, rerank: Rerank | None = None, filters: search.Filters | None = None, model: str | None = None,
) -> DataFrame:
    """(chunk, doc_id, score, reranked): one row per document, the best `limit` of a stage.

    lexical and dense take one list; hybrid adds scores over their list's greatest, rrf reciprocal
    ranks; rerank scores the 50 best documents of rrf anew; rewrite fuses the lists of all phrasings and
    reranks with the original query. Ties go to the smaller key.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    if not query.strip():
        raise ValueError("the query is blank")
    if not 1 <= limit <= candidates <= MOST_CANDIDATES:
        raise ValueError(f"1 <= limit <= candidates <= {MOST_CANDIDATES} must hold")
    if stage == "dense" and (vectors is None or embed is None):
        raise ValueError("the dense stage needs vectors and an embedder")
    queries = phrasings(query, rewrite if stage == "rewrite" else None)
    lists = candidate_lists(ix, vectors, stage, queries, embed, candidates, filters, model)
    if stage in ("lexical", "dense"):
        ranked = lists.select("item", "score")
    else:
        ranked = search.fuse(lists, "normalised" if stage == "hybrid" else "rrf").withColumn("score", F.round("score", 12))
    again = stage in ("rerank", "rewrite") and rerank is not None
    rows = ix.texts(ranked.withColumnRenamed("item", "chunk"), "doc_id", *["text"] * again)
    best = search.best_per_document(rows, "doc_id", "score", "chunk")
    if again:
        best = rerank_pool(search.top(best, "score", "chunk", POOL), query, rerank)
    else:
        best = best.withColumn("reranked", F.lit(False))
    return search.top(best, "score", "chunk", limit).select("chunk", "doc_id", "score", "reranked")
