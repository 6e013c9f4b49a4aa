"""Relevance, freshness and policy as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def idf(n_chunks: Column, n_with: Column) -> Column:
    value = F.log((n_chunks - n_with + 0.5) / (n_with + 0.5))
    return F.when(value > 0, value).otherwise(LEAST_IDF)


def bm25(idf_: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def ts_rank(tf: Column, n_query: int) -> Column:
    """A token's part of a text-search rank with equal weights: 0.1 times its harmonic square sum, normalised."""
    harmonic = F.aggregate(F.sequence(F.lit(1), tf.cast("int")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
    return harmonic * 0.1 / 1.64493406685 / n_query


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is zero or has components that are null or not finite."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((norms > 0) & (norms < float("inf")), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def freshness(published: Column, now: Column, half_life_days: float) -> Column:
    """Halves every half_life_days; a future date counts as now, an unknown one as never."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(published)) / 86_400_000_000)
    return F.when(published.isNull(), 0.0).otherwise(F.pow(F.lit(0.5), age / half_life_days))


def policy_score(relevance: Column, weight: Column, boost: float, fresh: Column) -> Column:
    return relevance * weight * (1 + boost * fresh)


def weight_of(source: Column, weights: dict[str, float]) -> Column:
    """A source's weight, 1 if none is set."""
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.coalesce(table[source], F.lit(1.0))


def softplus(logit: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit)))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def unit(vector: Column) -> Column:
    """The vector over its length in doubles; null if it is empty, zero or has components that are null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(wide, lambda x: x / norm))


def parity(left: Column, right: Column) -> Column:
    """Whether two lists of ids hold the same ids, and in the same order."""
    return F.struct((F.array_sort(left) == F.array_sort(right)).alias("same_ids"), (left == right).alias("same_order"))
