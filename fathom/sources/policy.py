"""Ranking policy as numbered versions, changed by compare-and-set."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.sources import versions


class PolicyConflict(ValueError):
    """Another writer has changed the policy since it was read."""


@dataclass(frozen=True)
class Policy:
    version: int = 0
    weights: dict[str, float] = field(default_factory=dict)
    freshness_boost: float = 0.0
    half_life_days: float = 30.0

    def __post_init__(self):
        if any(not 0 <= w < float("inf") for w in self.weights.values()) or self.freshness_boost < 0 or self.half_life_days <= 0:
            raise ValueError("weights and boost must not be negative, the half-life must be positive")


def read(spark: SparkSession, folder: str) -> Policy:
    """The newest policy; the default one, version 0, if there is none."""
    number, content = versions.latest(spark, folder)
    return Policy(**content) if number else Policy()


def unknown_sources(policy: Policy, sources: DataFrame, column: str = "source") -> list[str]:
    """Names in a policy, which are few, that no source has."""
    if not policy.weights:
        return []
    have = sources.where(F.col(column).isin(*policy.weights)).select(column).distinct().collect()
    return sorted(set(policy.weights) - {r[0] for r in have})


def update(spark: SparkSession, folder: str, expected: int, policy: Policy, sources: DataFrame | None = None) -> Policy:
    """Writes version expected + 1; of two writers one gets PolicyConflict."""
    if read(spark, folder).version != expected:
        raise PolicyConflict("the policy has changed since it was read")
    if sources is not None and (names := unknown_sources(policy, sources)):
        raise ValueError(f"unknown sources: {', '.join(names)}")
    new = Policy(**{**asdict(policy), "version": expected + 1})
    try:
        versions.add(spark, folder, new.version, asdict(new))
    except versions.Conflict as error:
        raise PolicyConflict("the policy has changed since it was read") from error
    return new


def difference(sources: DataFrame, before: Policy, after: Policy, column: str = "source") -> DataFrame:
    """(source, before, after) of the sources whose weight two policies set differently; a weight that none sets is 1."""
    weight = lambda p: F.coalesce(F.create_map(*(F.lit(x) for kv in p.weights.items() for x in kv))[F.col(column)] if p.weights else F.lit(None).cast("double"), F.lit(1.0)).cast("double")
    rows = sources.select(column).distinct().select(column, weight(before).alias("before"), weight(after).alias("after"))
    return rows.where("before <> after")
