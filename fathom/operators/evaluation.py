"""Evaluation runs: their summary, their comparison with labels, and what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.operators import search
from fathom.sources import versions

MEASURES = ("recall", "mrr", "ndcg")


def summary(runs: DataFrame) -> DataFrame:
    """(kind, name, runs, recall, mrr, ndcg) of runs (language, degraded, recall, mrr, ndcg; measures are null where nothing is judged):
    over all judged runs, by language, and over those that were not degraded."""
    judged = runs.where("recall is not null")
    means = [F.count(F.lit(1)).alias("runs"), *(F.avg(m).alias(m) for m in MEASURES)]
    kinds = F.array(
        F.struct(F.lit("all").alias("kind"), F.lit("").alias("name")), F.struct(F.lit("language").alias("kind"), F.col("language").alias("name")),
        F.when(~F.col("degraded"), F.struct(F.lit("nondegraded").alias("kind"), F.lit("").alias("name"))),
    )
    return judged.select("*", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).groupBy("k.kind", "k.name").agg(*means)


def health(runs: DataFrame) -> DataFrame:
    """One row of rates over runs (no_answer_expected, returned, failed, degraded, elapsed_ms)."""
    return runs.agg(
        F.count(F.lit(1)).alias("measured_runs"), F.avg(F.when(F.col("no_answer_expected"), (F.col("returned") > 0).cast("double"))).alias("no_answer_return_rate"), F.count_if(F.col("degraded")).alias("degraded"), F.avg(F.col("failed").cast("double")).alias("failure_rate"),
        F.percentile("elapsed_ms", F.lit(0.5)).alias("p50_ms"), F.expr("percentile_disc(0.95) within group (order by elapsed_ms)").alias("p95_ms"),
    )


def mismatches(report: DataFrame, ranked: DataFrame, qrels: DataFrame, k: int = 10, tolerance: float = 1e-12) -> DataFrame:
    """Queries of a saved report (query, recall, mrr, ndcg) whose measures are not those of its rankings under the labels, or that one side lacks."""
    told = report.select("query", *(F.col(m).alias(f"{m}_told") for m in MEASURES))
    rows = told.join(search.metrics(ranked, qrels, k), "query", "full_outer")
    off = F.lit(False)
    for m in MEASURES:
        off |= ~F.coalesce(F.abs(F.col(m) - F.col(f"{m}_told")) <= tolerance, F.lit(False))
    return rows.where(off & ~(F.col("recall").isNull() & F.col("recall_told").isNull())).select("query")


def acceptance(results: DataFrame) -> DataFrame:
    """One row over results (expected, first, found: ids of the first five, cited: whether the snippet is in its document)."""
    return results.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("expected") == F.col("first")).alias("top1"), F.count_if(F.array_contains("found", F.col("expected"))).alias("top5"), F.count_if(F.col("cited")).alias("valid_citations"))


def inputs_fingerprint(**inputs) -> str:
    """SHA-256 of what an evaluation is made from, whatever the order of keys: a checkpoint with another one is not resumed."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


class Changed(ValueError):
    """An evaluation was begun with other cases or inputs."""


def _cases_mark(cases: DataFrame) -> list[str]:
    """Number of cases and a sum of their hashes: the same whatever their order, another one if any column of any case changes."""
    whole = F.xxhash64(F.to_json(F.struct(*sorted(cases.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    told = cases.agg(F.count(F.lit(1)).alias("n"), F.sum(whole).alias("mark"), F.countDistinct("case").alias("different")).first()
    if told.different < told.n:
        raise ValueError("cases need different names")
    return [str(told.n), str(told.mark)]


def evaluated(spark: SparkSession, folder: str, cases: DataFrame, measure: Callable[[DataFrame], DataFrame], inputs: dict, unit: int = 10) -> DataFrame:
    """Results of measure(cases) for all cases, measured `unit` at a time; those that are done when a run breaks off are not measured again.

    cases have a name `case` and what measure needs, labels included; measure returns any number of rows for the cases it is given. A unit's results and
    the names of its cases appear in the ledger (folder) together or not at all. The ledger is bound to the cases and to
    inputs (what else results depend on: snapshot, model, stage): with others it raises Changed and measures nothing. Of two runs at
    once one gets versions.Conflict.
    """
    mark = inputs_fingerprint(cases=_cases_mark(cases), **inputs)
    number, content = versions.latest(spark, folder)
    facts = content.get("facts", {})
    if facts.get("fingerprint", mark) != mark:
        raise Changed("the ledger was begun with other cases or inputs")
    number = versions.publish(spark, folder, {}, facts={"fingerprint": mark, "sessions": facts.get("sessions", 0) + 1}, after=number)
    done = versions.tables(spark, folder)[1].get("finished")
    todo = cases if done is None else cases.join(done, "case", "left_anti")
    todo = todo.withColumn("unit", F.floor((F.row_number().over(Window.orderBy("case")) - 1) / unit)).persist()  # one row for each question
    try:
        for k in range(-(-todo.count() // unit)):
            some = todo.where(F.col("unit") == k).drop("unit")
            number = versions.publish(spark, folder, {}, added={"results": measure(some), "finished": some.select("case")}, after=number)
    finally:
        todo.unpersist()
    found = versions.tables(spark, folder)[1].get("results")
    return measure(cases.limit(0)) if found is None else found


def sessions(spark: SparkSession, folder: str) -> int:
    """How often an evaluation was begun or resumed."""
    return versions.latest(spark, folder)[1].get("facts", {}).get("sessions", 0)


def policy_experiment(ix, expression, policies: dict, now: str, limit: int = 10) -> DataFrame:
    """(policy, doc_id, rank, score): how the same hits rank under each of a few policies."""
    hits = search.lexical(ix, expression, search.Filters())
    parts = []
    for name, p in policies.items():
        scored = search.apply_policy(hits, p.weights, p.freshness_boost, p.half_life_days, now)
        best = search.top(search.best_per_document(scored, "doc_id", "score", "chunk"), "score", "doc_id", limit)
        parts.append(best.select(F.lit(name).alias("policy"), "doc_id", "score"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("policy").orderBy(F.col("score").desc(), "doc_id")))
