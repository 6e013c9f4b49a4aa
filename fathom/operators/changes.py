"""Upserts, staleness and deletion on immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_of(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key of a batch: that which comes last."""
    row = F.struct(*batch.columns)
    return batch.groupBy(key).agg(F.max_by(row, order).alias("__row")).select("__row.*")


def actions(current: DataFrame, incoming: DataFrame, key: str, mark: str, content: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns of incoming to keep, action, reindex) of an upsert: created, updated or unchanged by fingerprint; reindex if the content differs.

    Rows of current that the batch doesn't name are left alone. Null marks are values like others. The
    batch has a row for each key (last_of).
    """
    new = incoming.select(key, *keep, F.col(mark).alias("new_mark"), F.col(content).alias("new_content"))
    old = current.select(key, F.col(mark).alias("old_mark"), F.col(content).alias("old_content"), F.lit(True).alias("known"))
    rows = new.join(old, key, "left")
    fresh = F.col("known").isNull()
    action = F.when(fresh, "created").when(F.col("old_mark").eqNullSafe(F.col("new_mark")), "unchanged").otherwise("updated")
    return rows.select(key, *keep, action.alias("action"), (fresh | ~F.col("old_content").eqNullSafe(F.col("new_content"))).alias("reindex"))


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The next snapshot: rows of the batch, one for each key (last_of), replace those with their key."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def drift(left: DataFrame, right: DataFrame, key: str, mark: str) -> DataFrame:
    """Keys whose marks differ between two tables, with the side that lacks them, if any; null marks are values like others."""
    side = lambda df, m, has: df.select(key, F.col(mark).alias(m), F.lit(True).alias(has))
    rows = side(left, "l", "in_l").join(side(right, "r", "in_r"), key, "full_outer")
    state = F.when(F.col("in_l").isNull(), "missing_left").when(F.col("in_r").isNull(), "missing_right").when(~F.col("l").eqNullSafe(F.col("r")), "changed")
    return rows.select(key, state.alias("state")).where("state is not null")


def unembedded(chunks: DataFrame, vectors: DataFrame, key: str, content: str = "content_hash") -> DataFrame:
    """Chunks without a vector of their present text: the join is on key and content, so no old vector meets a new text."""
    return chunks.join(vectors.select(key, content), [key, content], "left_anti")


def owned_elsewhere(claims: DataFrame, held: DataFrame) -> DataFrame:
    """Claims (root, path, document_id) on documents that another file of held (root, path, document_ids) has."""
    have = held.select(F.col("root").alias("r"), F.col("path").alias("p"), F.explode("document_ids").alias("d"))
    other = ~(F.col("root").eqNullSafe(F.col("r")) & F.col("path").eqNullSafe(F.col("p")))
    return claims.join(have, (F.col("document_id") == F.col("d")) & other, "left_semi")


def with_ids(held: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """(key, document_ids): those that a file had and those that it has now, sorted."""
    have = lambda df, name: df.select(key, F.col("document_ids").alias(name))
    rows = have(held, "a").join(have(more, "b"), key, "full_outer")
    none = F.array().cast("array<string>")
    return rows.select(key, F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("b", none))).alias("document_ids"))


def whole_files(records: DataFrame, path: str = "path", error: str = "error") -> DataFrame:
    """Records of files without a bad record: a file is taken whole or not at all."""
    bad = records.where(F.coalesce(F.col(error), F.lit("")) != "").select(path).distinct()
    return records.join(bad, path, "left_anti")


def counts(acts: DataFrame) -> DataFrame:
    """How many rows each action has."""
    return acts.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
