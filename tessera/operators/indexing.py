"""Incremental indexing: what changed between two snapshots, and upkeep of the tables that depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import uuid5_url


def diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """path, status, cur_hash and prev_hash; both inputs: path, hash."""
    both = current.select("path", F.col("hash").alias("cur_hash")).join(previous.select("path", F.col("hash").alias("prev_hash")), "path", "full_outer")
    status = F.when(F.col("cur_hash").isNull(), "removed").when(F.col("cur_hash") == F.col("prev_hash"), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"), "cur_hash", "prev_hash")


def changed_only(rows: DataFrame, changes: DataFrame) -> DataFrame:
    return rows.join(changes.where(F.col("status") == "changed"), "path", "left_semi")


def retained(previous: DataFrame, changes: DataFrame) -> DataFrame:
    return previous.join(changes.where(F.col("status").isin("changed", "removed")), "path", "left_anti")


def merge_snapshot(previous: DataFrame, reprocessed: DataFrame, changes: DataFrame) -> DataFrame:
    """What of the previous snapshot still holds, and the reprocessed rows."""
    return retained(previous, changes).unionByName(reprocessed)


def stale_paths(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("status").isin("changed", "removed")).select("path").distinct()


def delete_by_path(points: DataFrame, paths: DataFrame) -> DataFrame:
    return points.join(paths, "path", "left_anti")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """existing with rows of new put in by key; of several new rows the last in order counts."""
    fresh = last_wins(new, key, order)
    return existing.join(fresh, key, "left_anti").unionByName(fresh)


def point_id(scope, chunk):
    """Deterministic id of a chunk of a scope (repository, or repository and branch)."""
    return uuid5_url(F.concat_ws(":", scope, chunk))


def index_increment(current: DataFrame, previous: DataFrame, state: DataFrame, points: DataFrame, process, chunk) -> tuple[DataFrame, DataFrame]:
    """One incremental run: the merged snapshot and the new points.

    current: path, hash and content; previous: path, hash; state and points carry path; process turns changed
    files into state rows, chunk turns those into points.
    """
    changes = diff(current, previous)
    fresh = process(changed_only(current, changes))
    kept = delete_by_path(points, stale_paths(changes))
    return merge_snapshot(state, fresh, changes), kept.unionByName(chunk(fresh))
