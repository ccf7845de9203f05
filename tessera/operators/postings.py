"""A stored index of sparse vectors: postings by bucket in order of weight, in blocks that know their greatest weight.

A search reads few of them. Some points that hold the heaviest weights of a query give it a score that its n-th best result has at least.
Share that score among the query's buckets, each with a threshold in proportion to its greatest weight: a point below the threshold in all of
them scores less. So only blocks that reach the threshold are read, and only points found there are scored, exactly. That is Fagin's
threshold algorithm, "Optimal aggregation algorithms for middleware" (2001), for tables: two joins with blocks, and one pass over what they name.

Weights must not be negative. Ties go to the smaller id, as everywhere in search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.search import best_sparse
from tessera.sources.tables import broadcast_if_small

#: Postings of a block, and blocks of a query that give the first points.
BLOCK, FIRST = 256, 4
_SLACK = 1 - 1e-9
_BLOCKS = "bucket int, block long, top double, ids array<long>, vals array<double>"


def blocks(points: DataFrame) -> DataFrame:
    """bucket, block, top, ids and vals: the postings of points (id, sparse). Within a bucket, a smaller block has weights that are no less.

    Postings are dealt by range of (bucket, weight, id), so those of a common bucket lie in several tasks.
    """
    entries = points.where("id is not null").select(F.col("id").cast("long").alias("id"), F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("e"))
    order = [F.col("bucket"), F.desc("val"), F.col("id")]
    rows = entries.select(F.col("e.indices").cast("int").alias("bucket"), F.col("e.values").cast("double").alias("val"), "id").repartitionByRange(*order).sortWithinPartitions(*order)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            size = len(batch)
            if not size:
                continue
            bucket, val = batch.column("bucket").to_numpy(), batch.column("val").to_numpy()
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            place = np.arange(size) - np.repeat(first, np.diff(np.r_[first, size]))
            starts = np.flatnonzero(place % BLOCK == 0)
            offsets = pa.array(np.r_[starts, size].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("id", "val")]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(number + np.arange(len(starts))), pa.array(val[starts]), *lists], names=["bucket", "block", "top", "ids", "vals"])
            number += len(starts)

    return rows.mapInArrow(packed, _BLOCKS)


def write_index(points: DataFrame, path: str) -> None:
    """Write blocks and vectors of points (id, sparse) under path, replacing what is there."""
    blocks(points).write.mode("overwrite").parquet(f"{path}/blocks")
    rows = points.where("id is not null and sparse is not null").select(F.col("id").cast("long").alias("id"), "sparse")
    rows.write.option("parquet.bloom.filter.enabled#id", True).mode("overwrite").parquet(f"{path}/vectors")


def _entries(queries: DataFrame) -> DataFrame:
    rows = queries.where("query_id is not null").select("query_id", F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("e"))
    return rows.select("query_id", F.col("e.indices").cast("int").alias("bucket"), F.col("e.values").alias("weight")).where("weight > 0")


def _vectors(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(broadcast_if_small(ids), "id", "left_semi")


def candidates(spark: SparkSession, queries: DataFrame, path: str, n: int) -> DataFrame:
    """id of every point that can be among the n best of any query (query_id, sparse)."""
    stored, vectors = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/vectors")
    # The first block of each bucket, without its postings.
    tops = stored.groupBy("bucket").agg(F.min("block").alias("block"), F.max("top").alias("most"))
    asked = _entries(queries).join(tops, "bucket")
    heaviest = Window.partitionBy("query_id").orderBy(F.desc(F.col("weight") * F.col("most")), "bucket")
    first = asked.withColumn("_n", F.row_number().over(heaviest)).where(F.col("_n") <= FIRST).select("bucket", "block").distinct()
    seeds = stored.join(broadcast_if_small(first), ["bucket", "block"], "left_semi").select(F.explode("ids").alias("id")).distinct()
    scored = best_sparse(queries, _vectors(vectors, seeds), n)
    least = scored.where(F.col("rank") == n).select("query_id", F.col("score").alias("least"))
    total = asked.groupBy("query_id").agg(F.sum(F.col("weight") * F.col("most")).alias("total"))
    shares = total.join(least, "query_id", "left").select("query_id", (F.coalesce("least", F.lit(0.0)) / F.col("total") * _SLACK).alias("share"))
    # Of all queries that have a bucket, the one that asks for the lowest weights decides what is read of it.
    wanted = asked.join(shares, "query_id").groupBy("bucket").agg(F.min(F.col("share") * F.col("most")).alias("threshold"))
    read = stored.join(broadcast_if_small(wanted), "bucket").where(F.col("top") >= F.col("threshold"))
    found = read.select("threshold", F.explode(F.arrays_zip("ids", "vals")).alias("e")).where(F.col("e.vals") >= F.col("threshold"))
    return found.select(F.col("e.ids").alias("id")).distinct()


def search_index(spark: SparkSession, queries: DataFrame, path: str, n: int) -> DataFrame:
    """query_id, id, score and rank of the n best points of each query (query_id, sparse), as search.best_sparse gives them from all points."""
    return best_sparse(queries, _vectors(spark.read.parquet(f"{path}/vectors"), candidates(spark, queries, path, n)), n)


def share_read(spark: SparkSession, queries: DataFrame, path: str, n: int) -> DataFrame:
    """One row: points of the index, those that a search scores, and blocks' postings in all."""
    stored, vectors = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/vectors")
    scored = candidates(spark, queries, path, n).agg(F.count("*").alias("scored"))
    return vectors.agg(F.count("*").alias("points")).join(scored, F.lit(True)).join(stored.agg(F.sum(F.size("ids")).alias("postings")), F.lit(True))
