"""Points of an index: a chunk's vectors and payload, and their upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import file_type, slug
from tessera.operators.embedding import BATCH
from tessera.operators.indexing import delete_by_path, point_id, upsert
from tessera.operators.search import with_sparse

# The payload, and the prefix of a collection's name.
PAYLOAD = ("repository", "file_path", "file_type", "language", "chunk_type", "module_type", "symbol_name", "source_ref", "dependencies", "text", "chunk_id")
COLLECTION = "repo_chunks"


def payload(chunks: DataFrame) -> DataFrame:
    """The columns of PAYLOAD. chunks: repository, and what chunking.chunks gives."""
    named = chunks.withColumns({"file_path": F.col("path"), "file_type": file_type(F.col("path")), "symbol_name": F.col("symbol")})
    return named.select(*PAYLOAD)


def build_points(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, dense, sparse and the payload of every chunk. Both vectors are columns of the chunk's row, so nothing is paired by position."""
    rows = embed(payload(chunks)).withColumn("id", point_id(F.col("repository"), F.col("chunk_id")))
    return with_sparse(rows).select("id", "dense", "sparse", *PAYLOAD)


def same_size(points: DataFrame, size: int | None = None) -> DataFrame:
    """points, each row checked: a dense vector of another size than the collection's (the first row's, if not given) raises an error when it is read."""
    if size is None:
        first = points.where("dense is not null").select(F.size("dense").alias("n")).first()
        size = first["n"] if first else None
    if size is None:
        return points
    message = F.concat(F.lit(f"the collection expects vectors of {size} numbers, not of "), F.size("dense").cast("string"))
    return points.withColumn("dense", F.when(F.size("dense") == size, F.col("dense")).when(F.col("dense").isNull(), F.col("dense")).otherwise(F.raise_error(message).cast("array<double>")))


def replace_points(existing: DataFrame, new: DataFrame, stale: DataFrame) -> DataFrame:
    """existing without the points of stale files (path), and with the new points put in by id; of equal ids the last chunk counts."""
    left = delete_by_path(existing.withColumn("path", F.col("file_path")), stale).drop("path")
    return upsert(left, new, "id", "chunk_id")


def run_summary(repository: str, points: DataFrame, batch: int = BATCH) -> DataFrame:
    """One row: collection_name, chunk_count, batch_count and vector_dimensions of the points of one run."""
    counted = points.agg(F.count("*").alias("chunk_count"), F.coalesce(F.max(F.size("dense")), F.lit(0)).alias("vector_dimensions"))
    name = slug(F.lit(repository), COLLECTION).alias("collection_name")
    return counted.select(F.lit(repository).alias("repository_name"), name, "chunk_count", F.ceil(F.col("chunk_count") / batch).alias("batch_count"), "vector_dimensions")
