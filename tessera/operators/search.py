"""Sparse, dense and fused retrieval. Queries and points are tables; a search answers all queries of its table.

A text's sparse vector is made within its row. Queries are a stated set: they go to the tasks in blocks of bounded size, and each
task keeps the best of its points for each query, so that only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import token_bucket
from tessera.functions.text import missing_if_empty
from tessera.sources.tables import broadcast_if_small, work_folder

# The token pattern, the number of buckets, over-fetching, and the fusion constant
# of Cormack, Clarke and Buettcher (2009).
TOKEN = "([A-Za-z_][A-Za-z0-9_./-]{1,63})"
DIMENSIONS = 4096
OVERFETCH = 3
FUSION = 60
#: Queries in one pass over the points, and rows of an Arrow batch that are scored at once.
BLOCK_QUERIES, SLICE_ROWS = 1000, 2048


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), F.lower)


SPARSE = "struct<indices:array<int>,values:array<double>>"


def with_sparse(rows: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, name: str = "sparse") -> DataFrame:
    """rows with the sparse vector of a text: its buckets, ascending, and how many tokens fall in each; null for a null text.

    Tokens are hashed and buckets sorted within the row; the lengths of runs of equal ones, taken over Arrow batches, are the counts.
    """
    place, schema = len(rows.columns), rows.withColumn(name, F.lit(None).cast(SPARSE)).schema
    sorted_buckets = F.sort_array(F.transform(tokens(F.col(text)), lambda t: token_bucket(t, dimensions)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            flat, sizes = _flat(column)
            ends = np.cumsum(sizes)
            first = np.ones(len(flat), bool)
            first[1:] = flat[1:] != flat[:-1]
            first[(ends - sizes)[sizes > 0]] = True
            at = np.flatnonzero(first)
            offsets = pa.array(np.r_[0, np.cumsum(first)][np.r_[0, ends]].astype(np.int32))
            indices = pa.ListArray.from_arrays(offsets, pa.array(flat[at], pa.int32()))
            values = pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.r_[at, len(flat)]).astype(float)))
            yield batch.set_column(place, name, pa.StructArray.from_arrays([indices, values], names=["indices", "values"], mask=column.is_null()))

    return rows.withColumn(name, sorted_buckets).mapInArrow(counted, schema)


def sparse_entries(rows: DataFrame, key: str, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """key, idx and val: the sparse vector of every row in long form. Of rows with one key, the entries are added."""
    vectors = with_sparse(rows.select(key, F.col(text).alias("_text")), "_text", dimensions)
    entries = vectors.select(key, F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("e"))
    return entries.select(key, F.col("e.indices").alias("idx"), F.col("e.values").alias("val"))


def pack_sparse(entries: DataFrame, key: str) -> DataFrame:
    """key, indices and values, by ascending index."""
    packed = entries.groupBy(key, "idx").agg(F.sum("val").alias("val")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "val"))).alias("v"))
    return packed.select(key, F.col("v.idx").alias("indices"), F.col("v.val").alias("values"))


def best(scored: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The n best of each query with their rank; ties go to the smaller key."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def sparse_scores(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """All dot products of queries (query_id, idx, val) with points (id, idx, val) that share a bucket; best_sparse gives the best alone."""
    q = queries.select("query_id", "idx", F.col("val").alias("query_val"))
    return entries.join(broadcast_if_small(q), "idx").groupBy("query_id", "id").agg(F.sum(F.col("val") * F.col("query_val")).alias("score"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_norm(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select(F.col(key).alias("id"), "embedding", F.sqrt(_dot(F.col("embedding"), F.col("embedding"))).alias("norm"))


def _best_of(points: DataFrame, blocks: Callable, scores: Callable, n: int) -> DataFrame:
    """The n best points (id) of each query. blocks: yields (ids of queries, what scores takes); scores: of a batch, queries by rows, NaN where there is none."""
    session, out = points.sparkSession, None
    for pass_number, (ids, block) in enumerate(blocks()):
        if pass_number == 1:  # more than one: what was encoded for the first is written and read from here on
            folder = work_folder(session)
            points.write.parquet(folder)
            points = session.read.schema(points.schema).parquet(folder)
        shared = session.sparkContext.broadcast((ids, block))

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, block = shared.value
            best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
            for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, len(b), SLICE_ROWS)):
                found, own = scores(batch, block), batch.column("id").to_numpy()
                for q, row in enumerate(found):
                    least = best[q][0][-1] if len(best[q][0]) == n else -np.inf
                    at = np.flatnonzero(row >= least)
                    if len(at):
                        score, key = np.concatenate([best[q][0], row[at]]), np.concatenate([best[q][1], own[at]])
                        order = np.lexsort((key, -score))[:n]
                        best[q] = score[order], key[order]
            columns = [np.repeat(ids, [len(b[0]) for b in best]), np.concatenate([b[1] for b in best] or [ids]), np.concatenate([b[0] for b in best] or [np.zeros(0)])]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "id", "score"])

        part = points.mapInArrow(kept, "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return session.createDataFrame([], "query_id long, id long, score double, rank int")
    return best(out, n)


def _blocks(queries: DataFrame, columns: list[str], make: Callable) -> Callable:
    """The queries in blocks of BLOCK_QUERIES, one after the other on the driver."""

    def blocks() -> Iterator[tuple[np.ndarray, object]]:
        rows = queries.where(F.col("query_id").isNotNull()).select("query_id", *columns)
        some = rows.limit(BLOCK_QUERIES + 1).toArrow().combine_chunks()
        if len(some) <= BLOCK_QUERIES:
            if len(some):
                yield some.column("query_id").to_numpy(), make(some)
            return
        passes = -(-rows.count() // BLOCK_QUERIES)
        for n in range(passes):
            own = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n).toArrow().combine_chunks()
            if len(own):
                yield own.column("query_id").to_numpy(), make(own)

    return blocks


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column; a null list is empty."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def best_sparse(queries: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """The n best points (id, sparse) of each query (query_id, sparse) by dot product, of those that share a bucket with it."""

    def matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that queries have, and a column for each of them, plus one of zeros."""
        packed = rows.column("sparse").combine_chunks()
        (idx, sizes), (val, _) = _flat(packed.field("indices")), _flat(packed.field("values"))
        known, column = np.unique(idx.astype(np.int64), return_inverse=True)
        out = np.zeros((len(rows), len(known) + 1))
        out[np.repeat(np.arange(len(rows)), sizes), column] = val
        return known, out

    def scores(batch: pa.RecordBatch, block) -> np.ndarray:
        known, q = block
        packed = batch.column("sparse")
        (idx, sizes), (val, _) = _flat(packed.field("indices")), _flat(packed.field("values"))
        owner = np.repeat(np.arange(len(batch)), sizes)
        column = np.searchsorted(known, idx)
        hit = column < len(known)
        hit[hit] = known[column[hit]] == idx[hit]
        x = np.zeros((len(batch), q.shape[1]))
        x[owner[hit], column[hit]] = val[hit]
        out = q @ x.T
        out[out == 0] = np.nan
        return out

    rows = points.where("id is not null and sparse is not null").select(F.col("id").cast("long").alias("id"), "sparse")
    return _best_of(rows, _blocks(queries.where("size(sparse.indices) > 0"), ["sparse"], matrix), scores, n)


def best_dense(queries: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """The n best points (id, embedding, norm) of each query (query_id, embedding, norm) by cosine, rounded to nine places.

    Vectors are compared with those of their length; without a length of their own (norm 0) they have no cosine.
    """

    def unit(column: pa.Array, norm: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        values, sizes = _flat(column)
        same = (sizes == dim) & (norm > 0)
        rows = values.astype(float)[np.repeat(same, sizes)].reshape(-1, dim)
        return same, rows

    def matrix(rows: pa.Table):
        column, norm = rows.column("embedding").combine_chunks(), rows.column("norm").to_numpy()
        return [(dim, *unit(column, norm, dim), norm) for dim in np.unique(_flat(column)[1]).tolist() if dim]

    def scores(batch: pa.RecordBatch, block) -> np.ndarray:
        norm = batch.column("norm").to_numpy(zero_copy_only=False)
        out = np.full((len(block[0][1]) if block else 0, len(batch)), np.nan)
        for dim, asked, q, q_norm in block:
            same, x = unit(batch.column("embedding"), norm, dim)
            out[np.ix_(asked, same)] = np.round(q @ x.T / (q_norm[asked][:, None] * norm[same][None, :]), 9)
        return out

    rows = points.where("id is not null and embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "norm")
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), "norm").where("embedding is not null")
    return _best_of(rows, _blocks(asked, ["embedding", "norm"], matrix), scores, n)


def fuse(branches: list[DataFrame], n: int, constant: int = FUSION) -> DataFrame:
    """Reciprocal-rank fusion of ranked branches (query_id, id, rank)."""
    ranked = reduce(DataFrame.unionByName, [b.select("query_id", "id", "rank") for b in branches])
    fused = ranked.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    return best(fused, n)


def filtered(points: DataFrame, **equal: str | None) -> DataFrame:
    """Equality filters; an empty or absent value means no filter."""
    return reduce(lambda df, item: df.where(F.col(item[0]) == item[1]) if item[1] else df, equal.items(), points)


def hybrid_search(queries: DataFrame, query_vectors: DataFrame, points: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """query_id, rank, id and score of the fused sparse and dense search.

    queries: query_id, text; query_vectors: query_id, embedding, norm; points: id, text (or sparse); vectors: id, embedding, norm.
    A query without tokens has no sparse branch, so its result is the dense one.
    """
    fetch = max(limit * OVERFETCH, limit)
    encoded = points if "sparse" in points.columns else with_sparse(points)
    sparse = best_sparse(with_sparse(queries), encoded, fetch)
    dense = best_dense(query_vectors, vectors, fetch)
    return fuse([sparse, dense], limit).select("query_id", "rank", "id", "score")


# Results that a request asks for, if it does not say how many, and bounds of that.
DEFAULT_LIMIT, LEAST_LIMIT, MOST_LIMIT = 8, 1, 20


def search_requests(requests: DataFrame) -> DataFrame:
    """requests (query_id, text, limit) with limit filled in where it is null, and error: the field that is out of bounds (text: blank), null if none is."""
    limit = F.coalesce("limit", F.lit(DEFAULT_LIMIT))
    error = F.when(~limit.between(LEAST_LIMIT, MOST_LIMIT), "limit").when(F.coalesce(F.trim("text"), F.lit("")) == "", "text")
    return requests.withColumns({"limit": limit, "error": error})


#: Columns of a search result.
RESULT = ("chunk_id", "score", "text", "repository", "file_path", "file_type", "language", "chunk_type", "module_type", "source_ref", "dependencies")


def search_points(
    queries: DataFrame, points: DataFrame, embed: Callable[[DataFrame], DataFrame], limit: int = 8, repository: str = "", file_type: str = "", module: str = "", language: str = ""
) -> DataFrame:
    """query_id, rank and the columns of RESULT: what a user of an index asks for.

    queries: query_id, text; points: of operators.points.build_points; embed: adds dense to rows with text, as operators.embedding.embedder
    makes it. The filters hold for both branches; where a point has no chunk_id, its id stands for it.
    """
    kept = filtered(points, repository=repository, file_type=file_type, module_type=module, language=language)
    # Points have string ids; the search ranks numbers that keep their order of creation in the index, and ties go to the smaller.
    keyed = kept.withColumn("_id", F.xxhash64("id"))
    norm = lambda rows, key: rows.select(F.col(key), F.col("dense").alias("embedding"), F.sqrt(_dot(F.col("dense"), F.col("dense"))).alias("norm"))
    vectors = norm(keyed, "_id").withColumnRenamed("_id", "id")
    sparse = keyed.select(F.col("_id").alias("id"), "sparse")
    found = hybrid_search(queries.select("query_id", "text"), norm(embed(queries.select("query_id", "text")), "query_id"), sparse, vectors, limit)
    joined = keyed.join(broadcast_if_small(found.withColumnRenamed("id", "_id")), "_id")
    named = joined.withColumn("chunk_id", F.coalesce(missing_if_empty(F.col("chunk_id")), F.col("id")))
    return named.select("query_id", "rank", *RESULT)
