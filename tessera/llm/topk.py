"""Exact top-k inner-product search by pivot-table elimination.

Distances from every vector to a few dozen pivots are computed once and stored. For a query q and a candidate x, the
largest |d(q, p) - d(x, p)| over the pivots p is a lower bound of d(q, x), and with it

    (|q|^2 + |x|^2 - bound^2) / 2

an upper bound of the inner product. Candidates are evaluated in the order of that bound, best first, until it falls
below the k-th best score found so far; nothing that could still enter the result is left out. The pivots
are rows themselves, so their own scores give the first k-th best.

Queries are handled in blocks of bounded size, one pass over the partitioned table after the other: only one block is on the
driver and the executors at a time, and of each pass only its queries' best rows are written.

Defined results: vectors that are null or hold a null or non-finite component take no part; scores
are between vectors of one length; a query row is no candidate for itself, nor is any row of its id; repeated query
ids are asked once, and the first of several vectors (in array order) is the query; repeated candidate rows count
once each; ties go to the smaller id; with fewer candidates than k all are returned; other columns are not read; no rows give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import discard, materialize

#: Pivots, the rows that they are chosen from, queries in a pass over the table, and queries bounded together.
PIVOTS, PIVOT_ROWS, PASS_QUERIES, BLOCK = 128, 2000, 20_000, 128
SCALE = 256


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, floor(SCALE * component), of all vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = embeddings.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & finite)
    return valid.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def choose_pivots(rows: list[tuple[int, list[int]]], n: int = PIVOTS) -> list[tuple[int, list[int]]]:
    """Farthest-first: each next pivot is the row whose nearest pivot is farthest. Of one length only."""
    if not rows:
        return []
    rows = sorted(rows)
    dim = max({len(v) for _, v in rows}, key=lambda d: sum(len(v) == d for _, v in rows))
    rows = [r for r in rows if len(r[1]) == dim]
    x = np.array([v for _, v in rows], dtype=float).reshape(len(rows), dim)
    chosen = [0]
    nearest = np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n, len(rows)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return [rows[i] for i in chosen]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = x.astype(float), pivots.astype(float)
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (x @ p.T)
    return np.sqrt(np.maximum(square, 0))


def pivot_matrix(pivots: list[tuple[int, list[int]]]) -> np.ndarray:
    return np.array([v for _, v in pivots], np.int64).reshape(len(pivots), len(pivots[0][1]) if pivots else 0)


def pivot_table(vectors: DataFrame, pivots: list[tuple[int, list[int]]]) -> DataFrame:
    """Adds d, the distances to the pivots (empty where the vector's length is another)."""
    table = pivot_matrix(pivots)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            same = v.value_lengths().to_numpy(zero_copy_only=False) == table.shape[1]
            d: list = [[]] * len(batch)
            if len(pivots) and same.any():
                rows = distances(_matrix(v.filter(pa.array(same)), table.shape[1]), table)
                for i, row in zip(np.flatnonzero(same).tolist(), rows):
                    d[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, pa.array(d, pa.list_(pa.float64()))], names=["vec_id", "v", "d"])

    return vectors.mapInArrow(measured, "vec_id long, v array<long>, d array<double>")


class Search:
    """Best candidates of a block of queries of one length, over batches of candidates."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, d: np.ndarray, k: int, pivot_ids: np.ndarray, pivots: np.ndarray):
        self.ids, self.q, self.d, self.k = ids, q, d, k
        self.norm = (q.astype(float) ** 2).sum(1)
        self.least = np.full(len(ids), -np.inf)
        if pivots.shape[1] == q.shape[1] and len(pivots) > k:
            scores = np.where(pivot_ids[None, :] == ids[:, None], -np.inf, self._dot(q, pivots).astype(float))
            self.least = np.sort(scores, axis=1)[:, -k]
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    @staticmethod
    def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        top = max(1, np.abs(a).max(initial=0)) * max(1, np.abs(b).max(initial=0)) * max(1, a.shape[1])
        if top < 2**53:  # then floating-point sums of products are exact
            return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
        return a @ b.T

    def bounds(self, rows: slice, norm: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of some queries and all candidates of a batch."""
        low = np.zeros((rows.stop - rows.start, len(norm)), np.float32)
        apart = np.empty_like(low)
        mine, theirs = self.d[rows].astype(np.float32), d.astype(np.float32)
        for p in range(min(d.shape[1], self.d.shape[1])):
            np.subtract(mine[:, p][:, None], theirs[:, p][None, :], out=apart)
            np.maximum(low, np.abs(apart, out=apart), out=low)
        # A difference of two rounded numbers is wrong by their rounding errors at most.
        most = max(np.abs(mine).max(initial=0), np.abs(theirs).max(initial=0))
        low = np.maximum(low.astype(float) - 4e-7 * most - 1e-6, 0)
        return (self.norm[rows][:, None] + norm[None, :]) / 2 * (1 + 1e-12) - low * low / 2 + 0.5

    def take(self, ids: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        norm = (v.astype(float) ** 2).sum(1)
        for a in range(0, len(self.ids), BLOCK):
            rows = slice(a, min(a + BLOCK, len(self.ids)))
            upper = self.bounds(rows, norm, d)
            for i in range(rows.start, rows.stop):
                up = upper[i - a]
                open_ = np.flatnonzero((up >= self.least[i]) & (ids != self.ids[i]))
                order = open_[np.argsort(-up[open_], kind="stable")]
                step, at = 32, 0
                while at < len(order) and up[order[at]] >= self.least[i]:
                    now = order[at : at + step]
                    scores = self._dot(self.q[i : i + 1], v[now])[0]
                    keep = scores >= self.least[i]
                    found = self.best[i] + list(zip((-scores[keep]).tolist(), ids[now[keep]].tolist()))
                    found.sort()
                    self.best[i] = found[: self.k]
                    if len(self.best[i]) == self.k:
                        self.least[i] = max(self.least[i], -self.best[i][-1][0])
                    at, step = at + step, step * 2


def query_blocks(rows: pa.Table) -> list[tuple]:
    """Ids, vectors, distances to the pivots, and length, of the queries of each length."""
    blocks = []
    lengths = rows.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(rows) else np.zeros(0, int)
    for dim in np.unique(lengths).tolist():
        own = rows.filter(pa.array(lengths == dim))
        d = own.column("d").combine_chunks()
        width = int(d.value_lengths()[0].as_py())
        v = _matrix(own.column("v").combine_chunks(), dim) if dim else np.zeros((len(own), 0), np.int64)
        blocks.append((own.column("vec_id").to_numpy(), v, _matrix(d, width) if width else np.zeros((len(own), 0)), dim))
    return blocks


def top_k(embeddings: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of each row whose id is divisible by every."""
    vectors = integer_vectors(embeddings)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "v").limit(PIVOT_ROWS).collect()
    pivots = choose_pivots([(r["vec_id"], list(r["v"])) for r in sample])
    table = materialize(pivot_table(vectors, pivots), "pivot-table")
    pivot_ids = np.array([i for i, _ in pivots], np.int64)
    pivot_rows = pivot_matrix(pivots)

    asked = materialize(table.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "d")).alias("x")), "queries")
    passes = max(1, -(-asked.count() // PASS_QUERIES))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for n in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == n).select("vec_id", "x.v", "x.d").toArrow().combine_chunks()
        shared = embeddings.sparkSession.sparkContext.broadcast(query_blocks(rows))

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searches = [(dim, Search(ids, q, d, k, pivot_ids, pivot_rows)) for ids, q, d, dim in shared.value]
            for batch in batches:
                size = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
                for dim, search in searches:
                    own = batch.filter(pa.array(size == dim))
                    if len(own):
                        v = _matrix(own.column("v"), dim) if dim else np.zeros((len(own), 0), np.int64)
                        width = search.d.shape[1]
                        search.take(own.column("vec_id").to_numpy(), v, _matrix(own.column("d"), width) if width else np.zeros((len(own), 0)))
            found = [(int(q), i, -s) for _, search in searches for q, best in zip(search.ids, search.best) for s, i in best]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        part = table.mapInArrow(searched, "query_id long, vec_id long, score long")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        part = materialize(part.select("query_id", "rank", "vec_id", "score"), "best")
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    discard(table, asked)
    return out
