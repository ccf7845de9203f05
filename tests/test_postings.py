"""The stored index against scores of all points."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import postings, search


def weighted(spark, n, seed, name, words=80):
    """Vectors with few heavy and many light weights; ties are common."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        idx = sorted(r.sample(range(words), r.randint(0, 12)))
        rows.append((i, (idx, [float(r.choice([1, 1, 1, 1, 2, 3, 20]) if r.random() < 0.3 else 1) for _ in idx])))
    return spark.createDataFrame(rows, f"{name} long, sparse struct<indices:array<int>,values:array<double>>")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    points = weighted(spark, 6000, 1, "id").unionByName(spark.createDataFrame([(None, ([1], [50.0])), (9000, None)], "id long, sparse struct<indices:array<int>,values:array<double>>"))
    postings.write_index(points.repartition(4), folder)
    return folder, points


@pytest.mark.parametrize("n,asked", [(1, 5), (7, 20), (15, 1), (10_000, 3)])
def test_search_equals_all_scores(spark, index, n, asked):
    folder, points = index
    queries = weighted(spark, asked, 100 + n, "query_id").unionByName(spark.createDataFrame([(77, ([], [])), (78, None), (79, ([5000], [1.0]))], "query_id long, sparse struct<indices:array<int>,values:array<double>>"))
    columns = ["query_id", "rank", "id", "score"]
    found = sorted(map(tuple, postings.search_index(spark, queries, folder, n).select(columns).collect()))
    assert found == sorted(map(tuple, search.best_sparse(queries, points, n).select(columns).collect())) and found


def test_few_points_are_scored(spark, index):
    folder, _ = index
    query = spark.createDataFrame([(1, ([3, 40], [1.0, 2.0]))], "query_id long, sparse struct<indices:array<int>,values:array<double>>")
    row = postings.share_read(spark, query, folder, 5).first()
    assert row["points"] == 6000 and row["scored"] < 600 and row["postings"] > 6000


def test_blocks_are_in_order_of_weight(spark, index):
    folder, points = index
    stored = spark.read.parquet(f"{folder}/blocks").orderBy("bucket", "block").collect()
    assert all(len(r["ids"]) <= postings.BLOCK and r["top"] == max(r["vals"]) and r["vals"] == sorted(r["vals"], reverse=True) for r in stored)
    assert all(a["bucket"] != b["bucket"] or min(a["vals"]) >= b["top"] for a, b in zip(stored, stored[1:]))
    known = points.where("id is not null and sparse is not null")
    assert sum(len(r["ids"]) for r in stored) == known.agg(F.sum(F.size("sparse.indices"))).first()[0]
