"""Search in blocks against plain scores; embedding, points, collections."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import embedding, points, search
from tessera.sources import tables


def texts(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(["alpha", "beta", "gamma", "delta_1", "x/y.z", "Eps", "1", "ü"]) for _ in range(r.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("block", [1000, 3])
def test_best_sparse_equals_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_QUERIES", block)
    rows = spark.createDataFrame(list(enumerate(texts(60, 1))) + [(99, None), (None, "beta")], "id long, text string")
    asked = spark.createDataFrame(list(enumerate(texts(8, 2))) + [(50, "1 2"), (51, None)], "query_id long, text string")
    entries = search.sparse_entries(rows.where("id is not null"), "id")
    plain = search.best(search.sparse_scores(search.sparse_entries(asked, "query_id"), entries), 5)
    found = search.best_sparse(search.with_sparse(asked), search.with_sparse(rows), 5)
    key = ["query_id", "rank", "id", "score"]
    assert sorted(map(tuple, found.select(key).collect())) == sorted(map(tuple, plain.select(key).collect()))


def test_best_dense_equals_cosines(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(50, 6)).round(3)
    rows = [(i, [float(v) for v in x[i]]) for i in range(50)] + [(60, [0.0] * 6), (61, [1.0, 2.0]), (62, None)]
    vectors = search.with_norm(spark.createDataFrame(rows, "id long, embedding array<double>"), "id")
    asked = vectors.where("id in (3, 4, 60, 61)").withColumnRenamed("id", "query_id")
    found = {}
    for row in search.best_dense(asked, vectors, 4).orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["id"], row["score"]))
    for q in (3, 4):
        cosine = np.round(x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])), 9)
        order = sorted(range(50), key=lambda i: (-cosine[i], i))[:4]
        assert [i for i, _ in found[q]] == order and np.allclose([s for _, s in found[q]], cosine[order])
    assert found[61] == [(61, 1.0)] and 60 not in found


def make_provider():
    def provider(batch):
        assert len(batch) <= 4
        return [[float(len(t)), float(t.count("a")), 1.0] for t in batch]

    return provider


def chunk_rows(spark):
    rows = [("acme/repo", f"src/{n}.py" if n % 2 else f"web/{n}.ts", f"c{n}" if n else "", t, "function", "module", f"s{n}", f"src/{n}:1-2", ["d"], "Python" if n % 2 else "TypeScript") for n, t in enumerate(texts(12, 5))]
    return spark.createDataFrame(rows, "repository string, path string, chunk_id string, text string, chunk_type string, module_type string, symbol string, source_ref string, dependencies array<string>, language string")


def test_points_and_search(spark):
    embed = embedding.embedder(make_provider(), prefix="task: code", batch=4)
    made = points.build_points(chunk_rows(spark), embed).cache()
    assert made.columns == ["id", "dense", "sparse", *points.PAYLOAD] and len(points.PAYLOAD) == 11
    row = made.where("chunk_id = 'c1'").first()
    assert row["dense"][0] == len("task: code\n\n" + row["text"]) and row["file_type"] == "py"
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "99 1")], "query_id long, text string")
    found = search.search_points(asked, made, embed, limit=3, repository="acme/repo", language="Python").collect()
    assert {r["query_id"] for r in found} == {1, 2} and all(r["language"] == "Python" for r in found) and max(r["rank"] for r in found) == 3
    every = search.search_points(asked, made, embed, limit=20).collect()
    assert any(r["chunk_id"] not in {f"c{n}" for n in range(12)} for r in every) and set(search.RESULT) <= set(every[0].asDict())
    summary = points.run_summary("acme/repo", made, 5).first()
    assert (summary["collection_name"], summary["chunk_count"], summary["batch_count"], summary["vector_dimensions"]) == ("repo_chunks_acme_repo", 12, 3, 3)
    assert points.same_size(made).count() == 12
    with pytest.raises(Exception, match="expects vectors of 5"):
        points.same_size(made, 5).select("dense").collect()
    stale = spark.createDataFrame([("src/1.py",)], "path string")
    changed = made.where("chunk_id = 'c2'").withColumn("text", F.lit("new"))
    after = {r["chunk_id"]: r["text"] for r in points.replace_points(made, changed, stale).collect()}
    assert "c1" not in after and after["c2"] == "new" and len(after) == 11


def test_embedding_errors_and_shapes(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "text string")
    assert sorted(r["dense"] is None for r in embedding.embedder(lambda b: [[1.0]] * len(b))(rows).collect()) == [False, False, True]
    with pytest.raises(Exception, match="expected .* embeddings"):
        embedding.embedder(lambda b: [])(rows).collect()
    shapes = spark.createDataFrame([('{"embeddings":[{"values":[1,2]},{"embedding":{"values":[3]}}]}', '{"result":{"points":[{"id":"a"}]}}'), ("no json", '{"result":[{"id":"b"}]}')], "e string, p string")
    found = shapes.select(embedding.response_vectors(F.col("e")).alias("v"), embedding.response_points(F.col("p"), "struct<id:string>").alias("p")).collect()
    assert found[0]["v"] == [[1.0, 2.0], [3.0]] and found[1]["v"] is None and [r["p"][0]["id"] for r in found] == ["a", "b"]
    sizes = spark.createDataFrame([('{"result":{"config":{"params":{"vectors":{"dense":{"size":3}}}}}}',), ('{"result":{"config":{"params":{"vectors":{"size":4}}}}}',), ("[]",)], "r string")
    assert [r["s"] for r in sizes.select(embedding.configured_size(F.col("r")).alias("s")).collect()] == [3, 4, None]


def test_state_files_and_dead_letters(spark, tmp_path):
    where = str(tmp_path / "state")
    schema = "path string, hash string, repository string, branch string"
    assert tables.load_partition(spark, where, schema, repository="a").count() == 0
    tables.write_partitioned(spark.createDataFrame([("x", "1", "a", "main"), ("y", "2", "b", "main")], schema), where, "repository", "branch")
    assert [r["path"] for r in tables.load_partition(spark, where, schema, repository="a", branch="main").collect()] == ["x"]
    (tmp_path / "state" / "repository=a" / "branch=main" / "part-bad.parquet").write_bytes(b"not parquet")
    assert tables.load_partition(spark, where, schema, repository="a").collect() == []  # the other part is not taken for the state
    assert [r["path"] for r in tables.load_partition(spark, where, schema, repository="b").collect()] == ["y"]
    good, bad = tables.valid_json(spark.createDataFrame([(1, '{"a": 1}'), (2, "{bad"), (3, '{"b": 1}'), (4, None)], "n int, value string"), "a int", "a")
    assert [tuple(r) for r in good.collect()] == [(1, '{"a": 1}', 1)] and sorted(r["n"] for r in bad.collect()) == [2, 3, 4]
    found = tables.listing(spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e",)], "path string")).collect()
    assert sorted(map(tuple, found)) == [("a", "directory"), ("a/b", "directory"), ("a/b/c.py", "file"), ("a/d.py", "file"), ("e", "file")]


def test_collections_exist_or_are_created(spark, tmp_path):
    schema = "id string, dense array<double>"
    assert not tables.collection_exists(spark, str(tmp_path), "c_a")
    assert tables.ensure_collection(spark, str(tmp_path), "c_a", schema, 2).count() == 0 and tables.collection_exists(spark, str(tmp_path), "c_a")
    spark.createDataFrame([("x", [1.0, 2.0])], schema).write.mode("append").parquet(str(tmp_path / "c_a"))
    assert tables.ensure_collection(spark, str(tmp_path), "c_a", schema, 2).count() == 1
    with pytest.raises(ValueError, match="expects vectors of 2"):
        tables.ensure_collection(spark, str(tmp_path), "c_a", schema, 3)


def test_replacement_characters_of_a_file_stay(spark):
    raw = {1: "a\ufffdb".encode(), 2: b"a\xffb\xc3", 3: "\ufdd0a\ufdd0b\ufffd".encode() + b"\xe2\x82", 4: b"", 5: None}
    rows = spark.createDataFrame([(n, None if x is None else bytearray(x)) for n, x in raw.items()], "n int, c binary")
    found = {r["n"]: r["t"] for r in rows.select("n", tables.decode_text(F.col("c")).alias("t")).collect()}
    assert found == {n: None if x is None else x.decode("utf-8", "ignore") for n, x in raw.items()}


def test_limits_of_requests(spark):
    asked = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 20), (4, "d", 0), (5, "e", 21), (6, " ", 3), (7, None, 3)], "query_id long, text string, limit int")
    found = {r["query_id"]: (r["limit"], r["error"]) for r in search.search_requests(asked).collect()}
    assert found == {1: (8, None), 2: (1, None), 3: (20, None), 4: (0, "limit"), 5: (21, "limit"), 6: (3, "text"), 7: (3, "text")}
