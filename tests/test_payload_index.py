"""Clustered points and inverted words: what a filter reads, and what it finds."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import payload_index


def rows_read(frame):
    """Rows that the scans under a plan gave to it: those of the row groups, and pages, that were not passed over."""
    frame.collect()
    plan, total = [frame._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            plan.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("points") / "p")
    n = 40_000
    rows = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 10 == 0, "b/small").otherwise("a/large").alias("repository"),
        # A third of all points is of one file; the other paths are even numbers, so odd ones lie within bounds and are in no group.
        F.when(F.col("id") % 3 == 0, "src/hot.py").otherwise(F.format_string("src/%08d.py", F.col("id") * 2)).alias("file_path"),
        F.lit("py").alias("file_type"), F.lit("Python").alias("language"), F.when(F.col("id") % 2 == 0, "module").otherwise("route_module").alias("module_type"),
        F.sha2(F.col("id").cast("string"), 512).alias("text"),
    )
    payload_index.write_points(rows, folder, group_bytes=256 << 10)
    return folder, n


def test_filters_pass_over_row_groups(spark, clustered):
    folder, n = clustered
    groups = sum(pq.ParquetFile(f).metadata.num_row_groups for f in map(str, __import__("pathlib").Path(folder).rglob("*.parquet")))
    assert groups >= 20
    one = payload_index.read_points(spark, folder, file_path="src/00000002.py")
    assert [r["id"] for r in one.collect()] == [1]
    assert rows_read(payload_index.read_points(spark, folder, file_path="src/00000002.py")) < n / 8
    assert rows_read(payload_index.read_points(spark, folder, repository="b/small")) == n / 10
    some = payload_index.read_points(spark, folder, repository="a/large", module_type="module")
    assert some.count() == rows_read(some.select("id")) or rows_read(some) < 0.75 * n
    assert payload_index.read_points(spark, folder, language="").count() == n
    assert {r["id"] for r in payload_index.points_of_paths(spark, folder, ["src/00000002.py", "src/00000004.py"]).collect()} == {1, 2}


def test_bloom_filters_pass_over_values_within_bounds(spark, clustered, tmp_path):
    """An absent path between present ones: bounds alone keep a group, its Bloom filter does not."""
    folder, _ = clustered
    absent = "src/00020001.py"
    with_filters = rows_read(payload_index.read_points(spark, folder, file_path=absent))
    assert with_filters == 0
    plain = str(tmp_path / "plain")
    spark.read.parquet(folder).sortWithinPartitions("id").write.option("parquet.block.size", 256 << 10).option("parquet.enable.dictionary", False).parquet(plain)
    assert rows_read(spark.read.parquet(plain).where(F.col("file_path") == absent)) > 0


def test_a_large_file_lies_in_several_partitions(spark, clustered):
    folder, n = clustered
    sizes = [r["count"] for r in spark.read.parquet(folder).groupBy(F.input_file_name().alias("f")).count().collect()]
    assert max(sizes) < n / 2 and len(sizes) > 2


def test_replaces_only_the_repositories_that_it_brings(spark, tmp_path):
    folder = str(tmp_path / "p")
    kinds = "id long, repository string, file_path string, file_type string, language string, module_type string, text string"
    payload_index.write_points(spark.createDataFrame([(1, "a", "x", "py", "Python", "module", "t"), (2, "b", "y", None, None, None, None)], kinds), folder)
    payload_index.write_points(spark.createDataFrame([(3, "a", "z", "", "Python", "module", "t")], kinds), folder)
    rows = payload_index.read_points(spark, folder)
    assert sorted(r["id"] for r in rows.collect()) == [2, 3]
    found = {tuple(r) for r in payload_index.keyword_values(rows).collect()}
    assert found == {("file_path", "z", 1), ("file_path", "y", 1), ("language", "Python", 1), ("module_type", "module", 1)}


def test_matching_equals_sets_of_words(spark, tmp_path):
    r = random.Random(4)
    vocabulary = ["the"] * 30 + ["Alpha", "beta", "γάμμα", "x", "a1", "straße", "w" * 64, "w" * 65]
    texts = [" ,".join(r.choices(vocabulary, k=r.randint(0, 9))) for _ in range(200)]
    points = spark.createDataFrame([*enumerate(texts), (500, None), (501, "")], "id long, text string")
    payload_index.write_postings(points, str(tmp_path / "w"))
    asked = ["the", "ALPHA beta", "the γάμμα", "x", "", None, "unknown the", "a1 a1 straße", "w" * 64, "w" * 65 + " the"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    found = {tuple(x) for x in payload_index.matching(queries, spark.read.parquet(str(tmp_path / "w"))).collect()}
    own = lambda t: {w for w in __import__("re").findall(r"[^\W_]+", (t or "").lower()) if 2 <= len(w) <= 64}
    assert found == {(q, i) for q, t in enumerate(asked) if own(t) for i, x in enumerate(texts) if own(t) <= own(x)}
    assert payload_index.matching(queries.where("false"), spark.read.parquet(str(tmp_path / "w"))).count() == 0
