"""Indexes on the payload of points: a clustered table with Bloom filters for keywords, and an inverted table for words of texts.

Keywords need no structure of their own in Parquet: rows sorted by what is filtered most give every row group narrow bounds, and Bloom
filters let a reader pass over groups whose bounds hold a value that they lack. A filter on such a column is pushed to the scan.

The inverted table has a row for each word of a point, sorted by word and point, so that the postings of a word lie together in few row
groups. Words that most points have are spread over as many files as they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import broadcast_if_small

# Keyword columns, and the least and greatest length of an indexed word.
KEYWORDS = ("file_path", "file_type", "language", "module_type")
LEAST_WORD, MOST_WORD = 2, 64
#: The order of the clustered table within a repository; id parts a file with very many points.
CLUSTERED = ("module_type", "file_path", "id")
#: Bytes of a row group, and different values of a column that its Bloom filter is made for.
GROUP_BYTES, BLOOM_VALUES = 32 << 20, 100_000


def words(text: Column) -> Column:
    """The different indexed words of a text: runs of letters and digits, lowered; null for a null text."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: F.length(w).between(LEAST_WORD, MOST_WORD)))


def _writer(rows: DataFrame, bloom: tuple[str, ...], group_bytes: int):
    writer = rows.write.option("parquet.block.size", group_bytes).option("parquet.page.size", max(1 << 10, min(1 << 20, group_bytes // 8)))
    # A chunk that is wholly in a dictionary has that for a filter; the others get a Bloom filter.
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True).option(f"parquet.bloom.filter.expected.ndv#{column}", BLOOM_VALUES)
    return writer


def write_points(points: DataFrame, path: str, group_bytes: int = GROUP_BYTES) -> None:
    """Write points (id, repository, the KEYWORDS and more) by repository, clustered; the repositories that they bring are replaced."""
    order = ("repository", *CLUSTERED)
    rows = points.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = _writer(rows, (*KEYWORDS, "id"), group_bytes)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("repository").mode("overwrite").parquet(path)


def read_points(spark: SparkSession, path: str, **equal: str | None) -> DataFrame:
    """Points of a clustered table; an empty or absent value means no filter. The filters reach the scan: repository prunes folders, the others row groups."""
    rows = spark.read.parquet(path)
    for column, value in equal.items():
        if value:
            rows = rows.where(F.col(column) == value)
    return rows


def points_of_paths(spark: SparkSession, path: str, paths: list[str]) -> DataFrame:
    """Points of some files, such as the stale ones of a small change: the list is pushed to the scan."""
    return spark.read.parquet(path).where(F.col("file_path").isin(*paths))


def text_postings(points: DataFrame) -> DataFrame:
    """word and id of each different word of the texts of points (id, text)."""
    return points.select(F.explode(words(F.col("text"))).alias("word"), "id")


def write_postings(points: DataFrame, path: str, group_bytes: int = GROUP_BYTES) -> None:
    rows = text_postings(points)
    _writer(rows.repartitionByRange("word", "id").sortWithinPartitions("word", "id"), ("word",), group_bytes).mode("overwrite").parquet(path)


def keyword_values(points: DataFrame) -> DataFrame:
    """field, value and points: how many points have each value of each keyword; null and empty values are not indexed."""
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("value")) for k in KEYWORDS))
    rows = points.select(F.explode(pairs).alias("x")).select("x.*").where("value <> ''")
    return rows.groupBy("field", "value").agg(F.count("*").alias("points"))


def matching(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id and id of the points that have all words of a query (query_id, text); a query without words matches nothing.

    The rarest word of each query gives its candidates. The other words are looked up for those alone, so the postings of common words are
    read where the table has them but not shuffled, as long as the candidates are few enough to be broadcast (which is counted).
    """
    asked = queries.where("query_id is not null").select("query_id", F.explode(words(F.col("text"))).alias("word")).distinct()
    # Of a word that no point has, the count is 0: then it is the rarest, and nothing matches.
    known = broadcast_if_small(asked.select("word").distinct())
    counts = postings.join(known, "word", "left_semi").groupBy("word").agg(F.count("*").alias("points"))
    ranked = asked.join(counts, "word", "left").withColumn("points", F.coalesce("points", F.lit(0)))
    rarest = ranked.groupBy("query_id").agg(F.min(F.struct("points", "word")).alias("r"), F.count("*").alias("wanted"))
    first = rarest.select("query_id", F.col("r.word").alias("word"), "wanted")
    candidates = postings.join(broadcast_if_small(first), "word").select("query_id", "id", "wanted")
    others = asked.join(first, ["query_id", "word"], "left_anti")
    found = postings.join(broadcast_if_small(others), "word").join(broadcast_if_small(candidates), ["query_id", "id"], "left_semi")
    counted = found.select("query_id", "id", F.lit(1).alias("one")).unionByName(candidates.select("query_id", "id", F.lit(1).alias("one")))
    wanted = first.select("query_id", "wanted")
    return counted.groupBy("query_id", "id").agg(F.count("*").alias("n")).join(wanted, "query_id").where("n = wanted").select("query_id", "id")
