"""Table functions in SQL give what the operators give."""

from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.operators import chunking, nesting
from tessera.plans.catalogue import whole_files


def test_split_parts_equal_chunks(spark):
    tables.register(spark)
    bodies = chunking.bodies(whole_files(spark, "/root/testdata/sf0.001")).withColumn("header", chunking.header())
    found = spark.sql("SELECT path, chunk_type, symbol, at, p.* FROM {bodies}, LATERAL split_parts(body, header, 1800) p", bodies=bodies)
    chunks = chunking.chunks(whole_files(spark, "/root/testdata/sf0.001"))
    ends = lambda rows, c: sorted((r["path"], r["chunk_type"], r["symbol"] or "", r["part_index"], r["part_count"], r[c]) for r in rows)
    part = chunks.withColumn("part", F.regexp_extract("text", r"(?s)\n\n(.*)$", 1))
    mine, theirs = found.collect(), part.collect()
    assert len(mine) == len(theirs) > 1000
    assert [x[:5] for x in ends(mine, "part")] == [x[:5] for x in ends(theirs, "part")]
    assert all(t.endswith(m) for (*_, m), (*_, t) in zip(ends(mine, "part"), ends(theirs, "text")))


def test_source_tokens_equal_the_token_table(spark):
    tables.register(spark)
    rows = spark.createDataFrame([("a", "x = {'k': (1,\n 2)} # (\n"), ("b", ""), ("c", None)], "path string, text string")
    found = spark.sql("SELECT path, t.* FROM {rows}, LATERAL source_tokens(text, true) t", rows=rows)
    table = nesting.token_table(rows, F.lit(True))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, table.collect())) and found.count() > 10
