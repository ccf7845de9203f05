"""Parts of bodies in a table are those of the plain splitter, fit the limit and lose no character."""

import random

from pyspark.sql import functions as F

from tessera.operators import chunking


def body(r):
    lines = []
    for _ in range(r.choice([1, 3, 40, 120])):
        lines.append("".join(r.choice("ab  é😀") for _ in range(r.choice([0, 1, 5, 20, 60, 200]))))
    return r.choice(["\n", "\r\n", "\n\n"]).join(lines)


def test_parts_equal_the_plain_splitter(spark):
    r = random.Random(6)
    rows = [(i, body(r), "h" * r.choice([0, 10, 90, 300])) for i in range(120)] + [(900, None, "h"), (901, "", None), (902, " \n\t ", "h"), (903, "x" * 500, "h")]
    df = spark.createDataFrame(rows, "i int, body string, header string").withColumn("header", F.coalesce("header", F.lit("")))
    for limit in (128, 320):
        found = {x["i"]: x["p"] for x in df.select("i", chunking.body_parts(F.col("body"), F.col("header"), limit).alias("p")).collect()}
        assert found == {i: chunking.parts_of(b, h, limit) for i, b, h in rows}
        for i, text, head in rows:
            budget = max(limit - len(head or "") - chunking.RESERVE, chunking.LEAST_BUDGET)
            assert all(0 < len(p) <= max(budget, limit - len(head or "") - 2) for p in found[i])
            assert set("".join("".join(found[i]).split())) == set("".join((text or "").split()))
