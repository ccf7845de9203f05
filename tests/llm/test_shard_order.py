"""Sources with a common beginning are different levels of the curve's dimension."""

from tessera.llm import sharding


def test_sources_with_a_common_beginning(spark):
    rows = [(i, "same text", "en", f"https://host{i % 16:02}.example/") for i in range(320)] + [(320, "same text", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = sharding.shard_rows(docs, 4).collect()
    assert len(found) == 321 and sorted(r["rank"] for r in found) == list(range(321))
    levels = {}
    for r in found:
        levels.setdefault(r["h"], set()).add(rows[r["doc_id"]][3])
    assert len(levels) >= 15
