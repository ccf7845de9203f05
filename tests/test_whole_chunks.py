"""chunk_parts chunks every line of every document."""

from tessera.plans.catalogue import QUERIES, file_view


def test_chunk_parts_covers_whole_texts(spark, tmp_path):
    texts = ["\n".join(f"line {i} of {d} {'x' * 40}" for i in range(n)) for d, n in enumerate([300, 301, 302, 1, 2, 3])] + ["", "y" * 9000]
    rows = [(d, t, "en", f"src{d}", len(t)) for d, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    paths = {r["doc_id"]: r["path"] for r in file_view(spark, str(tmp_path)).collect()}
    parts = QUERIES["chunk_parts"](spark, str(tmp_path)).collect()
    for d, text in enumerate(texts):
        own = [r for r in parts if r["path"] == paths[d]]
        for kinds in [("module",)] if d % 3 == 0 else [("class",), ("function",)]:
            lines = {line for r in own if r["chunk_type"] in kinds for line in r["text"].split("\n")}
            if len(text) < 9000 or "\n" in text:
                assert set(text.split("\n")) - {""} <= lines
            else:
                assert sum(line.count("y") for r in own if r["chunk_type"] in kinds for line in r["text"].split("\n") if set(line) == {"y"}) >= 9000
    assert max(r["part_count"] for r in parts) > 5 and {r["chunk_type"] for r in parts} == {"module", "class", "function", "route"}
