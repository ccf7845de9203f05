"""Events of a job that ends and of one that fails, read by a listener and as a table; observed batches of a stream."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import embedding, pipeline
from tessera.operators.progress import EVENT, JobProgress, StreamProgress

ROWS = [("api/main.py", "import os\n\ndef health():\n    return 1\n"), ("README.md", "# hi"), ("web/a.ts", "export function f() {\n}\n")]


def files(spark):
    return spark.createDataFrame(ROWS, "path string, text string").withColumn("hash", F.sha2("text", 256))


def embed(fail=False):
    def provider(batch):
        if fail:
            raise RuntimeError("the service is away")
        return [[float(len(t)), 1.0] for t in batch]

    return embedding.embedder(provider)


def test_a_finished_job_tells_its_stages(spark, tmp_path):
    heard, folder = [], str(tmp_path / "events")
    progress = JobProgress(spark, "j1", folder, heard.append)
    indexed, _, documents, told = pipeline.run_job(spark, files(spark), "acme/repo", embed(), F.upper, ["readme"], progress=progress)
    stages = [(e["stage"], e["status"], e["progress"], e["rows"]) for e in heard]
    assert stages == [
        ("cloning", "processing", 5, 3), ("metadata", "processing", 20, 1), ("diffing", "processing", 35, 2), ("parsing", "processing", 50, 2),
        ("summarizing", "processing", 90, indexed.points.count()), ("documentation", "processing", 95, 1), ("completed", "completed", 100, None),
    ]
    assert [r["stage"] for r in told.orderBy("seq").collect()] == [s[0] for s in stages] and documents.count() == 1
    stored = spark.read.schema(EVENT).json(folder).orderBy("seq").collect()
    assert [(r["stage"], r["rows"]) for r in stored] == [(s[0], s[3]) for s in stages] and {r["job_id"] for r in stored} == {"j1"}
    assert all(a["ts"] <= b["ts"] for a, b in zip(stored, stored[1:]))


def test_a_failing_job_tells_where(spark, tmp_path):
    folder = str(tmp_path / "events")
    with pytest.raises(Exception, match="away"):
        pipeline.run_job(spark, files(spark), "acme/repo", embed(fail=True), F.upper, ["readme"], progress=JobProgress(spark, "j2", folder))
    stored = spark.read.schema(EVENT).json(folder).orderBy("seq").collect()
    assert [(r["stage"], r["status"]) for r in stored] == [("cloning", "processing"), ("metadata", "processing"), ("diffing", "processing"), ("parsing", "processing"), ("summarizing", "failed")]
    assert stored[-1]["progress"] == 50 and stored[-1]["message"]


def test_batches_of_a_stream_are_told(spark, tmp_path):
    import time

    heard = []
    listener = StreamProgress(heard.append)
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).observe("seen", F.count(F.lit(1)).alias("rows"), F.max("id").alias("most"))
        rows.writeStream.format("noop").queryName("told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
        for _ in range(100):
            if any(e["kind"] == "ended" for e in heard):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    batches = [e for e in heard if e["kind"] == "batch" and e["rows"]]
    assert batches[0]["query"] == "told" and batches[0]["rows"] == 7 and batches[0]["observed"]["seen"] == {"rows": 7, "most": 6}
