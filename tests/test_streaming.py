import json

from pyspark.sql import functions as F

from tessera.operators import events as batch
from tessera.streaming import events as streams

LOG = [(1, 1, "2024-01-01 00:00:00", "queued", None, None), (1, 2, "2024-01-01 00:00:01", "processing", 0.2, None), (1, 3, "2024-01-01 00:00:02", "retrying", None, "boom"), (1, 4, "2024-01-01 00:00:03", "completed", 1.0, None)]
LOG += [(2, 5 + i, f"2024-01-01 00:01:0{i}", "retrying", None, f"e{i}") for i in range(3)]
SCHEMA = "job_id long, event_id long, ts timestamp, status string, progress double, error string"


def log(spark):
    return spark.createDataFrame(LOG, "job_id long, event_id long, ts string, status string, progress double, error string").withColumn("ts", F.to_timestamp("ts"))


def run(df, name, mode, folder):
    # Processing-time timeouts ask for batches without end, so one batch is run and not all that is available.
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(once=True).start().awaitTermination(120)
    return df.sparkSession.table(name)


def test_job_status_equals_batch(spark, tmp_path):
    log(spark).orderBy("event_id").repartition(3).write.parquet(str(tmp_path / "in"))
    out = run(streams.job_status(streams.read_stream(spark, str(tmp_path / "in"), SCHEMA)), "status_out", "update", tmp_path / "c")
    last = {r["job_id"]: r for r in out.collect()}
    assert (last[1]["status"], last[1]["progress"], last[1]["error"], last[1]["errors"]) == ("completed", 1.0, "boom", 1)
    assert (last[2]["status"], last[2]["error"]) == ("failed", "e2")
    states = {r["job_id"]: r["state"] for r in batch.job_states(log(spark), "job_id").collect()}
    assert states == {k: r["status"] for k, r in last.items()}
    merged = {r["job_id"]: r["error"] for r in batch.latest_status(log(spark), "job_id", ["status", "error"]).collect()}
    assert merged == {1: "boom", 2: "e2"}


def test_deliveries_sessions_and_windows(spark, tmp_path):
    rows = log(spark).select(F.col("job_id").cast("string").alias("delivery_id"), "event_id", "ts", F.col("status").alias("event_type"))
    rows.write.parquet(str(tmp_path / "d"))
    schema = "delivery_id string, event_id long, ts timestamp, event_type string"
    firsts = run(streams.first_deliveries(streams.read_stream(spark, str(tmp_path / "d"), schema)), "first_out", "append", tmp_path / "c1")
    assert firsts.count() == 2
    replays = batch.dedupe_deliveries(rows).where("not duplicate")
    assert replays.count() == 2
    counted = run(streams.windowed_counts(streams.read_stream(spark, str(tmp_path / "d"), schema)), "window_out", "complete", tmp_path / "c2")
    assert counted.agg(F.sum("count")).first()[0] == len(LOG)
    turns = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(12)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "t"))
    held = run(streams.session_buffers(streams.read_stream(spark, str(tmp_path / "t"), "conv_id long, turn long, role string, text string")), "session_out", "update", tmp_path / "c3")
    assert [t for t, _, _ in json.loads(held.first()["messages"])] == list(range(4, 12))


def test_incremental_view_equals_rebuild(spark, tmp_path):
    process = lambda rows: rows.select("path", F.upper("content").alias("symbols"))
    chunk = lambda rows: rows.select("path", F.concat("path", F.lit("#1")).alias("id"))
    folder = str(tmp_path / "view")
    for n, snapshot in enumerate([[("a", "1", "x"), ("b", "1", "y")], [("a", "2", "z"), ("c", "1", "w")]]):
        spark.createDataFrame(snapshot, "path string, hash string, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.read_stream(spark, str(tmp_path / "in"), "path string, hash string, content string", 1)
        streams.maintain_index(stream, folder, process, chunk, "path string, symbols string", "path string, id string", str(tmp_path / "c")).awaitTermination()
    version = spark.read.text(f"{folder}/current").first()[0]
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/{version}/state").select("path", "symbols").collect()} == {("a", "Z"), ("c", "W")}
    assert {r["id"] for r in spark.read.parquet(f"{folder}/{version}/points").collect()} == {"a#1", "c#1"}
