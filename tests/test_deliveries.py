"""How long stored deliveries live, in batch and as a stream; progress, order, snapshots and live state of jobs."""

from pyspark.sql import functions as F

from tessera.operators import events
from tessera.streaming import events as streams


def at(days):
    return f"2024-01-{1 + int(days):02d} {int(days % 1 * 24):02d}:00:00"


def deliveries(spark, rows):
    made = spark.createDataFrame([(d, i, at(days), event) for i, (d, days, event) in enumerate(rows)], "delivery_id string, event_id long, ts string, event string")
    return made.withColumn("ts", F.to_timestamp("ts"))


ROWS = [("a", 0, "push"), ("a", 2.5, "push"), ("a", 4.25, "push"), ("b", 0, "push"), ("b", 1, "ping"), ("b", 2.5, "push"), ("b", 3, "push"), ("c", 5, "ping"), ("c", 5.5, "ping"), ("c", 6, "push")]
ANSWERS = {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 8}


def test_a_record_lives_from_when_it_was_stored(spark):
    found = events.dedupe_deliveries(deliveries(spark, ROWS), 2 * 86_400).collect()
    assert {r["event_id"]: r["answered_by"] for r in found} == ANSWERS
    assert all(r["duplicate"] == (r["answered_by"] != r["event_id"]) for r in found)
    assert events.dedupe_deliveries(deliveries(spark, ROWS).limit(0)).count() == 0


def test_replays_in_a_stream_get_what_is_stored(spark, tmp_path):
    rows = deliveries(spark, ROWS)
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.answered_deliveries(streams.read_stream(spark, str(tmp_path / "in"), "delivery_id string, event_id long, ts timestamp, event string"), 2 * 86_400)
    stream.writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination(120)
    assert {r["event_id"]: r["answered_by"] for r in spark.table("answers").collect()} == ANSWERS


def test_records_live_by_event_time_across_batches(spark, tmp_path):
    rows = [("a", 0, "push"), ("b", 1, "push"), ("a", 1.5, "push"), ("b", 9, "push"), ("a", 9.5, "push"), ("b", 9.75, "push")]
    answers = {}
    for n, row in enumerate(rows):
        made = spark.createDataFrame([(row[0], n, at(row[1]), row[2])], "delivery_id string, event_id long, ts string, event string").withColumn("ts", F.to_timestamp("ts"))
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.answered_deliveries(streams.read_stream(spark, str(tmp_path / "in"), "delivery_id string, event_id long, ts timestamp, event string", 1), 2 * 86_400, lateness=60)
        seen = []
        query = stream.writeStream.foreachBatch(lambda df, _, seen=seen: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination(120)
        answers |= {r["event_id"]: r["answered_by"] for r in seen}
    assert answers == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 3}


def test_late_updates_change_nothing(spark, tmp_path):
    schema = "job_id long, event_id long, ts timestamp, status string, progress double, error string"
    for n, (event, hour, status) in enumerate([(2, 2, "processing"), (1, 1, "queued"), (3, 3, "completed")]):
        row = spark.createDataFrame([(7, event, f"2024-01-01 0{hour}:00:00", status, None, None)], "job_id long, event_id long, ts string, status string, progress double, error string")
        row.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = []
        query = streams.job_status(streams.read_stream(spark, str(tmp_path / "in"), schema, 1)).writeStream.foreachBatch(lambda df, _, seen=seen: seen.extend(df.collect()))
        query.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination(120)
        last = seen[-1]
        assert (last["status"], last["updates"]) == (("processing", 1), ("processing", 2), ("completed", 3))[n]


def test_progress_order_snapshot_and_live_state(spark):
    jobs = spark.createDataFrame([(1, ["api"], "queued"), (2, [], "queued")], "job_id long, doc_types array<string>, status string")
    steps = events.progress_events(jobs).orderBy("job_id", "progress").collect()
    assert [r["progress"] for r in steps if r["job_id"] == 1] == [5, 20, 35, 50, 90, 95, 100] and len(steps) == 13
    log = spark.createDataFrame([(1, 1, 1, "a", 1), (1, 3, 3, "c", 2), (1, 2, 2, "b", 3), (2, 1, 4, "x", 4)], "job_id long, ts long, event_id long, status string, arrived long")
    assert sorted(r["event_id"] for r in events.in_order(log, "job_id").collect()) == [1, 3, 4]
    state = log.where("event_id in (1)").select("job_id", "ts", "event_id", "status")
    seen = [(r["job_id"], r["seq"], r["event_id"]) for r in events.snapshot_and_changes(state, log, "job_id").orderBy("job_id", "seq").collect()]
    assert seen == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 1, 4)]
    assert sorted((r["job_id"], r["status"]) for r in events.with_live_state(jobs.select("job_id", "status"), state).collect()) == [(1, "a"), (2, "queued")]
    up = spark.createDataFrame([(True,), (None,)], "up boolean")
    assert events.all_up(up.where("up"), up.where("up")).first()["ok"] and not events.all_up(up.limit(0)).first()["ok"]
