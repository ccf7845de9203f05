"""Timers, and subscriptions to states, on streams that stop and go on."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import events as batch
from tessera.streaming import events as streams
from tessera.streaming import jobs

KINDS = "job_id long, event_id long, ts string, status string"


def at(seconds):
    return f"2024-01-01 00:{seconds // 60:02d}:{seconds % 60:02d}"


#: Job 1 fails twice and completes, 2 fails for good, 3 recovers before its retry is due, 9 only moves the clock.
LOG = [
    [(1, 1, at(0), "processing"), (2, 2, at(0), "retrying"), (3, 3, at(1), "retrying")],
    [(1, 4, at(10), "retrying"), (3, 5, at(4), "completed"), (9, 6, at(12), "processing")],
    [(9, 7, at(40), "processing"), (1, 8, at(16), "processing"), (1, 9, at(20), "retrying"), (2, 10, at(30), "retrying")],
    [(2, 11, at(50), "retrying"), (1, 12, at(45), "processing"), (1, 13, at(55), "completed")],
    [(9, 14, at(70), "processing")],
    [(9, 15, at(3000), "processing")],
    [(9, 16, at(3001), "processing")],
]


@pytest.fixture
def store(spark):
    """The state store that timers need, for one test."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


def test_retries_are_due_at_the_right_times(spark, tmp_path, store):
    where, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    for rows in LOG:  # a run for each file: the stream stops and goes on from its checkpoint
        spark.createDataFrame(rows, KINDS).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(where)
        found = jobs.job_clock(streams.read_stream(spark, where, "job_id long, event_id long, ts timestamp, status string", 1), ttl=600)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    rows = [(r["job_id"], r["kind"], r["status"], r["attempt"], str(r["ts"])) for r in spark.read.parquet(out).collect()]
    retries = sorted(r for r in rows if r[1] == "retry")
    assert retries == [(1, "retry", "retrying", 2, at(15)), (1, "retry", "retrying", 3, at(30)), (2, "retry", "retrying", 2, at(5)), (2, "retry", "retrying", 3, at(40))]
    last = {job: max((r for r in rows if r[0] == job and r[1] == "status"), key=lambda r: r[4])[2] for job in (1, 2, 3)}
    assert last == {1: "completed", 2: "failed", 3: "completed"}
    assert sorted((r[0], r[4]) for r in rows if r[1] == "expired") == [(1, at(655)), (2, at(650)), (3, at(604)), (9, at(670))]
    log = spark.createDataFrame([row for rows in LOG for row in rows], KINDS).withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["job_id"], r["attempt"], str(r["due_at"])) for r in batch.retries_due(log, "job_id").collect()) == [(r[0], r[3], r[4]) for r in retries]


def test_subscription_loses_nothing(spark, tmp_path):
    where, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    schema = "job_id long, event_id long, ts timestamp, status string, progress double, error string"

    def step(rows):
        made = spark.createDataFrame(rows, "job_id long, event_id long, status string").selectExpr("job_id", "event_id", "timestamp_seconds(event_id) AS ts", "status", "cast(null AS double) AS progress", "cast(null AS string) AS error")
        made.coalesce(1).write.mode("append").parquet(where)
        stream = streams.job_status(streams.read_stream(spark, where, schema, 1))
        stream.writeStream.foreachBatch(lambda rows, n: rows.write.format("noop").mode("overwrite").save()).outputMode("update").option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination(120)

    assert jobs.subscribe(spark, checkpoint) == (None, None)
    step([(1, 1, "queued"), (2, 2, "queued")])
    step([(1, 3, "processing")])
    known, seen = {}, None

    def take():
        nonlocal seen
        rows, seen = jobs.subscribe(spark, checkpoint, seen)
        for r in sorted(rows.collect(), key=lambda r: r["batch"]) if rows is not None else []:
            known[r["key"]["job_id"]] = r["value"]["status"]

    take()
    assert known == {1: "processing", 2: "queued"}
    # The subscriber stops; the stream goes on, and both go on from where they were.
    step([(2, 4, "processing"), (3, 5, "queued")])
    step([(2, 6, "completed")])
    take()
    assert known == {1: "processing", 2: "completed", 3: "queued"}
    assert jobs.subscribe(spark, checkpoint, seen) == (None, seen)
    changes = jobs.state_changes(spark, checkpoint, 2, seen).collect()
    assert sorted((r["key"]["job_id"], r["value"]["status"]) for r in changes if not r["gone"]) == [(2, "completed"), (2, "processing"), (3, "queued")]
