"""Raw deliveries to jobs that have run once each, with replays, bad requests, and stops within and between batches."""

import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import events
from tessera.sources import deliveries as source
from tessera.streaming import deliveries

SECRET = "s3cret"


def drop(folder, name, body, delivery, event="push", secret=SECRET, **headers):
    body = body.encode() if isinstance(body, str) else body
    signature = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    sent = {"X-Hub-Signature-256": signature, "X-GitHub-Event": event, "X-GitHub-Delivery": delivery} | headers
    (folder / f".{name}").write_text(json.dumps({"headers": {k: v for k, v in sent.items() if v is not None}, "body": base64.b64encode(body).decode()}))
    (folder / f".{name}").rename(folder / name)


def push(n):
    return json.dumps({"ref": "refs/heads/main", "after": f"c{n}", "repository": {"clone_url": f"https://h/r{n}"}, "commits": [{"added": ["api.py"]}]})


def test_each_job_runs_once_across_restarts(spark, tmp_path):
    spool, folder, checkpoint, flag = tmp_path / "spool", str(tmp_path / "out"), str(tmp_path / "c"), tmp_path / "fail"
    spool.mkdir()
    source.register(spark)

    def work(jobs):
        if flag.exists():
            raise RuntimeError("the worker stops")
        return jobs.select("job_id", "repository_url", F.lit("done").alias("state"))

    def run():
        stream = spark.readStream.format("deliveries").option("path", str(spool)).load()
        query = deliveries.run_deliveries(stream, folder, checkpoint, SECRET, work)
        query.awaitTermination(120)

    def state():
        rows = spark.read.parquet(f"{folder}/deliveries").collect()
        done = [r["job_id"] for r in deliveries.results(spark, folder, "job_id string, repository_url string, state string").collect()]
        return {r["delivery_file"]: (r["status"], r["answered_by"], r["duplicate"]) for r in rows}, sorted(done), len(rows)

    drop(spool, "0001", push(1), "d1")
    drop(spool, "0002", push(1), "d1")  # a replay within the batch
    drop(spool, "0003", "{}", "p1", event="ping")
    drop(spool, "0004", push(2), "d2")
    run()
    found, done, rows = state()
    assert done == ["d1", "d2"] and rows == 4
    assert found == {"0001": ("queued", "0001", False), "0002": ("queued", "0001", True), "0003": ("acknowledged", "0003", False), "0004": ("queued", "0004", False)}

    drop(spool, "0005", push(1), "d1")  # a replay of an earlier batch
    drop(spool, "0006", push(3), "d3", secret="other")
    drop(spool, "0007", push(4), None)
    drop(spool, "0008", "[1]", "d5")
    (spool / "0009").write_bytes(b"no request")
    drop(spool, "0010", push(6), "d6", event="issues")
    drop(spool, "0011", push(7), "d7")
    flag.touch()
    with pytest.raises(Exception, match="the worker stops"):
        run()
    flag.unlink()
    run()
    run()  # nothing is left
    found, done, rows = state()
    assert done == ["d1", "d2", "d7"] and rows == 11
    assert {k: v for k, v in found.items() if k > "0004"} == {
        "0005": ("queued", "0001", True), "0006": (events.BAD_SIGNATURE, "0006", False), "0007": (events.NO_ID, "0007", False), "0008": (events.BAD_PAYLOAD, "0008", False),
        "0009": (events.BAD_SIGNATURE, "0009", False), "0010": ("ignored", "0010", False), "0011": ("queued", "0011", False),
    }


def test_verdicts(spark):
    body = b'{"a": 1}'
    signed = "sha256=" + hmac.new(SECRET.encode(), body, hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([(1, signed, "d", bytearray(body)), (2, None, "d", bytearray(body)), (3, signed, None, bytearray(body)), (4, signed, "d", None)], "n int, signature string, delivery_id string, body binary")
    found = {r["n"]: r["v"] for r in rows.select("n", events.verdict(rows, SECRET).alias("v")).collect()}
    assert found == {1: events.ACCEPTED, 2: events.BAD_SIGNATURE, 3: events.NO_ID, 4: events.BAD_SIGNATURE}
    assert {r["v"] for r in rows.select(events.verdict(rows, None).alias("v")).collect()} == {events.NO_SECRET}
    long = "k" * 100
    digest = rows.select(events.hmac_sha256(long)("body").alias("d")).first()["d"]
    assert digest == hmac.new(long.encode(), body, hashlib.sha256).hexdigest()


def test_every_row_is_answered_once(spark):
    rows = [("a", 1, 0), ("a", 1, 5), (None, 2, 6), (None, 2, 7), ("b", None, 8), ("b", None, 9), ("c", 3, None), ("c", 3, None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "delivery_id string, event_id long, at int, other string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    found = sorted((str(r["delivery_id"]), str(r["event_id"]), r["duplicate"], r["other"]) for r in events.dedupe_deliveries(frame).collect())
    assert found == sorted([("a", "1", False, "x"), ("a", "1", True, "x"), ("None", "2", False, "x"), ("None", "2", False, "x"), ("b", "None", False, "x"), ("b", "None", True, "x"), ("c", "3", False, "x"), ("c", "3", False, "x")])
