"""Deliveries, job status, sessions and incremental views as streams.

Each has a batch form in tessera.operators; on the same rows both end in the same state. Event times must be TIMESTAMP
(with time zone), as watermarks need it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.events import DELIVERY_TTL, MAX_ATTEMPTS, PING, STATUS_TTL
from tessera.operators.indexing import index_increment


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def headers_lowered(requests: DataFrame) -> DataFrame:
    return requests.withColumn("headers", F.transform_keys("headers", lambda k, _: F.lower(k)))


def first_deliveries(deliveries: DataFrame, ttl: int = DELIVERY_TTL) -> DataFrame:
    """The first delivery of each id within ttl seconds of event time. Pings are not looked up: filter them out before."""
    return deliveries.withWatermark("ts", f"{ttl} seconds").dropDuplicatesWithinWatermark(["delivery_id"])


def answered_deliveries(deliveries: DataFrame, ttl: int = DELIVERY_TTL, lateness: int | None = None) -> DataFrame:
    """Each delivery with the event that answers it, as operators.events.dedupe_deliveries gives it: a replay gets what is stored, a ping overwrites it.

    deliveries: delivery_id string, event_id long, ts timestamp, event string. A record lives for ttl seconds of event time after it was stored, however fast the
    stream is read; it goes when the watermark, lateness seconds (ttl, if not given) behind the newest delivery, has passed that. Rows without a time take no part.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored, since = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        answers = []
        for event_id, ts, event in zip(rows["event_id"], rows["ts"], rows["event"]):
            at = int(pd.Timestamp(ts).timestamp() * 1_000_000)
            if stored is None or event == PING or at - since >= ttl * 1_000_000:
                stored, since = int(event_id), at
            answers.append(stored)
        state.update((stored, since))
        state.setTimeoutTimestamp(max(since // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"delivery_id": key[0], "event_id": rows["event_id"], "answered_by": answers, "duplicate": [a != e for a, e in zip(answers, rows["event_id"])]})

    out = "delivery_id string, event_id long, answered_by long, duplicate boolean"
    timed = deliveries.where("ts is not null").withWatermark("ts", f"{ttl if lateness is None else lateness} seconds")
    return timed.groupBy("delivery_id").applyInPandasWithState(step, out, "stored long, since long", "append", GroupStateTimeout.EventTimeTimeout)


STATUS_SCHEMA = "job_id long, status string, progress double, error string, errors long, updates long"
_STATE = "status string, progress double, error string, errors long, updates long, last_ts long, last_event long"


def _merged(state: tuple, rows: pd.DataFrame, attempts: int) -> tuple:
    """Shallow merge in order of (ts, event_id): fields that an update lacks keep their value, also across states.

    An update that comes in a later batch than one of a later time is counted and changes nothing else.
    """
    status, progress, error, errors, updates, last_ts, last_event = state
    for row in rows.sort_values(["ts", "event_id"]).itertuples():
        updates += 1
        place = (int(pd.Timestamp(row.ts).timestamp() * 1_000_000), int(row.event_id))
        if last_ts is not None and place < (last_ts, last_event):
            continue
        last_ts, last_event = place
        status = row.status
        if pd.notna(row.progress):
            progress = float(row.progress)
        if status == "retrying":
            errors += 1
            error = row.error if pd.notna(row.error) else error
    return ("failed" if status == "retrying" and errors >= attempts else status), progress, error, errors, updates, last_ts, last_event


def job_status(updates: DataFrame, ttl: int = STATUS_TTL, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Latest status of each job (update mode); a job's state goes ttl seconds after its last update.

    updates: job_id long, event_id long, ts timestamp, status, progress double, error string.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found = state.get if state.exists else (None, None, None, 0, 0, None, None)
        merged = _merged(found, pd.concat(list(frames)), attempts)
        state.update(merged)
        state.setTimeoutDuration(ttl * 1000)
        yield pd.DataFrame([(*key, *merged[:5])], columns=["job_id", "status", "progress", "error", "errors", "updates"])

    return updates.groupBy("job_id").applyInPandasWithState(step, STATUS_SCHEMA, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def session_buffers(turns: DataFrame, keep: int = 8, ttl: int = STATUS_TTL) -> DataFrame:
    """The last messages of each session as JSON (update mode). turns: conv_id long, turn long, role, text."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames))
        held += [[int(t), r, x] for t, r, x in zip(rows["turn"], rows["role"], rows["text"].where(rows["text"].notna(), ""))]
        held = sorted(held)[-keep:]
        state.update((json.dumps(held),))
        state.setTimeoutDuration(ttl * 1000)
        yield pd.DataFrame({"conv_id": [key[0]], "messages": [json.dumps(held, ensure_ascii=False)]})

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, messages string", "messages string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts by type in tumbling or sliding windows (an addition to what sessions and states need)."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", lateness).groupBy(window.alias("window"), "event_type").count()


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The version that the pointer names, None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(f"{folder}/current").first()[0]


def point_to(spark: SparkSession, folder: str, version: str) -> None:
    """Let the pointer name a version: a new file takes the old one's place in one step, so a reader finds one or the other."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path, staged = hadoop.Path(f"{folder}/current"), hadoop.Path(f"{folder}/.current-{version}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(staged), files.makeQualified(path), options)


def maintain_index(snapshots: DataFrame, folder: str, process: Callable, chunk: Callable, state_schema: str, point_schema: str, checkpoint: str):
    """Incremental view: each batch holds a snapshot (path, hash, content) that replaces the previous one.

    A snapshot must arrive as one batch: where it has a column snapshot, a batch with several of them is read as its latest alone.
    The merged state and points are written to a folder of their own; then the pointer is replaced in one
    step, so that a reader or a restart sees the old or the new version and never a part. A batch that is done already is not run again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        version = current_version(spark, folder)
        if version is not None and int(version[1:]) >= batch_id:
            return
        if version is None:
            state, points = spark.createDataFrame([], state_schema), spark.createDataFrame([], point_schema)
            previous = spark.createDataFrame([], "path string, hash string")
        else:
            state, points, previous = (spark.read.parquet(f"{folder}/{version}/{name}") for name in ("state", "points", "hashes"))
        if "snapshot" in batch.columns:
            batch = batch.join(F.broadcast(batch.agg(F.max("snapshot").alias("snapshot"))), "snapshot", "left_semi")
        new_state, new_points = index_increment(batch, previous, state, points, process, chunk)
        target = f"{folder}/v{batch_id}"
        new_state.write.mode("overwrite").parquet(f"{target}/state")
        new_points.write.mode("overwrite").parquet(f"{target}/points")
        batch.select("path", "hash").write.mode("overwrite").parquet(f"{target}/hashes")
        point_to(spark, folder, f"v{batch_id}")

    return snapshots.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
