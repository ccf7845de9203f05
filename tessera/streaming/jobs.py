"""Jobs on an event-time clock: retries that are scheduled, states that end, and subscriptions to states.

A job's updates are merged in order of (ts, event_id), as operators.events does it for a table. An error schedules the next attempt
base * 2^(errors - 1) milliseconds after it, unless another update of the job comes before that or no attempt is left. Timers fire as the watermark passes
them, so a replay of the same updates schedules the same retries, and so does operators.events.retries_due on the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.events import BACKOFF_MS, MAX_ATTEMPTS, STATUS_TTL

#: Timers and value states need this state store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: kind: status (an update was merged), retry (an attempt is due, at ts) or expired (the job was not heard of for its lifetime; its state is gone).
CLOCK = "job_id long, kind string, status string, attempt int, ts timestamp"
_JOB = "status string, errors int, last_ts long, last_event long, due long, ends long"


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


class JobClock(StatefulProcessor):
    """State of one job: the merged status and errors, the place of the last update, when a retry is due (0: none is) and when the state ends."""

    def __init__(self, attempts: int, base: int, ttl: int):
        self.attempts, self.base, self.ttl = attempts, base, ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", _JOB)

    def _rows(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(*key, kind, status, attempt, pd.Timestamp(at, unit="ms")) for kind, status, attempt, at in rows], columns=["job_id", "kind", "status", "attempt", "ts"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, errors, last_ts, last_event, due, ends = self.job.get() if self.job.exists() else ("", 0, -1, -1, 0, 0)
        timers = {t for t in (due, ends) if t}
        out: list[tuple] = []
        for row in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            at, event = _ms(row.ts), int(row.event_id)
            if (at, event) < (last_ts, last_event):
                continue
            if due and at >= due:  # the retry was due before this update, whatever batch brought it
                out.append(("retry", "retrying", errors + 1, due))
            if ends and at >= ends:  # so was its end: a new state begins
                out.append(("expired", status, errors, ends))
                errors = 0
            due, status, last_ts, last_event = 0, row.status, at, event
            if status == "retrying":
                errors += 1
                if errors >= self.attempts:
                    status = "failed"
                else:
                    due = at + self.base * 2 ** (errors - 1)
            out.append(("status", status, errors, at))
            ends = at + self.ttl
        for timer in timers - {due, ends}:
            self.handle.deleteTimer(timer)
        for timer in {t for t in (due, ends) if t} - timers:
            self.handle.registerTimer(timer)
        self.job.update((status, errors, last_ts, last_event, due, ends))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if not self.job.exists():
            return
        status, errors, last_ts, last_event, due, ends = self.job.get()
        out = []
        if due == fired:
            out.append(("retry", status, errors + 1, due))
            self.job.update((status, errors, last_ts, last_event, 0, ends))
        if ends == fired:
            out.append(("expired", status, errors, ends))
            self.job.clear()
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def job_clock(updates: DataFrame, attempts: int = MAX_ATTEMPTS, base: int = BACKOFF_MS, ttl: int = STATUS_TTL, lateness: str = "0 seconds") -> DataFrame:
    """CLOCK rows of the stream of updates (job_id long, event_id long, ts timestamp, status string), in append mode. Sets the session's state store."""
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = updates.select("job_id", "event_id", "ts", "status").where("job_id is not null and ts is not null").withWatermark("ts", lateness)
    return rows.groupBy("job_id").transformWithStateInPandas(JobClock(attempts, base, ttl), CLOCK, "append", "EventTime")


def state_snapshot(spark: SparkSession, checkpoint: str, batch: int) -> DataFrame:
    """key and value of every state of streaming.events.job_status after a batch of the stream with that checkpoint."""
    return spark.read.format("statestore").option("batchId", batch).load(checkpoint).select("key", F.col("value.groupState").alias("value"))


def state_changes(spark: SparkSession, checkpoint: str, first: int, last: int) -> DataFrame:
    """batch, gone (whether the state was removed), key and value of each change of those states in the batches from first to last."""
    feed = spark.read.format("statestore").option("readChangeFeed", True).option("changeStartBatchId", first).option("changeEndBatchId", last).load(checkpoint)
    return feed.select(F.col("batch_id").alias("batch"), (F.col("change_type") == "delete").alias("gone"), "key", F.col("value.groupState").alias("value"))


def last_batch(spark: SparkSession, checkpoint: str) -> int | None:
    """The last batch that the stream with that checkpoint has committed, None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return max((int(n) for n in names if n.isdigit()), default=None)


def subscribe(spark: SparkSession, checkpoint: str, seen: int | None = None) -> tuple[DataFrame | None, int | None]:
    """What a subscriber to the states of a stream gets now, and what to pass as seen the next time.

    The first time, the snapshot of the last batch (batch, gone false); then the changes of all batches after those seen. The stream goes on meanwhile: a batch belongs to
    what it committed, so nothing is lost or told twice between the two, or across restarts of stream and subscriber, as long as the state's versions are kept.
    """
    now = last_batch(spark, checkpoint)
    if now is None or now == seen:
        return None, seen
    if seen is None:
        rows = state_snapshot(spark, checkpoint, now).select(F.lit(now).cast("long").alias("batch"), F.lit(False).alias("gone"), "key", "value")
        return rows, now
    return state_changes(spark, checkpoint, seen + 1, now), now
