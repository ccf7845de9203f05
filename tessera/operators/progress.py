"""Progress of a job as its stages end: how many rows each gave, when, and whether it failed.

A stage ends when its rows are written, which is also what later stages read, so nothing is computed twice. The count is observed by that same write
(DataFrame.observe). Each event is a row of a table that others can read, as a stream too, and goes to a listener at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tessera.operators.events import STAGES
from tessera.sources.tables import work_folder

EVENT = "job_id string, seq int, status string, stage string, progress int, rows long, message string, ts timestamp"
PERCENT = {stage: percent for percent, stage in STAGES}
FAILED, PROCESSING, COMPLETED = "failed", "processing", "completed"


class JobProgress:
    """Events of one job. folder: where they are appended (JSON lines; none if not given); listen: called with each as a dictionary."""

    def __init__(self, spark: SparkSession, job_id: str, folder: str | None = None, listen: Callable[[dict], None] | None = None):
        self.spark, self.job_id, self.folder, self.listen = spark, job_id, folder, listen
        self.work, self.events, self.stage = work_folder(spark), [], "queued"

    def tell(self, status: str, stage: str, rows: int | None = None, message: str | None = None) -> None:
        last = self.events[-1]["progress"] if self.events else 0
        event = {
            "job_id": self.job_id, "seq": len(self.events), "status": status, "stage": stage, "progress": max(last, PERCENT.get(stage, 0)) if status != FAILED else last,
            "rows": rows, "message": message, "ts": datetime.now(timezone.utc).replace(tzinfo=None),
        }
        self.events.append(event)
        if self.folder:
            self.spark.createDataFrame([tuple(event.values())], EVENT).coalesce(1).write.mode("append").json(self.folder)
        if self.listen:
            self.listen(event)

    def step(self, stage: str, rows: DataFrame) -> DataFrame:
        """Write the rows of a stage, tell that it has ended, and continue from what was written."""
        self.stage = stage
        seen, path = Observation(), f"{self.work}/{len(self.events)}-{stage}"
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        self.tell(PROCESSING, stage, seen.get["rows"])
        return self.spark.read.schema(rows.schema).parquet(path)

    @contextmanager
    def running(self) -> Iterator[JobProgress]:
        """Around the stages: an error is told with the stage that it came in, and goes on; otherwise the job is completed."""
        try:
            yield self
        except Exception as error:
            self.tell(FAILED, self.stage, message=str(error).strip().split("\n")[0])
            raise
        self.tell(COMPLETED, COMPLETED)


class StreamProgress(StreamingQueryListener):
    """Tells each batch of the streams of a session: query name, batch, rows in, and what was observed, as one dictionary."""

    def __init__(self, listen: Callable[[dict], None]):
        self.listen = listen

    def onQueryStarted(self, event) -> None:
        self.listen({"query": event.name, "kind": "started"})

    def onQueryProgress(self, event) -> None:
        now = event.progress
        observed = {name: row.asDict() for name, row in now.observedMetrics.items()}
        self.listen({"query": now.name, "kind": "batch", "batch": now.batchId, "rows": now.numInputRows, "observed": observed})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.listen({"query": str(event.id), "kind": "failed" if event.exception else "ended", "message": event.exception})
