"""From raw deliveries to jobs that have run: verified, told apart, routed, stored and run once each, across restarts.

A batch writes what it takes and what its jobs give to folders of its own number. A batch that is run again, since the stream stopped within it, replaces these
folders with the same rows, and deliveries are looked up in those of earlier batches alone. So each delivery has one row, and each job one result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.events import ACCEPTED, DELIVERY_TTL, PING, dedupe_deliveries, route_events, verdict
from tessera.sources.tables import collection_exists
from tessera.streaming.events import headers_lowered

# Headers of a delivery, lower-cased.
SIGNATURE, EVENT, ID = "x-hub-signature-256", "x-github-event", "x-github-delivery"
#: A stored delivery; status: ignored, queued, acknowledged, or the verdict that rejected it.
DELIVERY = "delivery_file string, delivery_id string, event string, status string, ts timestamp, payload string, answered_by string, duplicate boolean, batch long"


def _stored(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """What batches have written, nothing before the first. A file that cannot be read is an error here: what it holds would run again."""
    return spark.read.schema(schema).parquet(f"{folder}/{name}") if collection_exists(spark, folder, name) else spark.createDataFrame([], schema)


def taken(requests: DataFrame, secret: str | None) -> DataFrame:
    """delivery_file, delivery_id, event, payload, ts and verdict of requests (delivery_file, headers, body, ts)."""
    rows = headers_lowered(requests).select(
        "delivery_file", "ts", F.col("headers")[SIGNATURE].alias("signature"), F.coalesce(F.col("headers")[EVENT], F.lit("")).alias("event"),
        F.coalesce(F.col("headers")[ID], F.lit("")).alias("delivery_id"), "body",
    )
    return rows.select("delivery_file", "delivery_id", "event", F.col("body").cast("string").alias("payload"), "ts", verdict(rows, secret).alias("verdict"))


def process_batch(batch: DataFrame, number: int, folder: str, secret: str | None, work: Callable[[DataFrame], DataFrame], ttl: int = DELIVERY_TTL) -> None:
    """Take one batch of requests: write its deliveries, and what work (from jobs to results with a job_id) makes of the jobs of new ones."""
    spark = batch.sparkSession
    rows = taken(batch, secret)
    known = _stored(spark, folder, "deliveries", DELIVERY).where((F.col("batch") < number) & ~F.col("duplicate") & (F.col("delivery_id") != "") & F.col("status").isin("queued", "ignored", "acknowledged"))
    # Records of earlier batches come first, as deliveries that were answered by themselves; rows of this batch are told from them by their batch.
    stored = known.join(rows.select("delivery_id").distinct(), "delivery_id", "left_semi").select("delivery_file", "delivery_id", "event", "payload", "ts", F.lit(ACCEPTED).alias("verdict"), "batch")
    now = rows.where(F.col("verdict") == ACCEPTED).withColumn("batch", F.lit(number).cast("long"))
    told = dedupe_deliveries(stored.unionByName(now).withColumn("event_id", F.col("delivery_file")), ttl).where(F.col("batch") == number).drop("event_id")
    new = told.where(~F.col("duplicate"))
    jobs = route_events(new.where(F.col("event") != PING))
    queued = jobs.select(F.col("job_id").alias("delivery_id")).distinct().withColumn("_queued", F.lit(True))
    status = F.when(F.col("event") == PING, "acknowledged").when(F.col("_queued"), "queued").otherwise("ignored")
    # A replay has the status of the record that answers it.
    own = new.join(queued, "delivery_id", "left").select(F.col("delivery_file").alias("answered_by"), status.alias("status"))
    answers = own.unionByName(known.join(rows.select("delivery_id"), "delivery_id", "left_semi").select(F.col("delivery_file").alias("answered_by"), "status"))
    accepted = told.join(answers, "answered_by")
    rejected = rows.where(F.col("verdict") != ACCEPTED).withColumns({"status": F.col("verdict"), "answered_by": F.col("delivery_file"), "duplicate": F.lit(False)})
    columns = ["delivery_file", "delivery_id", "event", "status", "ts", "payload", "answered_by", "duplicate"]
    out = accepted.select(columns).unionByName(rejected.select(columns))
    out.write.mode("overwrite").parquet(f"{folder}/deliveries/batch={number}")
    written = spark.read.parquet(f"{folder}/deliveries/batch={number}")
    jobs = route_events(written.where((F.col("status") == "queued") & ~F.col("duplicate")))
    work(jobs).write.mode("overwrite").parquet(f"{folder}/results/batch={number}")


def run_deliveries(requests: DataFrame, folder: str, checkpoint: str, secret: str | None, work: Callable[[DataFrame], DataFrame], ttl: int = DELIVERY_TTL):
    """Start the stream of requests (delivery_file, headers, body) as it is read by sources.deliveries; a delivery's time is that of its batch unless it has a column ts."""

    def step(batch: DataFrame, number: int) -> None:
        timed = batch if "ts" in batch.columns else batch.withColumn("ts", F.current_timestamp())
        if not timed.isEmpty():
            process_batch(timed, number, folder, secret, work, ttl)

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return _stored(spark, folder, "results", schema)
