"""Incremental index in hash buckets: a batch rewrites the buckets that its changes touch.

Files go to buckets by the hash of their path, and so do their state, points and hashes. A batch writes the touched buckets under a folder of its own number; a manifest
says of each bucket which number holds it. One rename makes the new manifest the current one, so a reader or a restart finds the old version or
the new one, whole. What is written grows with what changed and with the buckets' size, not with the index.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.indexing import diff, index_increment
from tessera.streaming.events import current_version, point_to

#: Buckets of a new index. A hundredth of all files changed touch nearly all of 64 buckets and few of 100,000: choose so many that a bucket is some megabytes.
BUCKETS = 64
PARTS = ("state", "points", "hashes")


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _manifest_path(folder: str, version: str) -> str:
    return f"{folder}/manifests/{version}.json"


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """buckets (how many), batch, and of each part the number that holds each bucket with rows; None before the first batch."""
    version = current_version(spark, folder)
    return json.loads(spark.read.text(_manifest_path(folder, version), wholetext=True).first()[0]) if version else None


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_view(spark: SparkSession, folder: str, part: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """The rows of a part (one of PARTS) as the current manifest has them; only: those of some buckets."""
    found = manifest(spark, folder)
    held = found["parts"][part] if found else {}
    paths = [f"{folder}/{part}/v={number}/bucket={bucket}" for bucket, number in held.items() if only is None or int(bucket) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def apply_snapshot(batch: DataFrame, number: int, folder: str, process: Callable, chunk: Callable, state_schema: str, point_schema: str, buckets: int = BUCKETS) -> list[int]:
    """Make a snapshot (path, hash, content) the current version; the buckets that were rewritten. process, chunk: as operators.indexing.index_increment takes them."""
    spark, known = batch.sparkSession, manifest(batch.sparkSession, folder)
    if known and known["batch"] >= number:
        return []
    buckets = known["buckets"] if known else buckets
    schemas = {"state": state_schema, "points": point_schema, "hashes": "path string, hash string"}
    changes = diff(batch.select("path", "hash"), read_view(spark, folder, "hashes", schemas["hashes"])).where("status <> 'unchanged'")
    touched = sorted(r["b"] for r in changes.select(bucket_of(F.col("path"), buckets).alias("b")).distinct().collect())  # at most so many numbers as there are buckets
    parts = {part: dict(known["parts"][part]) if known else {} for part in PARTS}
    if touched:
        mine = batch.where(bucket_of(F.col("path"), buckets).isin(touched))
        old = {part: read_view(spark, folder, part, schemas[part], touched) for part in PARTS}
        state, points = index_increment(mine, old["hashes"], old["state"], old["points"], process, chunk)
        for part, rows in (("state", state), ("points", points), ("hashes", mine.select("path", "hash"))):
            target = f"{folder}/{part}/v={number}"
            rows.withColumn("bucket", bucket_of(F.col("path"), buckets)).write.partitionBy("bucket").mode("overwrite").parquet(target)
            held = spark.read.schema(f"{schemas[part]}, bucket int").parquet(target).select("bucket").distinct().collect()
            for bucket in touched:
                parts[part].pop(str(bucket), None)
            parts[part].update({str(r["bucket"]): number for r in held})
    version = f"v{number}"
    _write_text(spark, _manifest_path(folder, version), json.dumps({"buckets": buckets, "batch": number, "parts": parts}))
    point_to(spark, folder, version)
    return touched


def maintain_view(snapshots: DataFrame, folder: str, process: Callable, chunk: Callable, state_schema: str, point_schema: str, checkpoint: str, buckets: int = BUCKETS):
    """Start the stream of snapshots, each of which arrives as one batch and replaces the one before; with a column snapshot, the latest in a batch counts."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        if "snapshot" in batch.columns:
            batch = batch.join(F.broadcast(batch.agg(F.max("snapshot").alias("snapshot"))), "snapshot", "left_semi")
        apply_snapshot(batch, number, folder, process, chunk, state_schema, point_schema, buckets)

    return snapshots.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remove_unused(spark: SparkSession, folder: str) -> list[str]:
    """Remove what the current manifest does not name, when no reader of an older one is left; the folders that went."""
    found, gone = manifest(spark, folder), []
    if found is None:
        return gone
    for part in PARTS:
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        used = {(str(number), bucket) for bucket, number in found["parts"][part].items()}
        for version in files.listStatus(root) if files.exists(root) else []:
            number = version.getPath().getName().split("=")[-1]
            for bucket in files.listStatus(version.getPath()):
                name = bucket.getPath().getName()
                if name.startswith("bucket=") and (number, name.split("=")[1]) not in used:
                    files.delete(bucket.getPath(), True)
                    gone.append(f"{part}/v={number}/{name}")
    return gone
