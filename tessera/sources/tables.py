"""Reading tables and file collections, and writing state and points."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(rows: DataFrame) -> DataFrame:
    """rows with a broadcast hint if there are at most BROADCAST_ROWS of them, which is counted; else the join shuffles."""
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(rows) if few else rows


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; where that is unset, a local one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/work-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), content and sha256 of every file under root.

    Listing and reading are distributed; a filter or semi-join on path before content is used prunes the rest.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.substring_index(F.col("path"), base, -1), "^/+", "")
    return rows.select(relative.alias("path"), "content", F.sha2("content", 256).alias("sha256"))


def listing(files: DataFrame) -> DataFrame:
    """path and type (directory or file) of all files and of the directories that they are in."""
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    directories = files.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("path")).distinct()
    return directories.withColumn("type", F.lit("directory")).unionByName(files.select("path", F.lit("file").alias("type")))


def decode_text(content):
    """Bytes as UTF-8 with malformed bytes dropped. Replacement characters that the bytes hold stay: they are put aside while malformed bytes become some."""
    mark, replaced = "\ufdd0", "\ufffd"
    aside = F.replace(F.replace(content.cast("string"), F.lit(mark), F.lit(mark + "a")), F.lit(replaced), F.lit(mark + "b"))
    valid = F.replace(F.make_valid_utf8(aside), F.lit(replaced), F.lit(""))
    return F.replace(F.replace(valid, F.lit(mark + "b"), F.lit(replaced)), F.lit(mark + "a"), F.lit(mark))


def read_json_lines(spark: SparkSession, path: str, schema: str, required: str) -> DataFrame:
    """Newline-delimited JSON; lines that do not parse, or lack the required field, are left out."""
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("x"))
    return parsed.select("x.*").where(F.col(required).isNotNull())


def read_sse(lines: DataFrame, schema: str) -> DataFrame:
    """Payloads of the data lines of an event stream; empty ones are left out. lines: value."""
    data = lines.where(F.col("value").startswith("data: ")).select(F.from_json(F.expr("substr(value, 7)"), schema).alias("x"))
    return data.where(F.col("x").isNotNull()).select("x.*")


def valid_json(lines: DataFrame, schema: str, required: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """The rows of lines whose JSON parses and has the required field, with its fields, and the others as they are (dead letters)."""
    parsed = lines.withColumn("_x", F.from_json(column, schema))
    good = F.coalesce(F.col(f"_x.{required}").isNotNull(), F.lit(False))
    return parsed.where(good).select(*lines.columns, "_x.*"), parsed.where(~good).drop("_x")


def load_partition(spark: SparkSession, path: str, schema: str, **keys: str) -> DataFrame:
    """The rows of a table written by write_partitioned that belong to keys; none where the table is missing or one of their files cannot be read, as a part of a state is no state.

    The files' footers are read for that.
    """
    none = spark.createDataFrame([], schema)
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
        return none
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", False).option("ignoreMissingFiles", False).parquet(path)
    for column, value in keys.items():
        rows = rows.where(F.col(column) == value)
    try:
        rows.count()
    except (PySparkException, Py4JJavaError):
        return none
    return rows


def collection_exists(spark: SparkSession, folder: str, collection: str) -> bool:
    """Whether a collection (a folder of points) has been created."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{collection}")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def ensure_collection(spark: SparkSession, folder: str, collection: str, schema: str, vector_size: int, vector: str = "dense") -> DataFrame:
    """The points of a collection, which is created empty if it does not exist. Points with vectors of another size than vector_size are an error."""
    if not collection_exists(spark, folder, collection):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{collection}")
    rows = spark.read.schema(schema).parquet(f"{folder}/{collection}")
    held = rows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    if held and held["n"] != vector_size:
        raise ValueError(f"the collection expects vectors of {held['n']} numbers, not of {vector_size}")
    return rows


def write_partitioned(rows: DataFrame, path: str, *keys: str) -> None:
    """Replace only the partitions that rows bring (state by repository and branch, points by repository)."""
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy(*keys).mode("overwrite").parquet(path)
