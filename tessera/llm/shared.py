"""Table access and intermediate storage shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores in front until none of the columns is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: spark.checkpoint.dir.

    Where that is unset, a new local folder if driver and executors are one process, as in tests; on a cluster, an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of an Arrow batch that a task works on at once.
SLICE_ROWS = 1024


def slices(batches: Iterator, rows: int = SLICE_ROWS) -> Iterator:
    """The batches in pieces, so that Python objects are made of a few rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers SLICE_ROWS rows at a time, so that neither they nor the executor hold more long texts beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", SLICE_ROWS)


def return_memory() -> None:
    """Give what Arrow and the C library hold free back to the system; where the library cannot, it stays."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, a function for mapInArrow, so that its worker holds no free memory between batches and after the task.

    A worker serves the tasks of later stages too, and what it keeps counts beside the executor's heap, which has grown by then.
    """

    @wraps(work)
    def returning(batches: Iterator) -> Iterator:
        for batch in work(batches):
            yield batch
            del batch
            return_memory()
        return_memory()

    return returning


def shrink_heaps(spark: SparkSession) -> None:
    """Have the executors collect their garbage, after which a JVM gives the part of its heap that it no longer needs back to the system.

    One short task for each core that Spark counts; an executor that gets none of them keeps its heap as it is.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


#: Rows up to which a table of a few numbers is broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows. df should be materialized: it is counted."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Parts that the rows of a key are dealt to where a join has to shuffle.
SALTS = 16


def keyed_join(rows: DataFrame, table: DataFrame, key: str, node: str) -> DataFrame:
    """Inner join of rows with a materialized table of one row a key, on key, without one task for a key with many rows.

    A table of at most BROADCAST_ROWS rows is broadcast. A larger one is repeated SALTS times, and the rows of a key are dealt to its copies by node.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key)
    salt = unused("salt", [*rows.columns, *table.columns])
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(node, F.lit(29)), F.lit(SALTS)).cast("int"))
    copies = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [key, salt]).drop(salt)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and continue from the written copy.

    This cuts the lineage at a place that survives the loss of any executor, and makes
    whatever was not deterministic in df (row numbers, task ids) fixed from here on. discard removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.materialized_at = path
    return written


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.materialized_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
