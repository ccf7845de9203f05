"""Sharding along a Hilbert curve, with DataFrame operations only.

Language, source and size are quantised into 16 levels each, at cut points that come from the data.
Rows are ordered by the curve index of their cell, then by the text's checksum and doc_id, and the order is
cut into runs of equal length. Neighbours on the curve agree in most dimensions, so each shard
covers few languages, sources and sizes, and a reader can leave out the other files.

Defined results: a null text counts no bytes and has the checksum of the empty text; a null
language or source is the empty string; every row, repeated ones included, gets one slot; shards
differ by one row at most, so with fewer rows than shards some shards stay empty; rows that are equal in all of these are cut
anywhere; texts count whole, however long; other columns are not read (write_shards keeps them); an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import keyed_join, materialize

BITS = 4
DIMENSIONS = ("lang_key", "source_key", "size")


def with_order_key(rows: DataFrame, column: str, key: str) -> DataFrame:
    """rows with key, a number that keeps the order of the whole strings in column, instead of column."""
    values = rows.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    values = materialize(values.withColumn(key, F.monotonically_increasing_id()), "order-keys")
    return keyed_join(rows, values, column, "text_crc32").drop(column)


def cut_points(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> dict[str, list[int]]:
    """2^bits - 1 approximate quantiles for each dimension; this small row is all that the driver gets."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = rows.agg(*(F.percentile_approx(c, shares, 10000).alias(c) for c in dimensions)).first()
    return {c: sorted(row[c] or []) for c in dimensions}


def hilbert_cells(spark, dimensions: int, bits: int) -> DataFrame:
    """Curve index h of every cell; cell holds the coordinates, first dimension highest.

    Skilling, "Programming the Hilbert curve" (2004). 2^(dimensions * bits) rows, whatever the data's size.
    """
    mask = (1 << bits) - 1
    cells = spark.range(1 << (dimensions * bits)).withColumnRenamed("id", "cell")
    x = [f"x{i}" for i in range(dimensions)]
    cells = cells.withColumns({c: F.shiftright("cell", bits * (dimensions - 1 - i)).bitwiseAND(F.lit(mask)) for i, c in enumerate(x)})
    for level in range(bits - 1, 0, -1):
        q, p = F.lit(1 << level), F.lit((1 << level) - 1)
        for c in x:
            is_set = F.col(c).bitwiseAND(q) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(c)).bitwiseAND(p)
            new = {x[0]: F.when(is_set, F.col(x[0]).bitwiseXOR(p)).otherwise(F.col(x[0]).bitwiseXOR(swap))}
            if c != x[0]:
                new[c] = F.when(is_set, F.col(c)).otherwise(F.col(c).bitwiseXOR(swap))
            cells = cells.withColumns(new)
    for before, c in zip(x, x[1:]):
        cells = cells.withColumn(c, F.col(c).bitwiseXOR(F.col(before)))
    flips = [F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << b)) != 0, (1 << b) - 1).otherwise(0) for b in range(1, bits)]
    cells = cells.withColumn("flip", reduce(lambda a, b: a.bitwiseXOR(b), flips, F.lit(0)))
    cells = cells.withColumns({c: F.col(c).bitwiseXOR(F.col("flip")) for c in x})
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in x:
            index = index * 2 + F.shiftright(c, b).bitwiseAND(F.lit(1))
    return cells.select("cell", index.alias("h"))


def shard_rows(documents: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, curve index h, rank, shard and slot of every document."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
    )
    rows = materialize(rows, "shard-rows")
    rows = with_order_key(with_order_key(rows, "lang", "lang_key"), "source", "source_key")
    cuts = cut_points(rows)
    cell = F.lit(0).cast("long")
    for c in DIMENSIONS:
        level = reduce(lambda a, b: a + b, [(F.col(c) > cut).cast("int") for cut in cuts[c]], F.lit(0))
        cell = cell * (1 << BITS) + level
    curve = F.broadcast(hilbert_cells(spark, len(DIMENSIONS), BITS))
    placed = rows.withColumn("cell", cell).join(curve, "cell").select("doc_id", "size", "text_crc32", "h")

    # doc_id is in the range key, so that equal cells and equal texts can be cut anywhere.
    ordered = placed.repartitionByRange("h", "text_crc32", "doc_id").sortWithinPartitions("h", "text_crc32", "doc_id")
    numbered = ordered.withColumn("at", F.monotonically_increasing_id())
    numbered = materialize(numbered, "shard-order").withColumn("run", F.shiftright("at", 33))

    # One row for each partition of the order: prefix sums over these are small.
    runs = numbered.groupBy("run").agg(F.count("*").alias("n"))
    runs = runs.select(
        "run",
        (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = numbered.join(F.broadcast(runs), "run").withColumn("rank", rank)
    ranked = ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div total as int)"))
    return ranked.withColumn("slot", F.expr(f"rank - (shard * total + {shards - 1}) div {shards}")).select(
        "doc_id", "size", "text_crc32", "h", "rank", "shard", "slot"
    )


def write_shards(documents: DataFrame, path: str, shards: int = 24) -> None:
    """Write documents to path/shard=N, each shard sorted along the curve."""
    placed = shard_rows(documents, shards).select("doc_id", "text_crc32", "shard", "slot").dropDuplicates(["doc_id", "text_crc32"])
    keyed = documents.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    on = keyed["doc_id"].eqNullSafe(placed["doc_id"]) & (keyed["text_crc32"] == placed["text_crc32"])
    joined = keyed.join(placed, on).select(*(keyed[c] for c in documents.columns), placed["shard"], placed["slot"])
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
