"""Dense vectors of texts from any function, and the shapes of a service's responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: texts that are embedded in one call.
BATCH = 32

#: A provider takes texts and gives one vector for each.
Provider = Callable[[list[str]], list[list[float]]]


def prepared(text: Column, prefix: str = "") -> Column:
    """A text with the task's prefix in front, unless that is blank."""
    return F.concat(F.lit(prefix + "\n\n"), text) if prefix.strip() else text


def embedder(provider: Provider, prefix: str = "", batch: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """A function that adds dense to rows with text. Texts go to the provider in batches, within each task; a null text has no vector.

    A provider that gives another number of vectors than it got texts is an error.
    """

    def embed(rows: DataFrame) -> DataFrame:
        asked = rows.withColumn("_asked", prepared(F.col("text"), prefix))
        place = len(rows.columns)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (b.slice(at, batch) for b in batches for at in range(0, len(b), batch)):
                texts = part.column(place).to_pylist()
                wanted = [t for t in texts if t is not None]
                vectors = provider(wanted) if wanted else []
                if len(vectors) != len(wanted):
                    raise ValueError(f"expected {len(wanted)} embeddings but received {len(vectors)}")
                left = iter(vectors)
                dense = pa.array([None if t is None else [float(x) for x in next(left)] for t in texts], pa.list_(pa.float64()))
                yield part.set_column(place, "dense", dense)

        schema = rows.withColumn("dense", F.lit(None).cast("array<double>")).schema
        return asked.mapInArrow(add, schema)

    return embed


def with_batch(rows: DataFrame, by: str, order: str, size: int = BATCH) -> DataFrame:
    """rows with batch, numbered from 0 within each group: what goes to a provider in one call where order counts."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def response_vectors(response: Column) -> Column:
    """The vectors of a JSON response: of each of its embeddings the values, or those of the embedding within; null if there is no such list."""
    shape = "embeddings array<struct<values:array<double>,embedding:struct<values:array<double>>>>"
    return F.transform(F.from_json(response, shape)["embeddings"], lambda e: F.coalesce(e["values"], e["embedding"]["values"]))


def response_points(response: Column, point: str) -> Column:
    """The points of a JSON search response, listed as result.points or as result; point: the schema of one."""
    nested, flat = F.from_json(response, f"result struct<points:array<{point}>>")["result"]["points"], F.from_json(response, f"result array<{point}>")["result"]
    return F.coalesce(nested, flat)


def configured_size(response: Column) -> Column:
    """The vector size in a JSON description of a collection: of its dense vectors, or of its only ones."""
    at = "$.result.config.params.vectors"
    return F.coalesce(*(F.get_json_object(response, p).try_cast("int") for p in (f"{at}.dense.size", f"{at}.size")))
