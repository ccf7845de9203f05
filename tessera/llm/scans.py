"""Running sums and previous values along an order, without one task for a group or for the table.

Rows are dealt by range of (group, order) and sorted within their partitions, so a large group lies in several. Each task sums its own
rows; then the last row of every partition tells what the next one starts with: a few numbers a partition, added up on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialize


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def running(rows: DataFrame, group: list[str], order: list, sums: list[str], previous: list[str] = (), label: str = "running") -> DataFrame:
    """rows with NAME_sum for each of sums, from the first row of the group to this one, and NAME_previous, the value on the row before (null on a group's first).

    group, sums and previous name long columns without nulls; order: columns, which say the order within a group. Sums wrap at 64 bits. What
    the result reads is a table of its own, which shared.discard(result) removes.
    """
    names = rows.columns
    added = [f"{s}_sum" for s in sums] + [f"{p}_previous" for p in previous]
    inner = [*added, "_part", "_n", "_open"]
    none = F.lit(None).cast("long")
    schema = rows.select("*", *(none.alias(c) for c in inner[:-1]), F.lit(True).alias("_open")).schema
    width = len(sums) + len(previous)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, key, is_open = TaskContext.get().partitionId(), 0, None, True
        total, before = np.zeros(len(sums), np.int64), [0] * len(previous)
        for batch in batches:
            size = len(batch)
            if not size:
                continue
            at = np.arange(size)
            keys = [batch.column(c).to_numpy() for c in group]
            new = np.zeros(size, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            new[0] = n > 0 and any(k[0] != own for k, own in zip(keys, key))
            start = np.maximum.accumulate(np.where(new, at, -1))
            out = []
            for i, name in enumerate(sums):
                sums_here = np.r_[total[i], batch.column(name).to_numpy()].cumsum()
                out.append(sums_here[1:] - np.where(start >= 0, sums_here[np.maximum(start, 0)], 0))
                total[i] = out[-1][-1]
            first = new | (at + n == 0)
            for i, name in enumerate(previous):
                values = batch.column(name).to_numpy()
                out.append(pa.array(np.r_[before[i], values[:-1]], pa.int64(), mask=first))
                before[i] = values[-1]
            opened = (start < 0) & is_open
            is_open, key = bool(opened[-1]), [k[-1] for k in keys]
            columns = [*batch.columns, *(pa.array(x, pa.int64()) for x in out), pa.array(np.full(size, part)), pa.array(at + n), pa.array(opened)]
            n += size
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *inner])

    keyed = [*(F.col(c) for c in group), *order]
    table = materialize(rows.repartitionByRange(*keyed).sortWithinPartitions(*keyed).mapInArrow(scanned, schema), label)
    told = [F.max_by(F.struct(*group, *added[: len(sums)], *(F.col(p).alias(f"_last_{p}") for p in previous), "_open"), "_n").alias("x")]
    carried: dict[int, tuple] = {}
    state = None
    for row in sorted(table.groupBy("_part").agg(*told).collect()):
        carried[row["_part"]] = state
        last = list(row["x"])
        own, found, rest, is_open = last[: len(group)], last[len(group) : len(group) + len(sums)], last[len(group) + len(sums) : -1], last[-1]
        if is_open and state is not None and state[0] == own:
            found = [_wrapped(a + b) for a, b in zip(found, state[1])]
        state = own, found, rest

    def completed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, columns = batch.column("_part").to_numpy(), list(batch.columns[: len(names) + width])
            opened, ns = batch.column("_open").to_numpy(zero_copy_only=False), batch.column("_n").to_numpy()
            for part in np.unique(parts[opened]).tolist():
                if carried[part] is None:
                    continue
                own, found, rest = carried[part]
                here = opened & (parts == part)
                for c, k in zip(group, own):
                    here &= batch.column(c).to_numpy() == k
                if not here.any():
                    continue
                for i, value in enumerate(found):
                    columns[len(names) + i] = pa.array(columns[len(names) + i].to_numpy() + np.where(here, np.int64(value), np.int64(0)))
                for i, value in enumerate(rest, len(names) + len(sums)):
                    first = here & (ns == 0)
                    columns[i] = pa.array([value if f else x for f, x in zip(first, columns[i].to_pylist())], pa.int64()) if first.any() else columns[i]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    result = table.mapInArrow(completed, rows.select("*", *(none.alias(c) for c in added)).schema)
    result.materialized_at = table.materialized_at
    return result
