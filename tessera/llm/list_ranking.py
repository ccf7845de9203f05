"""Ranks of the elements of one long linked list.

1. Elements are dealt by range of their ids, and every task joins what follows each other in its own partition to chains. Where ids that
   are near follow each other, as along a conversation, few chains are left.
2. Chains are contracted by random mates: each draws a coin by its id, and one that drew tails goes into the chain before it if that
   drew heads. A round takes out a quarter of them and is one join on keys that occur once a side.
3. At most LAST chains, a row of three numbers each, are ranked on the driver, and the rounds are undone in reverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, keyed_join, materialize

#: Chains that are ranked in one place: some hundred kilobytes.
LAST = 8192

def _chains(a: np.ndarray, b: np.ndarray, next_a: np.ndarray, next_b: np.ndarray, has_next: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the head of each element's chain among these elements is, how far from it the element is, and whether the chain ends there."""
    at = np.arange(len(a))
    links = pd.DataFrame({"a": next_a[has_next], "b": next_b[has_next], "before": at[has_next]})
    found = links.merge(pd.DataFrame({"a": a, "b": b, "at": at}), on=["a", "b"])
    head, ends = at.copy(), np.ones(len(a), bool)
    head[found["at"].to_numpy()], ends[found["before"].to_numpy()] = found["before"].to_numpy(), False
    far = (head != at).astype(np.int64)
    while True:
        further = head[head]
        if (further == head).all():
            return head, far, ends
        far, head = far + far[head], further


def _ranked(chains: list[tuple]) -> list[tuple]:
    """a, b and rank of chains (a, b, next_a, next_b, size), one after the other."""
    own = {chain[:2]: chain for chain in chains}
    followed = {chain[2:4] for chain in chains}
    now, rank, out = next((key for key in own if key not in followed), None), 0, []
    while now in own:
        out.append((*now, rank))
        now, rank = own[now][2:4], rank + own[now][4]
    return out


def _rank_chains(chains: DataFrame, last: int) -> DataFrame:
    """a, b and rank of chains, materialized."""
    spark, now, rounds = chains.sparkSession, materialize(chains, "chains"), []
    while now.count() > last:
        heads = (F.xxhash64("a", "b", F.lit(len(rounds))) & F.lit(1)) == 0
        into = now.where(heads).select(*(F.col(c).alias(f"u_{c}") for c in now.columns))
        tails = now.where(~heads)
        both = materialize(into.join(tails, (F.col("u_next_a") == F.col("a")) & (F.col("u_next_b") == F.col("b")), "full_outer"), "mates")
        discard(now)
        rounds.append(both)
        joined, alone = F.col("u_a").isNotNull() & F.col("a").isNotNull(), F.col("u_a").isNull()

        def pick(c: str, merged, joined=joined, alone=alone):
            return F.when(joined, merged).when(alone, F.col(c)).otherwise(F.col(f"u_{c}")).alias(c)

        now = materialize(
            both.select(
                F.coalesce("u_a", "a").alias("a"), F.coalesce("u_b", "b").alias("b"), pick("next_a", F.col("next_a")), pick("next_b", F.col("next_b")), pick("size", F.col("u_size") + F.col("size"))
            ),
            "chains",
        )
    ranks = materialize(spark.createDataFrame(_ranked([tuple(row) for row in now.collect()]), "a long, b long, rank long"), "ranks")
    discard(now)
    for both in reversed(rounds):
        taken = both.where("u_a is not null and a is not null").select("a", "b", "u_a", "u_b", "u_size")
        own = ranks.select(F.col("a").alias("u_a"), F.col("b").alias("u_b"), "rank")
        last_ranks, ranks = ranks, materialize(ranks.unionByName(taken.join(own, ["u_a", "u_b"]).select("a", "b", (F.col("rank") + F.col("u_size")).alias("rank"))), "ranks")
        discard(last_ranks, both)
    return ranks


def list_rank(links: DataFrame, last: int | None = None) -> DataFrame:
    """links with position, the element's place in the list from 0, instead of its link; materialized.

    links: a and b (together an id that occurs once), next_a and next_b (the id of the next element; null at the end), and others. All
    elements must be one list.
    """
    others = [c for c in links.columns if c not in ("next_a", "next_b")]
    schema = links.select("*", F.lit(0).cast("long").alias("head_a"), F.lit(0).cast("long").alias("head_b"), F.lit(0).cast("long").alias("far"), F.lit(True).alias("ends")).schema

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        own = {c: rows.column(c).fill_null(0).to_numpy() for c in ("a", "b", "next_a", "next_b")}
        head, far, ends = _chains(**own, has_next=rows.column("next_a").is_valid().to_numpy())
        for name, values in (("head_a", own["a"][head]), ("head_b", own["b"][head]), ("far", far), ("ends", ends)):
            rows = rows.append_column(name, pa.array(values))
        yield from rows.to_batches(max_chunksize=1 << 16)

    table = materialize(links.repartitionByRange("a", "b").mapInArrow(contracted, schema), "contracted")
    chains = table.where("ends").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"), "next_a", "next_b", (F.col("far") + 1).alias("size"))
    ranks = _rank_chains(chains, LAST if last is None else last)
    head = F.struct(F.col("head_a").alias("a"), F.col("head_b").alias("b")).alias("head")
    joined = keyed_join(table.select(*others, "far", head), ranks.select(F.struct("a", "b").alias("head"), "rank"), "head", "far")
    out = materialize(joined.select(*others, (F.col("rank") + F.col("far")).alias("position")), "positions")
    discard(table, ranks)
    return out
