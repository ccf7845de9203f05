"""Trie of conversation prefixes, and what sharing them saves, by the Euler-tour technique.

Tarjan, Vishkin, "An efficient parallel biconnectivity algorithm" (1985). Each node has an arc in which the tour enters it and one in
which it leaves. One scan over parents and their children, in order, links all arcs; the list is ranked (list_ranking); running sums along
the tour at a node's two arcs give what its subtree holds.

Texts never leave their first task: a turn is a 128-bit digest of role and text (two 64-bit hashes), and a prefix the sum, modulo 2^64 twice,
of the hashes of its turns with their depths, so it is a running sum as well. Conversations, parents and nodes of any size lie in several
tasks (scans). Only numbers are shuffled.

Defined results: rows without conv_id belong to no conversation; turns are ordered by turn (null first), of equal turns by digest; a
null role or text is empty; repeated rows are repeated turns; no conversations give no nodes; columns other than conv_id, turn, role
and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.list_ranking import list_rank
from tessera.llm.scans import running
from tessera.llm.shared import discard, materialize

# Conversations that share a head, and the bound of its turns.
FAMILY, HEAD = 100, 6
#: Ids in one piece of a node's list.
PIECE = 1 << 16


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 0), g1, g2 (the digest) and chars (code points of the text) of every turn. discard removes what it reads."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = [F.xxhash64(F.lit(n), role, text).alias(f"g{n}") for n in (1, 2)]
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), *digest, F.length(text).cast("long").alias("chars"))
    placed = running(rows.withColumn("one", F.lit(1).cast("long")), ["conv_id"], [F.col("_turn").asc_nulls_first(), F.col("g1"), F.col("g2")], ["one"], label="turns")
    out = placed.select("conv_id", (F.col("one_sum") - 1).alias("position"), "g1", "g2", "chars")
    out.materialized_at = placed.materialized_at
    return out


def _with_roots(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return rows.unionByName(conversations.select("conv_id", zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), zero.alias("chars")))


def sequences(ordered: DataFrame) -> DataFrame:
    """conv_id, depth, g1, g2 and chars of each conversation's turns, with depth 0 for the empty prefix."""
    rows = ordered.select("conv_id", (F.col("position") + 1).alias("depth"), "g1", "g2", "chars")
    return _with_roots(rows, ordered.where("position = 0").select("conv_id"))


def rebuilt(ordered: DataFrame) -> DataFrame:
    """sequences of conversations whose first turns are those of another one.

    Of conversation c, the first h turns are the first h of conversation c - c mod FAMILY (all of them if it has fewer, none if it does not
    exist) and the others its own after its first h; h is crc32(c in decimal) mod HEAD.
    """
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    family = F.pmod("conv_id", F.lit(FAMILY))
    heads = ordered.where((family == 0) & (F.col("position") < HEAD - 1)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("position", "g1", "g2", "chars"))).alias("head"))
    own = ordered.where("position = 0").select("conv_id", (F.col("conv_id") - family).alias("base"), wanted.alias("h")).join(heads, "base", "left")
    none = F.array().cast(dict(heads.dtypes)["head"])
    own = own.select("conv_id", "h", F.slice(F.coalesce("head", none), F.lit(1), F.col("h").cast("int")).alias("head"))
    taken = own.select("conv_id", F.explode("head").alias("x")).select("conv_id", (F.col("x.position") + 1).alias("depth"), "x.g1", "x.g2", "x.chars")
    missing = own.where("size(head) < h").select("conv_id", (F.col("h") - F.size("head")).alias("missing"))
    left = ordered.where(F.col("position") >= wanted).join(missing, "conv_id", "left")
    left = left.select("conv_id", (F.col("position") + 1 - F.coalesce("missing", F.lit(0))).alias("depth"), "g1", "g2", "chars")
    return _with_roots(taken.unionByName(left), own)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the keys of the prefix that ends here (k1, k2) and of the one before it (p1, p2; of no meaning at depth 0)."""
    terms = rows.withColumns({f"t{n}": F.xxhash64(F.lit(n), "depth", "g1", "g2") for n in (1, 2)})
    summed = running(terms.select("conv_id", "depth", "chars", "t1", "t2"), ["conv_id"], [F.col("depth")], ["t1", "t2"], label="prefixes")

    # Spark's own subtraction would stop at an overflow; these wrap.
    def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(f"t{n}_sum") for n in (1, 2)]
            before = [pa.array(k.to_numpy() - batch.column(f"t{n}").to_numpy()) for n, k in enumerate(keys, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "depth", "chars")), *keys, *before], names=["conv_id", "depth", "chars", "k1", "k2", "p1", "p2"])

    out = summed.mapInArrow(parents, "conv_id long, depth long, chars long, k1 long, k2 long, p1 long, p2 long")
    out.materialized_at = summed.materialized_at
    return out


def _ends_digests(keyed: DataFrame) -> DataFrame:
    """k1, k2 and ends_sha256: the digest of the ascending ids of the conversations that end at a node, joined by commas.

    The list of a node is cut into pieces of up to PIECE ids, wherever they lie; the pieces of a node are hashed one after the other, so no list is ever held.
    """
    ends = keyed.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("x")).select("x.k1", "x.k2", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, len(b), PIECE)):
            k1, k2, ids = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
            starts = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(ids) else np.zeros(0, np.int64)
            texts, to = list(map(str, ids.tolist())), np.r_[starts[1:], len(ids)].tolist()
            joined = [",".join(texts[a:b]) for a, b in zip(starts.tolist(), to)]
            yield pa.RecordBatch.from_arrays([pa.array(k1[starts]), pa.array(k2[starts]), pa.array(ids[starts]), pa.array(joined, pa.string())], names=["k1", "k2", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])

        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if key == (k1, k2):
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256()
                digest.update(ids.encode())
            yield batch_of(done)
        if key is not None:
            yield batch_of([(*key, digest.hexdigest())])

    order = ["k1", "k2", "conv_id"]
    cut = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "k1 long, k2 long, first long, ids string")
    return cut.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def _tour(nodes: DataFrame) -> DataFrame:
    """All arcs: id (a: conv_id of the node, b: twice its depth, one more where it is left), the next arc's, and what the node adds there.

    A parent's record and then those of its children, by descending conv_id, follow each other in one order: the row before a child tells the
    sibling that comes after it, and the running sum of parents' ids its parent.
    """
    grouped = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = grouped.agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    known = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    long = lambda n: F.lit(n).cast("long")
    own = F.struct(F.col("k1").alias("s1"), F.col("k2").alias("s2"), long(0).alias("child"), F.col("conv_id").alias("mother"))
    under = F.struct(F.col("p1").alias("s1"), F.col("p2").alias("s2"), long(1).alias("child"), long(0).alias("mother"))
    records = known.select("*", F.explode(F.when(F.col("depth") > 0, F.array(own, under)).otherwise(F.array(own))).alias("r"))
    records = records.select("r.*", "conv_id", "depth", "k1", "k2", "n_convs", "n_children", "first_child", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    linked = running(records, ["s1", "s2"], [F.col("child"), F.col("conv_id").desc()], ["mother"], ["conv_id", "child"], label="linked")
    enters, step = F.col("child") == 0, F.col("depth") * 2
    last = F.col("child_previous") == 0
    arcs = linked.select(
        F.col("conv_id").alias("a"),
        F.when(enters, step).otherwise(step + 1).alias("b"),
        F.when(enters, F.coalesce("first_child", "conv_id")).when(last, F.col("mother_sum")).otherwise(F.col("conv_id_previous")).alias("next_a"),
        F.when(enters, F.when(F.col("n_children") > 0, step + 2).otherwise(step + 1)).when(last, step - 1).otherwise(step).alias("next_b"),
        F.when(enters, (F.col("n_children") == 0).cast("long")).otherwise(0).alias("leaf"),
        F.when(enters, F.col("saved")).otherwise(0).alias("saved"),
        F.when(~enters, F.col("mother_sum")).alias("parent"),
        *(F.when(enters, F.col(c)).alias(c) for c in ("k1", "k2", "n_convs", "n_children")),
    )
    none = F.lit(None).cast("long")
    root = linked.where(enters & (F.col("depth") == 0))  # one row: the tour ends where it leaves the root
    final = root.select(F.col("conv_id").alias("a"), long(1).alias("b"), none.alias("next_a"), none.alias("next_b"), long(0).alias("leaf"), long(0).alias("saved"), *(none.alias(c) for c in ("parent", "k1", "k2", "n_convs", "n_children")))
    out = arcs.unionByName(final)
    out.materialized_at = linked.materialized_at
    return out


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row for each prefix of rows (as sequences or rebuilt give them): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (code points that need not be stored again, of the whole subtree) and ends_sha256.
    """
    keyed = _keyed(rows)
    nodes = materialize(
        keyed.groupBy("k1", "k2").agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
        ),
        "nodes",
    )
    ends = materialize(_ends_digests(keyed), "ends")
    arcs = _tour(nodes)
    discard(keyed, nodes)
    placed = list_rank(arcs)
    summed = running(placed, [], [F.col("position")], ["leaf", "saved"], label="tour")
    discard(arcs, placed)
    leaves = F.col("b") % 2 == 1
    within = lambda c: F.sum(F.when(leaves, F.col(f"{c}_sum")).otherwise(F.col(c) - F.col(f"{c}_sum")))
    found = summed.groupBy(F.col("a").alias("conv_id"), F.shiftright("b", 1).alias("depth")).agg(
        F.max("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.max("n_children").alias("n_children"), within("leaf").alias("n_leaves"), within("saved").alias("saved_tokens"),
        F.max("k1").alias("k1"), F.max("k2").alias("k2"),
    )
    digests = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return found.join(ends, ["k1", "k2"], "left").drop("k1", "k2").withColumn("ends_sha256", digests)
