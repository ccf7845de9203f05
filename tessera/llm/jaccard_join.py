"""Exact n-gram Jaccard join of documents, and the components of its links.

Jaccard distance is a metric on the shingle sets, but sets without a common shingle are all at distance 1, so
a few documents as pivots would leave nearly all others in one region. Regions are therefore made in two steps.

1. Single shingles are the first pivots. A set x is at distance 1 - 1/|x| from each of its own
   shingles and at 1 from any other, so all of its own are nearest, and a global order breaks the tie:
   shingles that a sample shows to be frequent come last, others go by fingerprint. The window that
   the threshold demands then replicates x to its first |x| - ceil(0.75 |x|) + 1 shingles, its head: two sets
   within distance 0.25 meet in at least one region. The sample only moves work; any order gives the same links.
2. In each region the least node is a document pivot, and in regions of many members a fixed number of drawn ones
   are. A pivot's ball (0.25) is linked to it, so pairs within the ball need no comparison, and members whose
   distances to a pivot differ by more than 0.25 cannot link. What is left, members of different
   components, is compared pair by pair in small regions and in blocks of bounded size in larger ones. The largest
   recurse first: several pivots, Voronoi regions with boundary members replicated up to nearest + 2 * 0.25, as
   long as that saves work.

A pair is compared in three steps: sizes; heads, which hold all shingles up to a known place in the
order and so bound the intersection from above; whole sets, fetched for the few nodes that come so far.

Equal sets are one node before their heads are replicated, so copies cost one row each. Joins on a region deal its members
to several tasks, unless its row is broadcast. Fingerprints have 64 bits.

Defined results: words are runs of bytes other than space and 0x09-0x0D with A-Z lower-cased; a
null text, or one without words, has n_shingles 0 and its own doc_id as component; repeated rows are copies of one
another; a null doc_id counts as the largest; no rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.llm.components import components
from tessera.llm.shared import bounded_broadcast, discard, keyed_join, lean, materialize, slices, unused
from tessera.llm.shingles import batch_sets, mix

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
REACH = 1 - PERCENT / 100
#: Documents sampled for the order of shingles (this share, or so many if that is more), and shingles put last
#: at most, which is what is broadcast: a matter of speed only.
ORDER_SHARE, ORDER_DOCUMENTS, ORDER_SHINGLES, ORDER_LEAST = 1 / 8, 4000, 1 << 21, 3
#: Up to so many members, a region's open pairs are joined; beyond, they are compared in blocks; and over LARGE, after a recursion.
SMALL, LARGE = 32, 2048
PIVOTS, DEPTH, BLOCK, MOST_TASKS = 8, 3, 512, 10_000
#: Pivots of a region of more than SMALL members.
MANY_PIVOTS = 16
SLACK = 1e-9


def node_of(own: np.ndarray) -> int:
    """The name of a set: a 64-bit sum over its fingerprints."""
    return int(mix(np.array([np.sum(mix(own ^ np.uint64(0x5851F42D4C957F2D)))], dtype=np.uint64)).view(np.int64)[0])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def frequent_shingles(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found several times in the sample, sorted, and the place of each when ordered by frequency."""
    share = min(1.0, max(ORDER_SHARE, ORDER_DOCUMENTS / max(1, documents.count())))
    sample = _texts(documents).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    @lean
    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(batch_sets(batch.column("text")))
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["s"])

    counts = sample.mapInArrow(flat, "s long").groupBy("s").count().where(F.col("count") >= ORDER_LEAST)
    top = counts.orderBy(F.desc("count"), "s").limit(ORDER_SHINGLES).toArrow()
    places = np.argsort(np.argsort(top.column("count").to_numpy(), kind="stable"), kind="stable").astype(np.uint64)
    shingles = top.column("s").to_numpy().astype(np.int64).view(np.uint64)
    by_value = np.argsort(shingles)
    return shingles[by_value], places[by_value]


def signatures(documents: DataFrame, last: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n (set size), node (name of the set, null if empty) and head, the regions that the document goes to.

    A head's numbers are places in the order: fingerprints of 63 bits, then, with the top bit set, frequent shingles.
    """
    order = documents.sparkSession.sparkContext.broadcast(last)

    @lean
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, places = order.value
        maybe = np.zeros(1 << 22, dtype=bool)
        maybe[late & np.uint64((1 << 22) - 1)] = True
        for batch in slices(batches):
            sizes, nodes, heads = [], [], []
            for own in batch_sets(batch.column("text")):
                n = len(own)
                sizes.append(n)
                nodes.append(node_of(own) if n else None)
                to = n - -(-PERCENT * n // 100) + 1 if n else 0
                hit = maybe[own & np.uint64((1 << 22) - 1)]
                ranks = own >> np.uint64(1)
                if len(late) and hit.any():
                    at = np.flatnonzero(hit)
                    found = np.minimum(np.searchsorted(late, own[at]), len(late) - 1)
                    real = late[found] == own[at]
                    ranks = np.concatenate([np.delete(ranks, at[real]), np.sort(places[found[real]]) | np.uint64(1 << 63)])
                heads.append(ranks[:to].view(np.int64))
            ends = np.cumsum([0, *map(len, heads)], dtype=np.int32)
            flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "node", "head"])

    kind = dict(documents.dtypes)["doc_id"]
    return _texts(documents).mapInArrow(signed, f"doc_id {kind}, n long, node long, head array<long>")


def nodes_of(signed: DataFrame) -> DataFrame:
    """node, n and head of every set, exactly once: of equal sets, a row of smallest doc_id (a null one last)."""
    rows = signed.where("n > 0")
    ids = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"))
    copies = rows.groupBy("node").agg(F.min(ids).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("node", "first")
    copies = materialize(copies, "copies")
    if copies.count() > shared.BROADCAST_ROWS:
        return rows.groupBy("node").agg(F.min_by(F.struct("n", "head"), ids).alias("x")).select("node", "x.n", "x.head")
    marked = rows.join(F.broadcast(copies), "node", "left")
    alone = marked.where(F.col("first").isNull()).select("node", "n", "head")
    # An id that is given twice leaves two rows of a set: only sets with copies are shuffled for those.
    return alone.unionByName(marked.where(ids.eqNullSafe(F.col("first"))).select("node", "n", "head").dropDuplicates(["node"]))


def regions(nodes: DataFrame) -> DataFrame:
    """key, node, n, pivot and size (members) of every member of a region with two nodes or more; of equal regions one is kept."""
    rows = nodes.select("node", "n", F.explode("head").alias("key"))
    mark = [F.sum(F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1 << 31))).alias(f"mark{i}") for i in (0, 1)]
    found = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top"), F.count("*").alias("rows"), *mark)
    found = found.where("pivot < top").groupBy("pivot", "top", "rows", "mark0", "mark1").agg(F.min("key").alias("key"))
    found = materialize(found.select("key", "pivot", F.col("rows").alias("size")), "regions")
    return keyed_join(rows, found, "key", "node").select("key", "node", "n", "pivot", "size")


def fetch_sets(documents: DataFrame, signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n and set of the given nodes, each from one document that has it."""
    one = signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("key"))
    one = materialize(one.join(nodes, "node", "left_semi"), "set-sources")
    texts = _texts(documents).join(bounded_broadcast(one), F.col("doc_id").eqNullSafe(F.col("key"))).select("node", "text")

    @lean
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, sizes, sets = [], [], []
            for name, own in zip(batch.column("node").to_pylist(), batch_sets(batch.column("text"))):
                if len(own) and node_of(own) == name:  # an id that is given twice may bring another text
                    names.append(name)
                    sizes.append(len(own))
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "n", "set"])

    return texts.mapInArrow(packed, "node long, n long, set binary")


def common(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


def _possible(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> bool:
    """Whether sets of nx and ny shingles with the heads x and y can link."""
    end = min(x[-1], y[-1])
    x, y = x[: np.searchsorted(x, end, side="right")], y[: np.searchsorted(y, end, side="right")]
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x) if len(x) and len(y) else 0
    most = both + min(nx - len(x), ny - len(y))
    return 100 * most >= PERCENT * (nx + ny - most)


def likely(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and heads do not rule out; heads: node, n and head."""
    sizes = [heads.select(F.col("node").alias(c), F.col("n").alias(f"n{c}")) for c in "ab"]
    sized = pairs.join(sizes[0], "a").join(sizes[1], "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    for c in "ab":
        sized = sized.join(heads.select(F.col("node").alias(c), F.col("head").alias(f"h{c}")), c)

    @lean
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            (x, ends_x), (y, ends_y) = (
                (c.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))].tolist())
                for c in (batch.column("ha"), batch.column("hb"))
            )
            na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            keep = [_possible(x[ends_x[i] : ends_x[i + 1]], y[ends_y[i] : ends_y[i + 1]], na[i], nb[i]) for i in range(len(na))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sized.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(checked, "a long, b long")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds linked and distance to pairs (a, b)."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))

    @lean
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            both = np.array([common(p, q) for p, q in zip(x, y)], dtype=np.int64)
            either = np.array([(len(p) + len(q)) // 8 for p, q in zip(x, y)], dtype=np.int64) - both
            arrays = [batch.column("a"), batch.column("b"), pa.array(100 * both >= PERCENT * either), pa.array(1 - both / np.maximum(either, 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "linked", "distance"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compared, "a long, b long, linked boolean, distance double")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links).withColumnRenamed("component", "c")
    return members.join(labels, "node", "left").withColumn("c", F.coalesce("c", "node"))


def _open(members: DataFrame, key: str) -> DataFrame:
    """Members of regions that still hold several components, with the region's number of members."""
    groups = members.groupBy(key).agg(F.min("c").alias("_c"), F.max("c").alias("_d"), F.count("*").alias("members"))
    return keyed_join(members, materialize(groups.where("_c < _d").select(key, "members"), "open-regions"), key, "node")


def _drawn(members: DataFrame, n: int) -> DataFrame:
    """key and pivots, n drawn members or fewer, of each region."""
    drawn = [F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(n)]
    return materialize(members.groupBy("key").agg(F.array_distinct(F.array(*drawn)).alias("pivots")), "drawn")


def _with_pivots(members: DataFrame) -> DataFrame:
    """members with pivots: one in small regions, several drawn ones in others."""
    many = members.where(F.col("size") > SMALL)
    many = keyed_join(many, _drawn(many, MANY_PIVOTS), "key", "node")
    return members.where(F.col("size") <= SMALL).withColumn("pivots", F.array("pivot")).unionByName(many)


def _small_pairs(members: DataFrame, key: str) -> DataFrame:
    x = members.where(F.col("members") <= SMALL).select(key, *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "c", "d")))
    y = members.where(F.col("members") <= SMALL).select(key, *(F.col(c).alias(f"y_{c}") for c in ("node", "n", "c", "d")))
    near = F.coalesce(F.abs(F.col("x_d") - F.col("y_d")) <= REACH + SLACK, F.lit(True)) & (100 * F.least("x_n", "y_n") >= PERCENT * F.greatest("x_n", "y_n"))
    pairs = x.join(y, key).where((F.col("x_node") < F.col("y_node")) & (F.col("x_c") != F.col("y_c")) & near)
    return pairs.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def _voronoi(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to each region's pivots; members of the smaller regions around them; members of regions that these don't halve the work of."""
    rows = keyed_join(members, _drawn(members, PIVOTS), "key", "node").select("key", "node", "n", "members", F.array_contains("pivots", F.col("node")).alias("is_pivot"), F.explode("pivots").alias("pivot"))
    pairs = rows.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    far = materialize(measured(pairs, sets), "pivot-distances")
    away = rows.where("not is_pivot").join(far.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.col("distance").alias("d")), ["node", "pivot"])
    nearest = away.withColumn("nearest", F.min("d").over(Window.partitionBy("key", "node")))
    kept = materialize(nearest.where(F.col("d") <= F.col("nearest") + 2 * REACH + SLACK).select("key", "pivot", "node", "n", "d", "members"), "voronoi")
    work = kept.groupBy("key", "pivot", "members").count().groupBy("key", "members").agg(F.sum(F.col("count") * F.col("count")).alias("work"))
    stuck = work.where(2 * F.col("work") > F.col("members") * F.col("members")).select("key")
    smaller = kept.join(stuck, "key", "left_anti").select(F.xxhash64("key", "pivot").alias("key"), "node", "n", "d").distinct()
    return far.where("linked").select("a", "b"), smaller, members.join(stuck, "key", "left_semi")


def _block_pairs(members: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs (a, b) of large regions that sizes and heads do not rule out, by pairs of blocks of about BLOCK members.

    A pair that shares several of these regions comes out of the first of them only.
    """
    own_keys = members.groupBy("node").agg(F.collect_set("key").alias("keys"))
    heads = heads.select("node", "head").join(own_keys, "node")
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    rows = members.withColumn("own", F.pmod(F.xxhash64("node", F.lit(17)), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "c", "own")
    pairs = members.groupBy("key").agg(F.max(blocks).alias("b")).agg(F.sum(F.col("b") * (F.col("b") + 1) / 2)).first()[0]
    # Comparing blocks takes long for their bytes: about a pair of blocks to a task.
    rows = rows.join(heads, "node").repartition(int(min(max(pairs or 1, 1), MOST_TASKS)), "key", "i", "j")

    def possible(group: pd.DataFrame) -> pd.DataFrame:
        node, n, c, own = (group[x].to_numpy() for x in ("node", "n", "c", "own"))
        same, key, keys = group["i"].iloc[0] == group["j"].iloc[0], group["key"].iloc[0], [set(x) for x in group["keys"]]
        sizes = group["head"].map(len).to_numpy()
        _, place = np.unique(np.concatenate(group["head"].to_list()).view(np.uint64), return_inverse=True)
        to = np.cumsum(sizes)
        begin = to - sizes
        marked = np.zeros(place.max() + 1, bool)
        out = []
        for k in range(len(node)):
            mine = place[begin[k] : to[k]]
            marked[mine] = True
            inside = place <= mine[-1]
            both = np.add.reduceat(marked[place] & inside, begin, dtype=np.int64)
            most = both + np.minimum(n - np.add.reduceat(inside, begin, dtype=np.int64), n[k] - np.searchsorted(mine, place[to - 1], side="right"))
            marked[mine] = False
            good = (node > node[k]) & (c != c[k]) & (100 * most >= PERCENT * (n + n[k] - most))
            if not same:
                good &= own != own[k]
            out += [(node[k], node[q]) for q in np.flatnonzero(good) if min(keys[k] & keys[q]) == key]
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("key", "i", "j").applyInPandas(possible, "a long, b long").distinct()


def links_and_signatures(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between nodes that join every component, and doc_id, n and node of every document."""
    signed = materialize(signatures(documents, frequent_shingles(documents)), "signatures")
    nodes = nodes_of(signed)
    members = materialize(regions(nodes), "members")
    heads = materialize(nodes.join(members.select("node").distinct(), "node", "left_semi"), "heads")

    def compare(found: DataFrame) -> DataFrame:
        found = materialize(found.distinct(), "likely")
        ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = materialize(fetch_sets(documents, signed, ends), "sets")
        out = materialize(measured(found, sets), "measured")
        discard(found, sets)
        return out

    plain, members = members, materialize(_with_pivots(members), "pivots")
    discard(plain)
    pairs = members.select(F.col("node").alias("a"), F.explode("pivots").alias("b")).where("a <> b").distinct()
    star = compare(likely(pairs, heads))
    links = star.where("linked").select("a", "b")

    # Pivots have met all members; the others carry their distance to the region's pivot, if it was measured.
    far = star.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.col("distance").alias("d"))
    rest = members.where(~F.array_contains("pivots", F.col("node"))).join(far, ["node", "pivot"], "left").select("key", "node", "n", "d")
    last = [members]
    for depth in range(DEPTH + 1):
        labelled = materialize(_labelled(rest, links), "labelled")
        rest = materialize(_open(labelled, "key"), "open")
        discard(labelled, *last)
        last = [rest]
        blocks, smaller = rest.where(F.col("members") > SMALL), None
        large = rest.where(F.col("members") > LARGE)
        if depth < DEPTH and not large.isEmpty():
            sets = materialize(fetch_sets(documents, signed, large.select("node").distinct()), "sets")
            more, smaller, stuck = _voronoi(large, sets)
            smaller = materialize(smaller, "smaller")
            discard(sets)
            links = links.unionByName(more)
            blocks = blocks.where(F.col("members") <= LARGE).unionByName(stuck.select(*rest.columns))
        found = compare(likely(_small_pairs(rest, "key"), heads).unionByName(_block_pairs(blocks, heads)))
        links = links.unionByName(found.where("linked").select("a", "b"))
        if smaller is None or smaller.isEmpty():
            break
        rest = smaller
    return links, signed.select("doc_id", "n", "node")


def all_links(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every link (a, b, distance; a < b) between nodes, and doc_id, n and node of every document.

    All pairs of a region are candidates, whether or not they are in one component already; the output can grow with
    the square of a group of near copies that are not equal.
    """
    signed = materialize(signatures(documents, frequent_shingles(documents)), "signatures")
    nodes = nodes_of(signed)
    members = materialize(regions(nodes).select("key", "node", "n"), "members")
    heads = materialize(nodes.join(members.select("node").distinct(), "node", "left_semi"), "heads")
    own = members.withColumn("c", F.col("node")).withColumn("d", F.lit(None).cast("double"))
    own = materialize(_open(own, "key"), "open")
    pairs = _small_pairs(own, "key").unionByName(_block_pairs(own.where(F.col("members") > SMALL), heads))
    pairs = materialize(likely(pairs.distinct(), heads).distinct(), "likely")
    sets = materialize(fetch_sets(documents, signed, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    links = measured(pairs, sets).where("linked").select("a", "b", "distance")
    return materialize(links, "links"), signed.select("doc_id", "n", "node")


def link_counts(documents: DataFrame) -> DataFrame:
    """doc_id and n_links, the number of other documents within reach, of every document."""
    links, signed = all_links(documents)
    copies = materialize(signed.where("n > 0").groupBy("node").agg(F.count("*").alias("copies")), "node-copies")
    both = links.select(F.col("a").alias("at"), F.col("b").alias("node")).unionByName(links.select(F.col("b").alias("at"), F.col("a").alias("node")))
    near = both.join(copies, "node").groupBy(F.col("at").alias("node")).agg(F.sum("copies").alias("near"))
    own = copies.join(near, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return signed.join(own, "node", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def document_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    links, signed = links_and_signatures(documents)
    labelled = _labelled(signed.where("n > 0"), links)
    least = materialize(labelled.groupBy("c").agg(F.min("doc_id").alias("component_id")), "least")
    joined = keyed_join(labelled, least, "c", "doc_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def keep_one(documents: DataFrame) -> DataFrame:
    """The row of smallest doc_id of each component, and all documents without words, with their columns.

    Rows are told apart by doc_id and text, so an id that stands for several texts, null included, is decided for each of
    them; where several texts of the smallest id are in one component, that of the least digest stays.
    """
    key = unused("key", documents.columns)
    own = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    found = materialize(document_components(documents.select(own.alias("doc_id"), "text")), "components").where("n_shingles > 0")
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "copies")
    keyed = documents.withColumn(key, own)
    kept = keyed.join(bounded_broadcast(gone), key, "left_anti")
    again = materialize(found.groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key), "repeated")
    if again.isEmpty():
        return kept.select(*documents.columns)
    # Rows of one id and one text: one of them stays, the others are copies of it.
    twice = bounded_broadcast(again)
    once = kept.join(twice, key, "left_anti")
    return once.unionByName(kept.join(twice, key, "left_semi").dropDuplicates([key])).select(*documents.columns)
