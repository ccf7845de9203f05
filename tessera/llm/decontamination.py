"""Benchmark decontamination by spaced seeds, with DataFrame operations only.

A mask looks at some of a run of consecutive words and ignores the others. Every mask is put on every
place of the benchmark items and of the documents; equal hashes of the words that it looks at are a
hit, although words under the ignored places may differ. Around each hit the item and the document are compared
word by word without shifting: of the AREA item words around the hit (all, if the item is shorter) a share of at
least AGREE must be equal. Words are runs of letters, marks and digits of the lower-cased text. Items that are too short for the
shortest mask are looked for as they are: all their words in a row.

Documents' seeds meet the benchmark's in a broadcast join if those are few, and by a shuffle otherwise. Only
hits go on, gathered by document, and only documents with hits are read again for the comparison.

Defined results: null texts and texts without words match nothing; repeated items or documents give one row for each pair of
ids; null ids are kept as ids; texts are searched whole, however long; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_broadcast, materialize, unused

#: Fixed masks: the places that each compares. Each ignores at least one between them.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 1, 4, 7, 8))
#: Items of fewer words have no seeds by masks.
MASK_WORDS, LOOKED_AT = min(mask[-1] for mask in MASKS) + 1, len(MASKS[0])
AREA, AGREE = 16, 0.75
#: Seeds (places of the benchmark times masks, each with AREA numbers) up to which they are broadcast.
BROADCAST_SEEDS = 200_000


def word_codes(text: Column) -> Column:
    """The hashes of a text's words, in order."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _mask(kind: int, places: tuple[int, ...]) -> Column:
    """A mask as a struct: kind, the places that it looks at (five, null where it has fewer), and the last one."""
    columns = {f"p{i}": F.lit(places[i] if i < len(places) else None).cast("int") for i in range(LOOKED_AT)}
    return F.struct(F.lit(kind).alias("kind"), F.lit(places[-1]).alias("last"), *(c.alias(k) for k, c in columns.items()))


def with_seeds(rows: DataFrame, short: list[int], masks: bool = True) -> DataFrame:
    """rows, one for each place at of codes and each mask that fits there, with its seed: of all masks, and of as many words in a row as short has.

    There is one hash for all masks, with its places as data: the code for it stays small enough to be compiled.
    """
    kinds = [_mask(m, places) for m, places in enumerate(MASKS) if masks] + [_mask(-n, tuple(range(n))) for n in short]
    if not kinds:
        return rows.withColumns({"at": F.lit(0), "seed": F.lit(0).cast("long")}).where(F.lit(False))
    at = F.explode(F.when(F.size("codes") > 0, F.sequence(F.lit(0), F.size("codes") - 1)))
    each = rows.withColumn("at", at).withColumn("mask", F.explode(F.array(*kinds))).where(F.col("at") + F.col("mask.last") < F.size("codes"))
    return each.withColumn("seed", F.xxhash64("mask.kind", *(F.get("codes", F.col("at") + F.col(f"mask.p{i}")) for i in range(LOOKED_AT)))).drop("mask")


def short_sizes(benchmark: DataFrame) -> list[int]:
    """The numbers of words, below MASK_WORDS, that items have."""
    sizes = benchmark.select(F.size(word_codes(F.col("text"))).alias("n")).where(F.col("n").between(1, MASK_WORDS - 1)).distinct()
    return sorted(r["n"] for r in sizes.collect())


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """seed, item_id, the item's words around it (area) and where the area begins from the seed (shift)."""
    coded = benchmark.select("item_id", word_codes(F.col("text")).alias("codes"))
    start = F.greatest(F.lit(0), F.least(F.col("at") - (AREA - MASKS[-1][-1]) // 2, F.size("codes") - AREA))
    long = with_seeds(coded.where(F.size("codes") >= MASK_WORDS), [])
    rows = long.select("item_id", (start - F.col("at")).alias("shift"), F.slice("codes", start + 1, AREA).alias("area"), "seed")
    sizes = list(range(1, MASK_WORDS))
    short = with_seeds(coded.where(F.size("codes") < MASK_WORDS), sizes, masks=False).where("at = 0")
    whole = short.withColumn("n", F.size("codes")).where(F.col("seed") == whole_seed())
    return rows.unionByName(whole.select("item_id", F.lit(0).alias("shift"), F.col("codes").alias("area"), "seed")).distinct()


def whole_seed() -> Column:
    """The seed of a short item: that of all its words."""
    return F.xxhash64(-F.col("n"), *(F.get("codes", F.lit(i)) for i in range(LOOKED_AT)))


def _row_key() -> Column:
    """What tells rows apart whose doc_id is null or stands for several texts."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, agreeing and compared words of the best area, and areas, the verified ones, for every pair that has one.

    Hits are gathered by doc_id and text, so each text is held against its own alone; the pairs of one doc_id are put together at the end.
    """
    pairs = _overlaps(documents.select(_row_key().alias("doc_id"), "text"), benchmark)
    best = F.max(F.struct(F.col("agreeing") / F.col("compared"), "agreeing", "compared"))
    found = pairs.groupBy("doc_id.id", "item_id").agg(best.alias("best"), F.sum("areas").alias("areas"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "best.agreeing", "best.compared", "areas")


def _overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """overlaps of documents whose doc_id tells texts apart."""
    seeds = materialize(benchmark_seeds(benchmark), "seeds")
    few = seeds.count() <= BROADCAST_SEEDS
    coded = documents.select("doc_id", word_codes(F.col("text")).alias("codes"))
    places = with_seeds(coded, short_sizes(benchmark)).select("doc_id", "at", "seed")
    hits = places.join(F.broadcast(seeds) if few else seeds, "seed")
    hit = F.struct("item_id", (F.col("at") + F.col("shift")).alias("begin"), "area")
    hits = hits.select("doc_id", hit.alias("hit")).distinct().groupBy("doc_id").agg(F.collect_list("hit").alias("hits"))
    hits = materialize(hits.withColumnRenamed("doc_id", "key"), "hits")

    again = documents.select("doc_id", "text")
    on = again["doc_id"].eqNullSafe(hits["key"])
    again = again.join(bounded_broadcast(hits.select("key")), on, "left_semi").join(hits, on)
    again = again.select("doc_id", word_codes(F.col("text")).alias("codes"), "hits")

    def agreeing(hit: Column) -> Column:
        theirs = F.sequence(hit["begin"], hit["begin"] + F.size(hit["area"]) - 1)
        return F.aggregate(F.zip_with(hit["area"], theirs, lambda code, i: F.coalesce(F.get("codes", i) == code, F.lit(False)).cast("int")), F.lit(0), lambda a, b: a + b)

    found = F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), agreeing(h).alias("agreeing"), F.size(h["area"]).alias("compared")))
    checked = again.select("doc_id", F.explode(F.filter(found, lambda x: x["agreeing"] >= AGREE * x["compared"])).alias("x"))
    best = F.max(F.struct(F.col("x.agreeing") / F.col("x.compared"), "x.agreeing", "x.compared"))
    pairs = checked.groupBy("doc_id", F.col("x.item_id").alias("item_id")).agg(best.alias("best"), F.count("*").alias("areas"))
    return pairs.select("doc_id", "item_id", F.col("best.agreeing").cast("long").alias("agreeing"), F.col("best.compared").cast("long").alias("compared"), "areas")


def keep_uncontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents, with their columns, that overlap with no benchmark item.

    Rows are told apart by doc_id and text, so a contaminated text takes no other text of its id, null included, with it.
    """
    key = unused("key", documents.columns)
    own = _row_key()
    found = _overlaps(documents.select(own.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
    found = bounded_broadcast(materialize(found, "contaminated"))
    return documents.withColumn(key, own).join(found, key, "left_anti").select(*documents.columns)
