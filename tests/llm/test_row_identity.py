"""Rows are kept or dropped by themselves, also where ids are null or stand for several texts."""

import random
from collections import Counter

from tessera.llm import decontamination, jaccard_join

KINDS = "doc_id long, text string, key string"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(400)}" for _ in range(n))


def changed(text):
    return text.rsplit(" ", 1)[0] + " changed"


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x") for row in rows], KINDS)


def counted(kept):
    return Counter((r["doc_id"], r["text"]) for r in kept.collect())


def test_keep_one_decides_by_row(spark):
    clean = [prose(60, i) for i in range(30)]
    near = changed(clean[20])
    rows = [(None, t) for t in clean[:10]] + [(5, t) for t in clean[10:14]]  # different texts under one id
    rows += [(None, ""), (None, None), (5, " ")]  # without words
    rows += [(1, clean[20]), (None, near), (7, clean[21]), (8, changed(clean[21])), (8, clean[22])]  # near copies; 8 is one and another text
    rows += [(9, clean[23]), (9, clean[23]), (9, clean[23].upper())]  # copies under one id
    docs = frame(spark, rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    found = counted(kept)
    nine = [k for k in found if k[0] == 9]
    assert len(nine) == 1 and found.pop(nine[0]) == 1
    assert found == Counter(r for r in rows if r[0] != 9 and r not in [(None, near), (8, changed(clean[21]))])


def test_keep_one_without_repeated_ids(spark):
    text = prose(60, 50)
    assert counted(jaccard_join.keep_one(frame(spark, [(1, text), (None, changed(text)), (2, text), (3, "")]))) == {(1, text): 1, (3, ""): 1}


def test_near_copies_without_ids_leave_one(spark):
    text = prose(60, 51)
    assert sum(counted(jaccard_join.keep_one(frame(spark, [(None, text), (None, changed(text))]))).values()) == 1


def test_decontamination_decides_by_row(spark):
    item = prose(40, 90)
    rows = [(None, prose(60, 60)), (None, prose(60, 61) + " " + item), (3, prose(60, 62)), (3, item), (4, item), (4, None), (None, None), (5, prose(60, 63))]
    docs = frame(spark, rows)
    kept = decontamination.keep_uncontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert counted(kept) == Counter(r for r in rows if item not in (r[1] or ""))


def test_chat_ties_are_ordered_by_the_texts_themselves(spark):
    from tessera.llm import chat

    turns = spark.createDataFrame([(1, 0, "user", t) for t in ("<", "5", "&", "[", "a")], "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.format_conversations(turns)).first()
    assert [t["text"] for t in read["turns"]] == sorted(["<", "5", "&", "[", "a"])


def test_quality_and_toxicity_take_string_and_repeated_ids(spark):
    from tessera.llm import quality, toxicity

    texts = [prose(30, n) for n in range(60)]
    docs = spark.createDataFrame([(f"d{n % 50}", t) for n, t in enumerate(texts)] + [(None, "x")], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{n}", n % 2, n % 3 == 0) for n in range(50)], "doc_id string, quality int, flag boolean").selectExpr("doc_id", "quality", "cast(flag as int) toxic")
    assert quality.score_quality(docs, labels).where("score between 0 and 1").count() == 61
    assert toxicity.score_toxicity(docs, labels).count() == 61


def test_overlaps_of_null_and_repeated_ids(spark):
    items = [prose(40, 91), prose(40, 92)]
    rows = [(None, prose(50, n) + " " + items[n % 2]) for n in range(6)] + [(3, items[0]), (3, items[1] + " " + items[1]), (3, None), (4, prose(50, 99))]
    found = decontamination.overlaps(frame(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(None, 0), (None, 1), (3, 0), (3, 1)} and len(found) == 4
    assert all(r["agreeing"] == r["compared"] for r in found)
