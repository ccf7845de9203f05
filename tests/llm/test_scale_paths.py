"""What is done beyond the bounds of broadcasts gives the same results, and intermediate tables go."""

import os
import random

import pytest

from tessera.llm import decontamination, jaccard_join, shared


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def docs(spark):
    texts = [prose(30, i % 7) + " " + prose(3, i) for i in range(40)] + [prose(30, 1)] * 5 + [None, "", "one two"] * 2
    return spark.createDataFrame(list(enumerate(texts)) + [(None, prose(30, 1)), (3, prose(30, 2))], "doc_id long, text string")


@pytest.mark.parametrize("small", [32, 2])
def test_joins_without_broadcast(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rows = docs(spark)
    found = sorted(map(tuple, jaccard_join.document_components(rows).collect()), key=repr)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    assert found == sorted(map(tuple, jaccard_join.document_components(rows).collect()), key=repr)
    assert len({c for _, n, c in found if n}) < 12


def test_discard_removes_the_table(spark):
    table = shared.materialize(spark.range(3), "x")
    path = table.materialized_at.removeprefix("file://")
    assert os.path.isdir(path)
    shared.discard(table)
    assert not os.path.exists(path)


def test_no_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_short_items_are_found_whole(spark):
    text = prose(30, 1)
    words = text.split()
    items = [(1, " ".join(words[4:7])), (2, " ".join(words[10:15])), (3, "never there"), (4, " ".join(words[2:4][::-1])), (5, ""), (6, None), (7, " ".join(words[8:14]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame([(0, text), (1, prose(9, 77)), (2, None)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["agreeing"], r["compared"]) for r in decontamination.overlaps(rows, benchmark).collect())
    assert found == [(0, 1, 3, 3), (0, 2, 5, 5), (0, 7, 6, 6)]


def brute(documents, items):
    """All pairs, all offsets: the best share of a window of AREA item words that agrees without shifting, where some mask hits in it."""
    import re

    out = set()
    coded = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in documents]
    for item, text in items:
        theirs = re.findall(r"\w+", text.lower())
        for i, own in coded:
            for shift in range(-len(theirs), len(own)):
                equal = [0 <= k + shift < len(own) and theirs[k] == own[k + shift] for k in range(len(theirs))]
                for at in range(len(theirs)):
                    if not any(at + m[-1] < len(theirs) and all(equal[at + p] for p in m) for m in decontamination.MASKS):
                        continue
                    start = max(0, min(at - (decontamination.AREA - decontamination.MASKS[-1][-1]) // 2, len(theirs) - decontamination.AREA))
                    area = equal[start : start + decontamination.AREA]
                    if sum(area) >= decontamination.AGREE * len(area):
                        out.add((i, item))
    return out


def test_pairs_equal_brute_force(spark):
    r = random.Random(4)
    items = [(k, prose(r.randint(6, 40), 500 + k)) for k in range(8)]
    documents = []
    for i in range(40):
        own = prose(25, 900 + i).split()
        if i % 2:
            part = items[i % 8][1].split()
            part = [w if r.random() > (i % 5) * 0.1 else "changed" for w in part]
            own[10:10] = part
        documents.append((i, " ".join(own)))
    rows, benchmark = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontamination.overlaps(rows, benchmark).collect()}
    assert found == brute(documents, items) and found
