"""Each stage of the pipeline, and the chain, against what the stages say, with nulls, repeated rows and other columns."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontamination, jaccard_join, pieces, quality, secrets, shared

WORDS = [f"w{i}" for i in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ITEM = prose(20, 777)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _gone string, key int"


def corpus():
    texts = [prose(60, i) for i in range(60)]
    texts += [texts[0], texts[1] + " more", f"{prose(30, 90)} {ITEM} {prose(30, 91)}", f'{prose(40, 92)} token = "{"ab12" * 10}" {prose(9, 93)}']
    texts += [prose(60, 100 + i).upper().replace(" ", "!!! ") for i in range(20)] + [None, "", "one"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, prose(60, 500)), (None, prose(60, 501))]
    return [(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(corpus(), COLUMNS).write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(i < 64), 0) for i in range(84) if i % 2] + [(None, 1, None), (3, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def key(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)


def test_stages_are_those_of_their_operators(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "sentencepiece"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, folder)
    scored = {(r["doc_id"], r["score"]) for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in scored}
    once = stages["near_duplicates"](spark, docs, folder)
    components = jaccard_join.document_components(docs).collect()
    ids = {r["doc_id"] for r in components if r["n_shingles"] == 0 or r["doc_id"] == r["component_id"]}
    assert once.columns == docs.columns and {r["doc_id"] for r in once.collect()} == ids | {None} and once.count() == 90 - 3
    clean = stages["decontamination"](spark, docs, folder)
    hit = {r["doc_id"] for r in decontamination.overlaps(docs, benchmark).collect()}
    assert hit == {62} and key(clean.collect()) == key(r for r in docs.collect() if r["doc_id"] != 62)
    redacted = {r["doc_id"]: r for r in stages["secrets"](spark, docs, folder).collect() if r["doc_id"] is not None}
    assert secrets.REPLACEMENT in redacted[63]["text"] and "ab12ab12" not in redacted[63]["text"] and redacted[63]["n_chars"] == len(redacted[63]["text"])
    assert redacted[84]["text"] is None and redacted[85]["text"] == "" and redacted[0]["text"] == prose(60, 0)


def test_the_chain(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    ids = sorted((r["doc_id"] for r in found.select("doc_id").collect()), key=repr)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    assert ids == sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=repr)
    encoded = pieces.encode_documents(docs)
    assert found.columns == encoded.columns and found.select("doc_id").subtract(encoded.select("doc_id")).isEmpty()


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_hand_workers_small_batches(spark, folder, name):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(setting)
    dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (b.slice(0, 1).set_column(0, "id", pa.array([len(b)])) for b in batches), "id long")
    assert max(r["id"] for r in sizes.collect()) <= shared.SLICE_ROWS
    spark.conf.unset(setting)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_begin_with_heaps_freed(spark, folder, name):
    def whole_collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = whole_collections()
    dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert whole_collections() > before


def test_workers_return_memory_after_each_batch_and_task(monkeypatch):
    made, returned = [], []
    monkeypatch.setattr(shared, "return_memory", lambda: returned.append(len(made)))

    @shared.lean
    def work(batches):
        for b in batches:
            made.append(b)
            yield b

    assert list(work(iter("ab"))) == ["a", "b"] and returned == [1, 2, 2]
