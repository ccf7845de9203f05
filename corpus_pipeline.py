"""Corpus pipeline: stages of training-data operators, each reading what the previous one kept.

1. quality          documents that the compression classifier rejects go
2. near_duplicates  one document of each group of near duplicates stays, that of the smallest doc_id
3. decontamination  documents that overlap with a benchmark item go
4. secrets          secrets in texts are replaced
5. sentencepiece    texts become piece ids

Executors carry memory from one stage to the next. So every stage has Spark hand its Python workers small Arrow batches (the session
keeps that setting) and begins with heaps freed of what the stage before it left. The first four return the columns of documents. Nulls, empty and repeated rows are handled as the operators state it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard_join, pieces, quality, secrets
from tessera.llm.shared import materialize, read_table, shrink_heaps, small_batches


def prepare(spark: SparkSession) -> None:
    small_batches(spark)
    shrink_heaps(spark)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontamination.keep_uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secrets.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pieces.encode_documents(docs)


STAGES = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
