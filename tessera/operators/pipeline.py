"""What users call: parse a collection, index what changed of it, and a whole job with its documentation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import context, events, metadata, search
from tessera.operators.chunking import MAX_CHARS, chunks
from tessera.operators.indexing import changed_only, diff, merge_snapshot, stale_paths
from tessera.operators.points import build_points, replace_points, run_summary, same_size
from tessera.operators.progress import EVENT, JobProgress
from tessera.operators.symbols import REGISTRY, parse_files, parsed_summary
from tessera.sources.tables import decode_text, read_files


def parse_collection(spark: SparkSession, root: str, registry: dict = REGISTRY) -> DataFrame:
    """Symbols of all files under root that are read; the others' content is not."""
    files = read_files(spark, root).where(~metadata.is_ignored(F.col("path")))
    return parse_files(files.select("path", decode_text(F.col("content")).alias("text"), F.col("sha256").alias("hash")), registry)


@dataclass
class Indexed:
    """One run: all that is kept (state: parsed files with their hashes; points), the changes (path, status), and one-row tables."""

    state: DataFrame
    points: DataFrame
    changes: DataFrame
    stats: DataFrame
    summary: DataFrame


def index_collection(
    files: DataFrame, repository: str, embed: Callable[[DataFrame], DataFrame], state: DataFrame | None = None, points: DataFrame | None = None, registry: dict = REGISTRY, max_chars: int = MAX_CHARS, progress: JobProgress | None = None
) -> Indexed:
    """Index the files (path, hash, text) of a collection: only what changed since state is parsed, cut and embedded.

    state and points: of the run before, absent in the first. Points of changed and removed files go before the new ones come. Vectors of another
    size than the index has are an error. The results are plans; write them before the tables that they read are replaced. With progress, each stage is
    written as it ends, and told.
    """
    step = progress.step if progress else lambda _, rows: rows
    known = files.where(~metadata.is_ignored(F.col("path")) & metadata.is_parsed(F.col("path")))
    previous = state.select("path", "hash") if state is not None else files.select("path", "hash").where(F.lit(False))
    changes = step("diffing", diff(known.select("path", "hash"), previous))
    fresh = step("parsing", parse_files(changed_only(known, changes), registry))
    made = step("summarizing", build_points(chunks(fresh.withColumn("repository", F.lit(repository)), max_chars), embed))
    merged = merge_snapshot(state, fresh, changes) if state is not None else fresh
    kept = replace_points(points, same_size(made, _size(points)), stale_paths(changes)) if points is not None else made
    summary = run_summary(repository, made)
    counts = changes.agg(*(F.count_if(F.col("status") == s).alias(f"{s}_files") for s in ("changed", "removed", "unchanged")))
    return Indexed(merged, kept, changes.select("path", "status"), parsed_summary(merged), summary.join(counts, F.lit(True)))


def _size(points: DataFrame) -> int | None:
    row = points.where("dense is not null").select(F.size("dense").alias("n")).first()
    return row["n"] if row else None


def search_index(spark: SparkSession, points: DataFrame, embed: Callable[[DataFrame], DataFrame], **filters) -> Callable[[DataFrame], DataFrame]:
    """A search for context.chat_turn and context.documentation_prompts."""
    return lambda queries: search.search_points(queries, points, embed, **filters)


def run_job(
    spark: SparkSession, files: DataFrame, repository: str, embed: Callable[[DataFrame], DataFrame], generate: Callable[[Column], Column], doc_types: list[str], state: DataFrame | None = None, points: DataFrame | None = None, progress: JobProgress | None = None
) -> tuple[Indexed, DataFrame, DataFrame, DataFrame]:
    """A whole job: (the index, one row of metadata and summary, documents, progress).

    With progress, the stages run now, one after the other, each told as it ends, an error too; then the last table has what was told, else the stages to come.

    documents: doc_type, markdown, references and retrieved of the kinds in doc_types; generate: from prompt to text.
    """
    if progress is None:
        return _job(spark, files, repository, embed, generate, doc_types, state, points, None)
    with progress.running():
        indexed, described, documents, _ = _job(spark, files, repository, embed, generate, doc_types, state, points, progress)
    return indexed, described, documents, spark.createDataFrame([tuple(e.values()) for e in progress.events], EVENT)


def _job(spark, files, repository, embed, generate, doc_types, state, points, progress) -> tuple[Indexed, DataFrame, DataFrame, DataFrame]:
    step = progress.step if progress else lambda _, rows: rows
    step("cloning", files.select("path"))
    found = step("metadata", metadata.collection_metadata(files.select("path", "text")))
    indexed = index_collection(files, repository, embed, state, points, progress=progress)
    described = found.join(indexed.stats.drop("languages"), F.lit(True))
    described = described.withColumn("summary", context.repository_summary(F.lit(repository), F.col("file_count_estimate"), F.col("file_count")))
    prompts = context.documentation_prompts(search_index(spark, indexed.points, embed, limit=context.RETRIEVED, repository=repository), spark, repository, doc_types) if doc_types else None
    empty = "doc_type string, markdown string, references array<string>, retrieved long"
    documents = prompts.select("doc_type", F.trim(generate(F.col("prompt"))).alias("markdown"), "references", "retrieved") if prompts is not None else spark.createDataFrame([], empty)
    if doc_types:
        documents = step("documentation", documents)
    job = spark.createDataFrame([(repository, doc_types)], "job_id string, doc_types array<string>")
    return indexed, described, documents, events.progress_events(job)
