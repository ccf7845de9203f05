"""Context for documentation and chat: history, retrieval queries, prompts, references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import missing_if_empty, strip, truncate

# Limits, and the kinds of documents.
HISTORY_MESSAGES, PRIOR_QUESTIONS = 8, 2
RETRIEVED, CHAT_CHARS, SNIPPETS, SNIPPET_CHARS = 8, 1200, 3, 600
DOCUMENT_KINDS = ("readme", "architecture", "api", "onboarding")
# What a prompt says where there is nothing.
NO_CONTEXT, NO_HISTORY = "No code context was retrieved.", "No prior conversation."

#: What to search for, for each kind of document: two questions each. Callers with their own pass those.
DOCUMENT_QUERIES = {
    "readme": ["what the project does and where it starts", "how to install, configure and run it"],
    "architecture": ["components, how they depend on each other and what they exchange", "stores, queues, workers and outside services"],
    "api": ["endpoints, their parameters and answers", "who may call them and how errors are reported"],
    "onboarding": ["first steps, local setup and tests for a new developer", "layout of the sources, conventions and settings"],
}


def document_queries(spark, queries: dict[str, list[str]] = DOCUMENT_QUERIES) -> DataFrame:
    rows = [(kind, n, text) for kind, texts in queries.items() for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_type string, query_no int, text string")


def checked_kinds(kinds: list[str], known: dict[str, list[str]] = DOCUMENT_QUERIES) -> list[str]:
    """kinds, if there are queries for all of them; an unknown one is an error."""
    unknown = [k for k in kinds if k not in known]
    if unknown:
        raise ValueError(f"unsupported documentation type: {', '.join(unknown)}")
    return kinds


def last_messages(turns: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def retrieval_queries(turns: DataFrame, prior: int = PRIOR_QUESTIONS) -> DataFrame:
    """conv_id, turn and query of every user turn: the last questions before it and itself, one to a line."""
    asked = turns.where((F.col("role") == "user") & (F.col("text") != "")).withColumn("text", strip(F.col("text")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-prior, 0)
    recent = F.filter(F.collect_list("text").over(w), lambda t: t != "")
    return asked.select("conv_id", "turn", F.array_join(recent, "\n").alias("query"))


def joined_in_order(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: the texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def format_history(turns: DataFrame, limit: int) -> DataFrame:
    line = F.concat(F.initcap("role"), F.lit(": "), truncate(strip(F.coalesce("text", F.lit(""))), limit, "..."))
    return last_messages(turns).groupBy("conv_id").agg(joined_in_order(F.col("turn"), line, "\n").alias("history"))


def or_else(c: Column, default: Column) -> Column:
    return F.coalesce(missing_if_empty(c), default)


# The labels of a retrieved chunk.
def context_chunk(ordinal: Column, limit: int) -> Column:
    """A retrieved chunk (path, source_ref, language, chunk_type, score, text) as prompt text."""
    path = or_else(F.col("path"), F.lit("unknown"))
    return F.concat(
        F.lit("[Chunk "), ordinal, F.lit("]\nReference: ["), or_else(F.col("source_ref"), path), F.lit("]\nFile: "), path,
        F.lit("\nLanguage: "), or_else(F.col("language"), F.lit("unknown")),
        F.lit("\nChunk type: "), or_else(F.col("chunk_type"), F.lit("unknown")),
        F.lit("\nScore: "), F.col("score").cast("string"),
        F.lit("\nContent:\n"), truncate(strip(F.coalesce("text", F.lit(""))), limit, "\n..."),
    )


def first_by_query(retrieved: DataFrame, key: str) -> DataFrame:
    """Union of the retrievals of one document: the first of equal chunks by query and rank stays."""
    w = Window.partitionBy("doc_type", key).orderBy("query_no", "rank")
    return retrieved.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def distinct_in_order(order: Column, value: Column) -> Column:
    """Aggregate: the distinct values of a group by first occurrence."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]))


def prompt(heading: str, context: DataFrame, limit: int, *keys: str) -> DataFrame:
    """One prompt for each key: heading and the retrieved chunks by ordinal."""
    block = joined_in_order(F.col("ordinal"), context_chunk(F.col("ordinal").cast("string"), limit), "\n\n")
    return context.groupBy(*keys).agg(F.concat(F.lit(heading + "\n\nRetrieved code context:\n"), block, F.lit("\n")).alias("prompt"))


def accumulated(deltas: DataFrame, key: str, order: str) -> DataFrame:
    """key, answer and deltas: the texts of each stream of deltas in order, joined, and how many there were."""
    return deltas.groupBy(key).agg(joined_in_order(F.col(order), F.coalesce("text", F.lit("")), "").alias("answer"), F.count("*").alias("deltas"))


def or_nothing(block: Column, nothing: str) -> Column:
    return F.coalesce(missing_if_empty(block), F.lit(nothing))


def snippets(retrieved: DataFrame, key: str, n: int = SNIPPETS, limit: int = SNIPPET_CHARS) -> DataFrame:
    """key and snippets (source_ref, file_path, language, code) of the first chunks by ordinal. retrieved: key, ordinal and a search result."""
    path = or_else(F.col("file_path"), F.lit("unknown"))
    one = F.struct(
        or_else(F.col("source_ref"), path).alias("source_ref"), path.alias("file_path"), F.lower(or_else(F.col("language"), F.lit("text"))).alias("language"),
        truncate(strip(F.coalesce("text", F.lit(""))), limit, "\n...").alias("code"),
    )
    kept = retrieved.where(F.col("ordinal") <= n).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ordinal", one.alias("x")))).alias("l"))
    return kept.select(key, F.col("l.x").alias("snippets"))


def retrieved_context(found: DataFrame, key: str, limit: int) -> DataFrame:
    """key, context, references and retrieved of each key's search results (ordinal and the columns of a result)."""
    rows = found.withColumn("path", F.col("file_path"))
    block = joined_in_order(F.col("ordinal"), context_chunk(F.col("ordinal").cast("string"), limit), "\n\n")
    return rows.groupBy(key).agg(block.alias("context"), distinct_in_order(F.col("ordinal"), F.col("source_ref")).alias("references"), F.count("*").alias("retrieved"))


def documentation_prompts(search: Callable[[DataFrame], DataFrame], spark, repository: str, kinds: list[str], heading: str = "", limit: int = CHAT_CHARS, queries: dict[str, list[str]] = DOCUMENT_QUERIES) -> DataFrame:
    """doc_type, prompt, references and retrieved for each kind of document.

    search: from query_id and text to query_id, rank and the columns of a search result (search.search_points). The results
    of a kind's questions are joined, each chunk once, by question and rank.
    """
    asked = document_queries(spark, {k: queries[k] for k in checked_kinds(kinds, queries)}).withColumn("query_id", F.xxhash64("doc_type", "query_no"))
    found = search(asked.select("query_id", "text")).join(asked.select("query_id", "doc_type", "query_no"), "query_id").where(F.trim("chunk_id") != "")
    once = first_by_query(found, "chunk_id")
    numbered = once.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_type").orderBy("query_no", "rank")))
    joined = asked.select("doc_type").distinct().join(retrieved_context(numbered, "doc_type", limit), "doc_type", "left")
    head = F.concat(F.lit(f"Repository: {repository}\nDocumentation type: "), F.col("doc_type"), F.lit(f"\n\n{heading}\nRetrieved code context:\n"))
    empty = F.array().cast("array<string>")
    return joined.select("doc_type", F.concat(head, or_nothing(F.col("context"), NO_CONTEXT), F.lit("\n")).alias("prompt"), F.coalesce("references", empty).alias("references"), F.coalesce("retrieved", F.lit(0)).alias("retrieved"))


def chat_turn(turns: DataFrame, questions: DataFrame, search: Callable[[DataFrame], DataFrame], generate: Callable[[Column], Column], repository: str, heading: str = "", limit: int = CHAT_CHARS) -> tuple[DataFrame, DataFrame]:
    """One turn of every session: (answers, turns with the new messages).

    turns: conv_id, turn, role, text; questions: conv_id (an integer), question, one a session; search as for documentation; generate:
    from the prompt to the answer. answers: conv_id, question, prompt, answer, references, snippets and retrieved.
    """
    history = last_messages(turns)
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    asked = questions.join(last, "conv_id", "left").select("conv_id", "question", (F.coalesce("last", F.lit(-1)) + 1).alias("turn"))
    both = history.select("conv_id", "turn", "role", "text").unionByName(asked.select("conv_id", "turn", F.lit("user").alias("role"), F.col("question").alias("text")))
    wanted = retrieval_queries(both).join(asked.select("conv_id", "turn"), ["conv_id", "turn"])
    found = search(wanted.select(F.col("conv_id").cast("long").alias("query_id"), F.col("query").alias("text"))).withColumnRenamed("query_id", "conv_id").withColumn("ordinal", F.col("rank"))
    rows = asked.join(format_history(turns, limit), "conv_id", "left").join(retrieved_context(found, "conv_id", limit), "conv_id", "left").join(snippets(found, "conv_id"), "conv_id", "left")
    prompt = F.concat(
        F.lit(f"Repository: {repository}\nUser question: "), F.col("question"), F.lit(f"\n\n{heading}\nRecent conversation:\n"), or_nothing(F.col("history"), NO_HISTORY),
        F.lit("\n\nRetrieved repository context:\n"), or_nothing(F.col("context"), NO_CONTEXT), F.lit("\n"),
    )
    answered = rows.withColumn("prompt", prompt).withColumn("answer", strip(generate(F.col("prompt"))))
    answers = answered.select("conv_id", "question", "prompt", "answer", F.coalesce("references", F.array().cast("array<string>")).alias("references"), "snippets", F.coalesce("retrieved", F.lit(0)).alias("retrieved"))
    new = answered.select("conv_id", F.posexplode(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))).alias("n", "m"), "turn")
    kept = turns.select("conv_id", "turn", "role", "text").unionByName(new.select("conv_id", (F.col("turn") + F.col("n")).alias("turn"), "m.role", "m.text"))
    return answers, last_messages(kept)


def repository_summary(name: Column, estimate: Column, files: Column) -> Column:
    """The sentence that sums up an indexed collection."""
    count = F.coalesce(estimate, files, F.lit(0)).cast("string")
    return F.concat(F.lit("Generated AI summary for "), name, F.lit(". Estimated indexed files: "), count, F.lit("."))
