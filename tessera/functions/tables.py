"""Table functions for SQL: the parts of a body, and the tokens of a source text, a row each.

    register(spark)
    spark.sql("SELECT path, p.* FROM bodies, LATERAL split_parts(body, header, 1800) p")

Rows go to Python in Arrow batches; a row's result may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunking import parts_of
from tessera.operators.nesting import nested_tokens


class SplitParts:
    def eval(self, body: str, header: str, limit: int) -> Iterator[tuple]:
        parts = parts_of(body, header, limit)
        for n, part in enumerate(parts, 1):
            yield n, len(parts), part


class SourceTokens:
    def eval(self, text: str, indented: bool) -> Iterator[tuple]:
        yield from nested_tokens(text or "", bool(indented))


split_parts = F.udtf(SplitParts, returnType="part_index int, part_count int, part string", useArrow=True)
source_tokens = F.udtf(SourceTokens, returnType="at int, kind string, token string, line int, depth int, parent int", useArrow=True)


def register(spark: SparkSession) -> None:
    spark.udtf.register("split_parts", split_parts)
    spark.udtf.register("source_tokens", source_tokens)
