"""Chunks of files under a size budget.

A file gives one module chunk, one for each class and function with a location, and one for each route. A
chunk's body is split into parts that fit the budget together with a header; neighbouring parts share lines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import chunk_id, contains_any, line_slice, non_blank, route_label, source_ref, split_lines, strip

# The budget, what is set aside for growth of the header, the smallest budget, shared lines, and list limits.
MAX_CHARS, RESERVE, LEAST_BUDGET, OVERLAP = 1800, 32, 32, 2
LIST_LIMIT, RELATED_LIMIT, OUTLINE_LIMIT = 12, 6, 6


def split_body(body: str, budget: int, overlap: int = OVERLAP) -> list[str]:
    """Parts of at most budget characters, made of whole lines where those fit.

    A part ends before the line that would overflow it, and the next begins with its last lines if those and the
    new line fit together. A line over the budget is cut into sections of its own.
    """
    parts: list[str] = []
    held: list[str] = []
    fresh = False  # whether held has a line that is in no part yet

    def close() -> None:
        if fresh:
            parts.append("\n".join(held).strip())

    def size(lines: list[str]) -> int:
        return sum(map(len, lines)) + len(lines)

    for line in body.splitlines():
        if len(line) + 1 > budget:
            close()
            held, fresh = [], False
            parts.extend(line[i : i + budget].strip() for i in range(0, len(line), budget))
            continue
        if size(held) + len(line) + 1 > budget:
            close()
            held = held[-overlap:] if size(held[-overlap:]) + len(line) + 1 <= budget else []
        held.append(line)
        fresh = True
    close()
    return [p for p in parts if p]


def parts_of(body: str | None, header: str | None, limit: int) -> list[str]:
    """What body_parts gives, for one body."""
    body, header = (body or "").strip(), header or ""
    if not body:
        return []
    if len(header) + 2 + len(body) <= limit:
        return [body]
    return split_body(body, max(limit - len(header) - RESERVE, LEAST_BUDGET))


def body_parts(body: Column, header: Column, limit: int) -> Column:
    """The parts of a body that fit the limit together with its header, on Arrow batches.

    As a fold over lines in the JVM (aggregate) the same took 15 times as long: higher-order functions are interpreted.
    """

    def split(bodies: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([parts_of(b, h, limit) for b, h in zip(bodies, headers)])

    return F.pandas_udf(split, "array<string>")(body, header)


def module_type(path: Column, classes: Column, apis: Column) -> Column:
    routed = (F.size(apis) > 0) | contains_any(F.lower(path), ("route", "api"))
    return F.when(routed, "route_module").when(F.size(classes) > 0, "class_module").otherwise("module")


def _listed(label: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(label + ": "), F.array_join(items, ", ")))


def header() -> Column:
    """The header of a chunk row, without the part line; absent values have no line."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), F.col("path")),
        F.concat(F.lit("Language: "), F.col("language")),
        F.concat(F.lit("Module type: "), F.col("module_type")),
        F.concat(F.lit("Chunk type: "), F.col("chunk_type")),
        F.when(F.col("symbol") != "", F.concat(F.lit("Symbol: "), F.col("symbol"))),
        F.concat(F.lit("Source ref: "), source_ref(F.col("path"), F.col("start_line"), F.col("end_line"))),
        _listed("Dependencies", F.col("dependencies")),
        _listed("Related symbols", F.col("related")),
        _listed("Routes", F.col("routes")),
    )


def module_summary() -> Column:
    def names(items: str) -> Column:
        return F.slice(F.filter(F.transform(items, lambda x: strip(x["name"])), lambda n: n != ""), 1, LIST_LIMIT)

    routes = F.transform("apis", lambda a: route_label(a["method"], a["route"]))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Module summary for "), F.col("path")),
        F.concat(F.lit("Language: "), F.col("language")),
        F.concat(F.lit("Module type: "), F.col("module_type")),
        _listed("Dependencies", F.slice("dependencies", 1, LIST_LIMIT)),
        _listed("Classes", names("classes")),
        _listed("Functions", names("functions")),
        _listed("Routes", F.slice(routes, 1, LIST_LIMIT)),
        _listed("Exports", names("exports")),
        F.array_join(F.slice("outline", 1, OUTLINE_LIMIT), "\n"),
    )
    bare = (F.size("functions") == 0) & (F.size("classes") == 0) & (F.size("apis") == 0)
    return F.when(bare, strip(F.concat(strip(lines), F.lit("\n\n"), strip(F.col("text"))))).otherwise(strip(lines))


_BODY = (
    "array<struct<family:int,chunk_type:string,at:int,symbol:string,related:array<string>,routes:array<string>,body:string,start_line:int,end_line:int>>"
)


def bodies(files: DataFrame) -> DataFrame:
    """One row for each chunk before splitting. A file's chunks are one array, so each text is read and cut into lines once.

    files: path, language, text, dependencies and outline (strings), functions (name, start_line, end_line),
    classes (name, methods, start_line, end_line), apis (name, method, route), exports (name).
    """
    rows = files.withColumns({"dependencies": non_blank(F.col("dependencies")), "outline": non_blank(F.col("outline")), "lines": split_lines(F.col("text"))})
    rows = rows.withColumn("module_type", module_type(F.col("path"), F.col("classes"), F.col("apis")))
    none = F.array().cast("array<string>")

    def chunk(family: int, kind: str, at: Column, symbol: Column, related: Column, routes: Column, body: Column, start: Column, end: Column) -> Column:
        return F.struct(
            F.lit(family).alias("family"), F.lit(kind).alias("chunk_type"), at.alias("at"), symbol.alias("symbol"), F.slice(related, 1, LIST_LIMIT).alias("related"),
            F.slice(routes, 1, LIST_LIMIT).alias("routes"), body.alias("body"), start.alias("start_line"), end.alias("end_line"),
        )

    def numbered(items: str, valid) -> Column:
        return F.filter(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda n: valid(n["x"]))

    def located(x: Column) -> Column:
        return (x["name"] != "") & x["start_line"].isNotNull() & x["end_line"].isNotNull()

    def code(x: Column) -> Column:
        return line_slice(F.col("lines"), x["start_line"], x["end_line"])

    some_functions = F.filter(F.transform(F.slice("functions", 1, RELATED_LIMIT), lambda f: f["name"]), lambda n: n != "")
    some_routes = F.transform(F.slice("apis", 1, RELATED_LIMIT), lambda a: route_label(a["method"], a["route"]))
    last = F.greatest(F.size("lines"), F.lit(1))
    module = F.array(chunk(0, "module", F.lit(0), F.lit(None).cast("string"), some_functions, some_routes, module_summary(), F.lit(1), last))
    classes = F.transform(
        numbered("classes", located), lambda n: chunk(1, "class", n["i"], strip(n["x"]["name"]), non_blank(n["x"]["methods"]), none, code(n["x"]), n["x"]["start_line"], n["x"]["end_line"])
    )

    def function(n: Column) -> Column:
        x = n["x"]
        return chunk(2, "function", n["i"], strip(x["name"]), owners_of(x["name"]), routes_of(strip(x["name"])), code(x), x["start_line"], x["end_line"])

    def route(n: Column) -> Column:
        x = n["x"]
        handler = handler_of(x["name"])
        inlined = F.concat(x["method"], F.lit(" "), x["route"], F.lit("\nHandler: "), x["name"])
        body = F.when(handler.isNotNull(), code(handler)).otherwise(inlined)
        return chunk(3, "route", n["i"], x["name"], F.array(x["name"]), F.array(route_label(x["method"], x["route"])), body, handler["start_line"], handler["end_line"])

    functions = F.transform(numbered("functions", located), function)
    routes = F.transform(numbered("apis", lambda a: (a["name"] != "") & (a["route"] != "")), route)
    found = F.concat(module.cast(_BODY), classes.cast(_BODY), functions.cast(_BODY), routes.cast(_BODY))
    kept = [F.col(c) for c in ("repository",) if c in files.columns]
    base = ["path", "language", "module_type", F.slice("dependencies", 1, LIST_LIMIT).alias("dependencies")]
    return rows.select(*kept, *base, F.explode(found).alias("x")).select(*kept, "path", "language", "module_type", "dependencies", "x.*")


def routes_of(name: Column) -> Column:
    """The routes of a file whose handler is name."""
    return F.transform(F.filter("apis", lambda a: strip(a["name"]) == name), lambda a: route_label(a["method"], a["route"]))


def owners_of(name: Column) -> Column:
    """The classes of a file that have a method of that name."""
    return F.transform(F.filter("classes", lambda c: F.array_contains(c["methods"], name)), lambda c: c["name"])


def handler_of(name: Column) -> Column:
    """The first function of a file with that name, null if there is none."""
    return F.get(F.filter("functions", lambda f: f["name"] == name), F.lit(0))


def chunks(files: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """chunk_id, text and the metadata of every part of every chunk."""
    rows = bodies(files).withColumn("header", header())
    parts = rows.withColumn("parts", body_parts(F.col("body"), F.col("header"), max_chars))
    parts = parts.withColumn("part_count", F.size("parts")).select("*", F.posexplode("parts").alias("n", "part")).withColumn("part_index", F.col("n") + 1)
    numbered = F.when(F.col("part_count") > 1, F.concat(F.lit("\nChunk part: "), F.col("part_index"), F.lit("/"), F.col("part_count"))).otherwise("")
    text = F.concat(F.col("header"), numbered, F.lit("\n\n"), F.col("part"))
    out = parts.withColumns({"chunk_id": chunk_id(F.col("path"), F.col("chunk_type"), F.col("symbol"), F.col("part_index")), "text": text})
    out = out.withColumns({"text_length": F.length("text"), "source_ref": source_ref(F.col("path"), F.col("start_line"), F.col("end_line"))})
    return out.drop("body", "header", "parts", "n", "part")
