"""String expressions of the engine. All take and return columns; lengths are code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line separators, and the path separator of chunk ids.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def missing_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def split_lines(c: Column) -> Column:
    """Lines without their separators; a separator at the end does not begin another line."""
    parts = F.split(c, LINE_BREAK, -1)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_slice(lines: Column, start: int | Column, end: int | Column) -> Column:
    """Lines start to end (from 1, inclusive), joined and stripped."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    first = F.greatest(start, F.lit(1))
    return strip(F.array_join(F.slice(lines, first, F.greatest(end - first + 1, F.lit(0))), "\n"))


def truncate(c: Column, limit: int, suffix: str) -> Column:
    return F.when(F.length(c) > limit, F.concat(rstrip(F.substring(c, 1, limit)), F.lit(suffix))).otherwise(c)


def hard_split(c: Column, budget: int) -> Column:
    """Sections of budget characters."""
    last = F.floor(F.greatest(F.length(c) - 1, F.lit(0)) / budget).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * budget + 1, F.lit(budget)))


def slug(c: Column, prefix: str) -> Column:
    core = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit(prefix + "_"), F.coalesce(missing_if_empty(core), F.lit("repository")))


def node_id(c: Column) -> Column:
    """Identifier of a diagram node; runs are kept, so different names may coincide."""
    return F.concat(F.lit("n_"), F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_"), "^_+|_+$", ""))


def node_label(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit("'"))


def file_type(path: Column) -> Column:
    """Text after the last dot of the whole path, null without a dot."""
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased last extension of the file name with its dot; empty for dotfiles."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def source_ref(path: Column, start: Column, end: Column) -> Column:
    return F.coalesce(F.concat(path, F.lit(":"), start, F.lit("-"), end), path)


def route_label(method: Column, route: Column) -> Column:
    return strip(F.concat_ws(" ", F.upper(strip(method)), strip(route)))


def chunk_id(path: Column, kind: Column, symbol: Column, part: Column) -> Column:
    name = F.translate(F.coalesce(missing_if_empty(symbol), F.lit("module")), " /", "__")
    return F.concat_ws("::", path, kind, name, part.cast("string"))


def quoted_value(c: Column) -> Column:
    """The first quoted text, by kind of quote: single, double, backtick."""
    found = [F.when(F.length(c) - F.length(F.replace(c, F.lit(q), F.lit(""))) >= 2, F.split(c, q, -1)[1]) for q in ("'", '"', "`")]
    return F.coalesce(*found, F.lit(""))


def branch_of_ref(ref: Column) -> Column:
    return F.coalesce(missing_if_empty(F.regexp_replace(ref, "^refs/heads/", "")), F.lit("main"))


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


# Fixed value: the shape of a repository's address, with owner and name.
REPOSITORY = r"^https://[A-Za-z0-9_.-]+/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"


def is_repository_url(url: Column) -> Column:
    return url.rlike(REPOSITORY)


def repository_url(url: Column) -> tuple[Column, Column]:
    """owner and name of a repository's address, empty for another."""
    return F.regexp_extract(url, REPOSITORY, 1).alias("owner"), F.regexp_extract(url, REPOSITORY, 2).alias("name")


def url_parts(url: Column) -> tuple[Column, Column]:
    """scheme and host."""
    shape = r"^(https?)://([^/]+)(/[^?#]*)?"
    return F.regexp_extract(url, shape, 1).alias("scheme"), F.regexp_extract(url, shape, 2).alias("host")


def links(html: Column) -> Column:
    """Targets of the links of a page, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1)))


def by_position(items: str, names: str) -> Column:
    """item and name of each of items: the name at the same place, or the item itself past the end of names."""
    return F.transform(items, lambda x, i: F.struct(x.alias("item"), F.coalesce(F.get(names, i), x).alias("name")))


def state_key(scope: Column) -> Column:
    """A key for a scope of several parts."""
    return F.replace(scope, F.lit("/"), F.lit(":"))


def sse_event(name: Column, payload: Column) -> Column:
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), payload, F.lit("\n\n"))


def setting_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ",", -1), strip), lambda x: x != "")


def non_blank(strings: Column) -> Column:
    return F.filter(F.transform(F.coalesce(strings, F.array().cast("array<string>")), strip), lambda x: x != "")


def last_n(items: Column, n: int) -> Column:
    return F.reverse(F.slice(F.reverse(items), 1, n))


def flag_arguments(values: Column, flag: str) -> Column:
    return F.flatten(F.transform(values, lambda v: F.array(F.lit(flag), v)))


def number_or(c: Column, default: float) -> Column:
    value = c.try_cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value).otherwise(F.lit(default))
