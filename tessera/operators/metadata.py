"""Collection metadata: languages, package managers, frameworks, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import base_name, suffix

# Names and extensions that are left out, and what names and contents stand for.
IGNORED_PARTS = (".git", "node_modules", "dist", "build", "__pycache__", ".next", ".turbo", ".venv", "venv")
IGNORED_SUFFIXES = tuple(".exe .dll .so .dylib .bin .o .a .class .jar .pyc .pyo .jpg .jpeg .png .gif .webp .ico .pdf .zip .tar .gz .7z".split())
PARSED_SUFFIXES = tuple(".py .ts .tsx .js .jsx .mjs .cjs .go .java".split())
LANGUAGES = {
    ".py": "Python",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".go": "Go",
    ".rs": "Rust",
    ".java": "Java",
    ".kt": "Kotlin",
    ".swift": "Swift",
    ".rb": "Ruby",
    ".php": "PHP",
    ".cs": "C#",
    ".cpp": "C++",
    ".c": "C",
    ".h": "C",
    ".hpp": "C++",
    ".m": "Objective-C",
    ".scala": "Scala",
}
PACKAGE_MANAGERS = {
    "package-lock.json": "npm",
    "pnpm-lock.yaml": "pnpm",
    "yarn.lock": "yarn",
    "bun.lockb": "bun",
    "bun.lock": "bun",
    "poetry.lock": "poetry",
    "Pipfile.lock": "pipenv",
    "requirements.txt": "pip",
    "uv.lock": "uv",
    "go.mod": "go modules",
    "Cargo.lock": "cargo",
    "Gemfile.lock": "bundler",
    "composer.lock": "composer",
}
FRAMEWORK_FILES = {
    "next.config.js": "Next.js",
    "next.config.ts": "Next.js",
    "nuxt.config.ts": "Nuxt",
    "nuxt.config.js": "Nuxt",
    "manage.py": "Django",
    "angular.json": "Angular",
    "vite.config.ts": "Vite",
    "vite.config.js": "Vite",
    "svelte.config.js": "SvelteKit",
    "svelte.config.ts": "SvelteKit",
    "Cargo.toml": "Rust",
}
#: By manifest: markers and frameworks, and whether case counts.
MANIFEST_MARKERS = {
    "package.json": (
        {'"next"': "Next.js", '"react"': "React", '"vue"': "Vue", '"@angular/core"': "Angular", '"svelte"': "Svelte", '"nuxt"': "Nuxt", '"nestjs"': "NestJS", '"express"': "Express"},
        True,
    ),
    "pyproject.toml": ({"fastapi": "FastAPI", "django": "Django", "flask": "Flask"}, False),
    "requirements.txt": ({"fastapi": "FastAPI", "django": "Django", "flask": "Flask"}, False),
}


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for item in values.items() for x in item)), key)


def is_ignored(path: Column) -> Column:
    parts = F.arrays_overlap(F.split(path, "/", -1), F.array(*map(F.lit, IGNORED_PARTS)))
    return parts | suffix(path).isin(*IGNORED_SUFFIXES)


def is_parsed(path: Column) -> Column:
    return suffix(path).isin(*PARSED_SUFFIXES)


def language_of(path: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for item in LANGUAGES.items() for x in item)), suffix(path))


def path_order(path: Column) -> Column:
    """Sorts paths part by part."""
    return F.split(path, "/", -1)


def language_counts(files: DataFrame) -> DataFrame:
    """language, files and position: most files first, ties by first path."""
    counted = files.where(~is_ignored(F.col("path"))).select(language_of(F.col("path")).alias("language"), path_order(F.col("path")).alias("at"))
    return counted.where("language is not null").groupBy("language").agg(F.count("*").alias("files"), F.min("at").alias("first"))


def content_frameworks(name: Column, text: Column) -> Column:
    """Frameworks that a manifest's text gives away, sorted."""
    found = []
    for manifest, (markers, cased) in MANIFEST_MARKERS.items():
        body = text if cased else F.lower(text)
        found += [F.when((name == manifest) & F.contains(body, F.lit(m)), F.lit(f)) for m, f in markers.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def sorted_set(c: Column) -> Column:
    return F.sort_array(F.collect_set(c))


def collection_metadata(files: DataFrame) -> DataFrame:
    """One row: languages, package_managers and frameworks of files (path, text)."""
    kept = files.where(~is_ignored(F.col("path"))).withColumn("name", base_name(F.col("path")))
    by_name = F.try_element_at(F.create_map(*(F.lit(x) for item in FRAMEWORK_FILES.items() for x in item)), F.col("name"))
    managers = F.try_element_at(F.create_map(*(F.lit(x) for item in PACKAGE_MANAGERS.items() for x in item)), F.col("name"))
    marked = kept.select(managers.alias("manager"), F.explode_outer(F.concat(content_frameworks(F.col("name"), F.col("text")), F.array_compact(F.array(by_name)))).alias("framework"))
    sets = marked.agg(sorted_set(F.col("manager")).alias("package_managers"), sorted_set(F.col("framework")).alias("frameworks"))
    counted = language_counts(files).agg(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("n"), "first", "language"))).alias("l"))
    return counted.select(F.col("l.language").alias("languages")).join(sets, F.lit(True))


def parsed_stats(files: DataFrame, arrays: list[str]) -> DataFrame:
    """Number of files, sum of array lengths, and the languages, of parsed files."""
    sums = [F.sum(F.coalesce(F.size(a), F.lit(0))).cast("long").alias(f"{a}_count") for a in arrays]
    return files.agg(F.count("*").alias("file_count"), *sums, sorted_set(F.nullif(F.col("language"), F.lit(""))).alias("languages"))
