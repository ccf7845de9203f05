"""Services of a collection, its architecture, and diagrams of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import contains_any, missing_if_empty, node_id, node_label, route_label, strip
from tessera.operators.context import joined_in_order

# Marker files and words of a service; limits of the diagrams.
MARKERS = ("package.json", "pyproject.toml", "requirements.txt", "go.mod", "Cargo.toml", "Dockerfile", "docker-compose.yml")
WORDS = ("api", "service", "worker", "server", "backend")
MAX_FILES, MAX_EDGES, LABELLED = 80, 8, 3


def service_groups(files: DataFrame, listing: DataFrame, whole: str) -> DataFrame:
    """name, apis, dependencies and files of each service; one group called whole if there is none.

    files: path, api_count, dependency_count; listing: path of every file, for the markers.
    """
    marks = listing.where((F.size(F.split("path", "/")) == 2) & F.split("path", "/")[1].isin(*MARKERS))
    marks = marks.groupBy(F.split("path", "/")[0].alias("name")).agg(F.count_distinct("path").alias("marks"))
    inside = files.where(F.contains("path", F.lit("/"))).withColumn("name", F.split("path", "/")[0])
    sums = [F.sum("api_count").alias("apis"), F.sum("dependency_count").alias("dependencies"), F.count("*").alias("files")]
    groups = inside.groupBy("name").agg(*sums, F.count_if(F.col("api_count") > 0).alias("with_apis")).join(marks, "name", "left")
    score = F.coalesce("marks", F.lit(0)) + contains_any(F.lower("name"), WORDS).cast("int") + F.col("with_apis")
    found = groups.where((score > 0) | (F.col("apis") > 0) | (F.col("dependencies") >= 2)).select("name", "apis", "dependencies", "files")
    fallback = files.agg(*(F.coalesce(s, F.lit(0)).alias(n) for s, n in zip(sums, ("apis", "dependencies", "files")))).select(F.lit(whole).alias("name"), "*")
    none = found.agg(F.count("*").alias("_found")).where("_found = 0")
    return found.unionByName(fallback.join(none, F.lit(True)).drop("_found"))


def architecture_type(groups: DataFrame, files: DataFrame) -> DataFrame:
    service = (F.col("name") != "packages") & ((F.col("apis") > 0) | (F.col("dependencies") > 2))
    counted = groups.agg(F.count_if(service).alias("services")).join(files.agg(F.count_distinct(F.coalesce("language", F.lit(""))).alias("languages")), F.lit(True))
    kind = F.when(F.col("services") >= 2, "microservices").when((F.col("languages") > 1) & (F.col("services") > 0), "modular_monolith").otherwise("monolith")
    return counted.select(kind.alias("architecture_type"), "services", "languages")


def dependency_edges(files: DataFrame) -> DataFrame:
    """file_no, dep_no, path, dependency, source and target of the distinct edges of the first files.

    files: path and dependencies. The limit on files comes before files without dependencies are left out.
    """
    first = files.orderBy("path").limit(MAX_FILES)
    numbered = first.withColumn("file_no", F.row_number().over(Window.orderBy("path")))
    edges = numbered.select("file_no", "path", F.posexplode(F.slice("dependencies", 1, MAX_EDGES)).alias("dep_no", "dependency"))
    edges = edges.withColumns({"source": node_id(F.col("path")), "target": node_id(F.col("dependency"))})
    w = Window.partitionBy("source", "target").orderBy("file_no", "dep_no")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dependency_diagram(edges: DataFrame) -> DataFrame:
    """One row with the diagram: each node is declared where it is first met."""
    nodes = edges.select(F.struct("file_no", F.lit(-1).alias("dep_no"), F.lit(0).alias("part")).alias("at"), F.col("source").alias("id"), F.col("path").alias("label"))
    nodes = nodes.unionByName(edges.select(F.struct("file_no", "dep_no", F.lit(0).alias("part")).alias("at"), F.col("target").alias("id"), F.col("dependency").alias("label")))
    nodes = nodes.groupBy("id").agg(F.min(F.struct("at", "label")).alias("x"))
    declared = nodes.select("x.at", F.concat(F.lit("    "), F.col("id"), F.lit('["'), node_label(F.col("x.label")), F.lit('"]')).alias("line"))
    drawn = edges.select(F.struct("file_no", "dep_no", F.lit(1).alias("part")).alias("at"), F.concat(F.lit("    "), F.col("source"), F.lit(" --> "), F.col("target")).alias("line"))
    body = declared.unionByName(drawn).agg(joined_in_order(F.col("at"), F.col("line"), "\n").alias("body"))
    empty = F.lit('    repo["No dependency relationships detected"]')
    return body.select(F.concat(F.lit("```mermaid\ngraph TD\n"), F.coalesce(missing_if_empty(F.col("body")), empty), F.lit("\n```")).alias("diagram"))


def service_diagram(groups: DataFrame, kind: str, files: DataFrame | None = None) -> DataFrame:
    """One row with the diagram: services by name, and below each its frameworks, the first LABELLED of them. files: path, dependencies."""
    service = node_id(F.col("name"))
    line = F.concat(F.lit("    "), service, F.lit('["'), F.col("name"), F.lit("\\nAPIs: "), F.col("apis"), F.lit('"]\n    repo --> '), service)
    if files is not None:
        groups = groups.join(group_frameworks(files), "name", "left")
        label = F.array_join(F.slice("frameworks", 1, LABELLED), ", ")
        below = F.concat(F.lit("\n    "), service, F.lit('_framework["'), label, F.lit('"]\n    '), service, F.lit(" --> "), service, F.lit("_framework"))
        line = F.concat(line, F.when(F.size("frameworks") > 0, below).otherwise(""))
    body = groups.agg(joined_in_order(F.col("name"), line, "\n").alias("body"))
    return body.select(F.concat(F.lit(f'```mermaid\ngraph LR\n    repo["Architecture: {kind}"]\n'), F.col("body"), F.lit("\n```")).alias("diagram"))


def api_flow_lines(files: DataFrame) -> DataFrame:
    """file_no, api_no and line of the flow diagram, a file's node as api_no -1; repeated edges are kept. files: path, apis (name, method, route)."""
    return _flow(files).where("api_no >= 0")


def _flow(files: DataFrame) -> DataFrame:
    first = files.orderBy("path").limit(MAX_FILES).withColumn("file_no", F.row_number().over(Window.orderBy("path"))).where(F.size("apis") > 0)
    calls = first.select("file_no", "path", F.posexplode(F.slice("apis", 1, MAX_EDGES)).alias("api_no", "a"))
    name = F.coalesce(missing_if_empty(strip(F.col("a.name"))), F.lit("handler"))
    handler, file = node_id(F.concat(F.col("path"), F.lit(":"), name)), node_id(F.col("path"))
    text = F.concat(F.lit("    "), handler, F.lit('["'), route_label(F.col("a.method"), F.col("a.route")), F.lit("\\n"), name, F.lit('"]\n    client --> '), handler, F.lit("\n    "), handler, F.lit(" --> "), file)
    declared = F.concat(F.lit("    "), file, F.lit('["'), node_label(F.col("path")), F.lit('"]'))
    return calls.select("file_no", "api_no", text.alias("line")).unionByName(first.select("file_no", F.lit(-1).alias("api_no"), declared.alias("line")))


def api_flow_diagram(files: DataFrame) -> DataFrame:
    """One row with the diagram of the first files' routes."""
    body = _flow(files).agg(joined_in_order(F.struct("file_no", "api_no"), F.col("line"), "\n").alias("body"))
    nothing = F.lit('    client --> note["No API flows detected"]')
    return body.select(F.concat(F.lit('```mermaid\nflowchart TD\n    client["Client"]\n'), F.coalesce(missing_if_empty(F.col("body")), nothing), F.lit("\n```")).alias("diagram"))


def framework_labels(path: Column, dependencies: Column) -> Column:
    low = F.transform(dependencies, F.lower)
    nextjs = F.array_contains(low, "next") | F.lower(path).rlike(r"next\.config\.(ts|js)$")
    found = F.array(F.when(F.array_contains(low, "fastapi"), "FastAPI"), F.when(F.array_contains(low, "express"), "Express"), F.when(nextjs, "Next.js"))
    return F.array_sort(F.array_compact(found))


def group_frameworks(files: DataFrame) -> DataFrame:
    """name and frameworks of each top-level directory, sorted. files: path, dependencies."""
    inside = files.where(F.contains("path", F.lit("/"))).select(F.split("path", "/")[0].alias("name"), F.explode_outer(framework_labels(F.col("path"), F.col("dependencies"))).alias("f"))
    return inside.groupBy("name").agg(F.sort_array(F.collect_set("f")).alias("frameworks"))


def architecture(parsed: DataFrame, listing: DataFrame, repository: str) -> DataFrame:
    """One row: architecture_type, detected_services and the three diagrams of a parsed collection (symbols.parse_files)."""
    counted = parsed.select("path", "language", F.size("apis").alias("api_count"), F.size("dependencies").alias("dependency_count"))
    groups = service_groups(counted, listing, repository)
    kind = architecture_type(groups, counted)
    name = kind.first()["architecture_type"]
    services = groups.agg(F.sort_array(F.collect_list("name")).alias("detected_services"))
    row = kind.select("architecture_type").join(services, F.lit(True))
    diagrams = {
        "dependency_graph": dependency_diagram(dependency_edges(parsed.select("path", "dependencies"))), "service_diagram": service_diagram(groups, name, parsed.select("path", "dependencies")),
        "api_flow_diagram": api_flow_diagram(parsed.select("path", "apis")),
    }
    for column, diagram in diagrams.items():
        row = row.join(diagram.withColumnRenamed("diagram", column), F.lit(True))
    return row.select(F.lit(repository).alias("repository_name"), "*")
