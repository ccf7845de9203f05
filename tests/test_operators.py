import hashlib
import hmac
import json
import uuid

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.hashing import hmac_sha256, uuid5_url
from tessera.operators import architecture, chunking, context, events, indexing, metadata, search, symbols
from tessera.sources.tables import decode_text, read_files, read_json_lines, read_sse


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"])
    return row.select(column.alias("v")).first()["v"]


def test_uuid_and_hmac(spark):
    assert one(spark, uuid5_url(F.col("n")), n="acme/repo:a.py::module::module::1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "acme/repo:a.py::module::module::1"))
    signed = spark.createDataFrame([(bytearray(b"{}"),)], "body binary").select(hmac_sha256("key")("body").alias("v")).first()["v"]
    assert signed == hmac.new(b"key", b"{}", hashlib.sha256).hexdigest()


def test_text_functions(spark):
    assert one(spark, T.slug(F.col("n"), "chunks"), n="Acme/Repo--X") == "chunks_acme_repo_x"
    assert one(spark, T.slug(F.col("n"), "chunks"), n="//") == "chunks_repository"
    assert one(spark, T.file_type(F.col("n")), n="a.b/Make") == "b/make"
    assert [one(spark, T.suffix(F.col("n")), n=n) for n in (".env", "a/b.PY", "x", "a.tar.gz")] == ["", ".py", "", ".gz"]
    assert one(spark, T.split_lines(F.col("n")), n="a\r\nb\n\nc\n") == ["a", "b", "", "c"]
    assert one(spark, T.hard_split(F.col("n"), 2), n="abcde") == ["ab", "cd", "e"]
    assert one(spark, T.quoted_value(F.col("n")), n="x \"b\" 'a'") == "a"
    assert one(spark, T.branch_of_ref(F.col("n")), n="refs/heads/") == "main"
    assert one(spark, T.node_id(F.col("n")), n="/src/a.py/") == "n_src_a_py"
    assert one(spark, T.last_n(F.array(F.lit(1), F.lit(2), F.lit(3)), 2)) == [2, 3]


def test_split_body_fits_and_overlaps():
    lines = [f"line {i} " + "x" * 20 for i in range(82)]
    parts = chunking.split_body("\n".join(lines), 120)
    assert len(parts) > 1 and all(len(p) <= 120 for p in parts)
    assert parts[1].split("\n")[0] in parts[0]
    assert len(set(parts)) == len(parts)
    seen = "\n".join(parts).split("\n")
    assert [x for i, x in enumerate(seen) if x not in seen[:i]] == [x.strip() for x in lines]
    assert chunking.split_body("y" * 100 + "\nshort\nother", 32) == ["y" * 32, "y" * 32, "y" * 32, "y" * 4, "short\nother"]


def test_chunks_of_a_small_file(spark):
    code = "\n".join(f"line {i}" for i in range(1, 17))
    schema = """path string, language string, text string, dependencies array<string>, outline array<string>, functions array<struct<name:string,start_line:int,end_line:int>>,
    classes array<struct<name:string,methods:array<string>,start_line:int,end_line:int>>, apis array<struct<name:string,method:string,route:string>>, exports array<struct<name:string>>"""
    row = ("src/api.py", "Python", code, ["fastapi", " "], ["Imports: fastapi"], [("helper", 1, 4), ("health", 13, 16)], [("Service", ["helper"], 5, 12)], [("health", "get", "/health")], [("Service",)])
    found = chunking.chunks(spark.createDataFrame([row], schema), 900).collect()
    by_type = {r["chunk_type"]: r for r in found}
    assert set(by_type) == {"module", "class", "function", "route"}
    assert by_type["route"]["source_ref"] == "src/api.py:13-16"
    assert by_type["route"]["routes"] == ["GET /health"]
    assert by_type["module"]["dependencies"] == ["fastapi"]
    assert {r["symbol"]: r["related"] for r in found if r["chunk_type"] == "function"} == {"helper": ["Service"], "health": []}
    assert by_type["module"]["module_type"] == "route_module"
    assert all(r["text_length"] == len(r["text"]) <= 900 for r in found)


def test_chunk_parts_are_dense(spark):
    code = "\n".join(f"value_{i} = compute({i})" for i in range(82))
    schema = """path string, language string, text string, dependencies array<string>, outline array<string>, functions array<struct<name:string,start_line:int,end_line:int>>,
    classes array<struct<name:string,methods:array<string>,start_line:int,end_line:int>>, apis array<struct<name:string,method:string,route:string>>, exports array<struct<name:string>>"""
    found = chunking.chunks(spark.createDataFrame([("a.py", "Python", code, [], [], [("f", 1, 82)], [], [], [])], schema), 320).where("chunk_type = 'function'").collect()
    assert len(found) > 1 and all(r["text_length"] <= 320 for r in found)
    assert sorted(r["part_index"] for r in found) == list(range(1, len(found) + 1)) and {r["part_count"] for r in found} == {len(found)}


def test_incremental_diff_and_upkeep(spark):
    prev = spark.createDataFrame([("main.py", "old"), ("keep.py", "k"), ("removed.py", "r")], "path string, hash string")
    cur = spark.createDataFrame([("main.py", "new"), ("keep.py", "k")], "path string, hash string")
    changes = indexing.diff(cur, prev)
    assert {r["path"]: r["status"] for r in changes.collect()} == {"main.py": "changed", "removed.py": "removed", "keep.py": "unchanged"}
    assert {tuple(r) for r in indexing.merge_snapshot(prev, indexing.changed_only(cur, changes), changes).collect()} == {("keep.py", "k"), ("main.py", "new")}
    points = spark.createDataFrame([("1", "main.py"), ("2", "keep.py"), ("3", "removed.py")], "id string, path string")
    assert [r["id"] for r in indexing.delete_by_path(points, indexing.stale_paths(changes)).collect()] == ["2"]
    new = spark.createDataFrame([("2", "a", 1), ("2", "b", 2), ("4", "c", 3)], "id string, path string, n int")
    old = spark.createDataFrame([("1", "x", 0), ("2", "y", 0)], "id string, path string, n int")
    assert {tuple(r) for r in indexing.upsert(old, new, "id", "n").collect()} == {("1", "x", 0), ("2", "b", 2), ("4", "c", 3)}


def test_metadata_of_a_listing(spark):
    files = [("package.json", '{"dependencies": {"next": "1", "react": "2"}}'), ("pnpm-lock.yaml", ""), ("src/main.ts", ""), ("node_modules/ignored.js", ""), ("dist/bundle.js", "")]
    row = metadata.collection_metadata(spark.createDataFrame(files, "path string, text string")).first()
    assert row["languages"] == ["TypeScript"] and row["package_managers"] == ["pnpm"] and row["frameworks"] == ["Next.js", "React"]


def test_architecture_types_and_fallback(spark):
    schema = "path string, language string, api_count int, dependency_count int"
    files = spark.createDataFrame([("api/main.py", "Python", 1, 1), ("worker/main.py", "Python", 0, 3)], schema)
    listing = spark.createDataFrame([("api/pyproject.toml",), ("worker/requirements.txt",), ("api/main.py",), ("worker/main.py",)], "path string")
    groups = architecture.service_groups(files, listing, "repo")
    assert sorted(r["name"] for r in groups.collect()) == ["api", "worker"]
    assert architecture.architecture_type(groups, files).first()["architecture_type"] == "microservices"
    lone = spark.createDataFrame([("src/a.ts", "TypeScript", 0, 1)], schema)
    assert [r["name"] for r in architecture.service_groups(lone, lone.select("path"), "repo").collect()] == ["repo"]
    empty = spark.createDataFrame([], schema)
    assert [tuple(r) for r in architecture.service_groups(empty, empty.select("path"), "repo").collect()] == [("repo", 0, 0, 0)]
    edges = architecture.dependency_edges(spark.createDataFrame([("a.py", ["x", "y", "x"]), ("b.py", [])], "path string, dependencies array<string>"))
    text = architecture.dependency_diagram(edges).first()["diagram"]
    assert text.count("n_a_py --> n_x") == 1 and text.startswith("```mermaid\ngraph TD\n    n_a_py[")
    nothing = architecture.dependency_edges(spark.createDataFrame([("b.py", [])], "path string, dependencies array<string>"))
    assert "No dependency relationships detected" in architecture.dependency_diagram(nothing).first()["diagram"]
    calls = spark.createDataFrame([("a.py", [("h", "get", "/x"), ("h", "get", "/x")])], "path string, apis array<struct<name:string,method:string,route:string>>")
    assert architecture.api_flow_lines(calls).count() == 2
    assert one(spark, architecture.framework_labels(F.lit("next.config.ts"), F.array(F.lit("FastAPI")))) == ["FastAPI", "Next.js"]


def test_symbols_of_five_languages(spark):
    sources = [
        ("a.py", "Python", "import os, sys as s\nfrom app.db import x\n\n__all__ = ['run']\n\n@app.get('/h')\nasync def run(a):\n    pass\n\nclass A:\n    pass\n"),
        ("b.ts", "TypeScript", "import {x} from 'm'\nexport class B {}\nexport const f = (a) => 1\nrouter.post('/p', f)\nconst y = require('z')\n"),
        ("c.go", "Go", 'package x\nimport (\n"fmt"\n)\ntype T struct {}\nfunc Run() {}\nr.HandleFunc("/g", Run)\n'),
        ("d.java", "Java", 'import java.util.List;\npublic class D {\n  @PostMapping("/d")\n  public void go(String a) {}\n}\n'),
    ]
    rows = {r["path"]: r for r in symbols.extract_symbols(spark.createDataFrame(sources, "path string, language string, text string")).collect()}
    assert rows["a.py"]["dependencies"] == ["app.db", "os", "sys"] and [e["name"] for e in rows["a.py"]["exports"]] == ["run"]
    assert [(f["name"], f["start_line"], f["end_line"]) for f in rows["a.py"]["functions"]] == [("run", 7, 9)]
    assert [tuple(a) for a in rows["a.py"]["apis"]] == [("run", "GET", "/h")]
    assert rows["b.ts"]["dependencies"] == ["m", "z"] and {e["name"] for e in rows["b.ts"]["exports"]} == {"B", "f"}
    assert [tuple(a) for a in rows["b.ts"]["apis"]] == [("f", "POST", "/p")]
    assert rows["c.go"]["dependencies"] == ["fmt"] and [tuple(a) for a in rows["c.go"]["apis"]] == [("Run", "GET", "/g")]
    assert rows["d.java"]["dependencies"] == ["java.util.List"] and [tuple(a) for a in rows["d.java"]["apis"]] == [("go", "POST", "/d")]


def test_context(spark):
    turns = spark.createDataFrame([(1, 0, "user", " one "), (1, 1, "assistant", "x"), (1, 2, "user", "two"), (1, 3, "user", "three"), (1, 4, "user", "")], "conv_id long, turn long, role string, text string")
    assert [r["query"] for r in context.retrieval_queries(turns).orderBy("turn").collect()] == ["one", "one\ntwo", "one\ntwo\nthree"]
    assert context.format_history(turns, 3).first()["history"].startswith("User: one\nAssistant: x\nUser: two\nUser: thr...")
    assert context.document_queries(spark).count() == 8
    chunk = spark.createDataFrame([("k", 1, "src/app.py", "src/app.py:10-11", "Python", "function", 0.5, "  body  ")], "k string, ordinal int, path string, source_ref string, language string, chunk_type string, score double, text string")
    assert context.prompt("Repository: r", chunk, 300, "k").first()["prompt"].endswith("Chunk type: function\nScore: 0.5\nContent:\nbody\n")


def test_routing_and_jobs(spark):
    push = {"ref": "refs/heads/main", "after": "s", "repository": {"clone_url": "u", "full_name": "a/b"}, "commits": [{"added": ["README.md"], "modified": ["app/routes.py"], "removed": ["docker-compose.yml"]}]}
    head = {"action": "synchronize", "number": 3, "repository": {"clone_url": "u"}, "pull_request": {"head": {"ref": "feature-branch", "sha": "h", "repo": {"clone_url": "fork"}}}}
    rows = [("1", "push", json.dumps(push)), ("2", "pull_request", json.dumps(head)), ("3", "issues", "{}"), ("4", "pull_request", '{"action": "labeled"}'), ("5", "push", "{bad")]
    jobs = {r["job_id"]: r for r in events.route_events(spark.createDataFrame(rows, "delivery_id string, event string, payload string")).collect()}
    assert set(jobs) == {"1", "2"}
    assert jobs["1"]["doc_types"] == ["readme", "architecture", "api", "onboarding"] and jobs["1"]["branch"] == "main"
    assert jobs["2"]["doc_types"] == ["architecture", "api"] and jobs["2"]["branch"] == "feature-branch" and jobs["2"]["repository_url"] == "fork"
    body = json.dumps(push).encode()
    signed = [("sha256=" + hmac.new(b"k", body, hashlib.sha256).hexdigest(), bytearray(body)), ("sha256=0", bytearray(body))]
    assert events.verified(spark.createDataFrame(signed, "signature string, body binary"), "k").count() == 1
    assert [one(spark, events.backoff_ms(F.lit(n))) for n in (1, 2, 3)] == [5000, 10000, 20000]


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"caf\xc3\xa9 \xff x")
    files = read_files(spark, str(tmp_path / "src"))
    row = files.select("path", decode_text(F.col("content")).alias("text"), "sha256").first()
    assert (row["path"], row["text"]) == ("a.py", "café  x")
    (tmp_path / "log.ndjson").write_text('{"a": 1}\nnot json\n{"b": 2}\n')
    assert [r["a"] for r in read_json_lines(spark, str(tmp_path / "log.ndjson"), "a int, b int", "a").collect()] == [1]
    lines = spark.createDataFrame([("event: x",), ('data: {"t": "hi"}',), ("",)], "value string")
    assert [r["t"] for r in read_sse(lines, "t string").collect()] == ["hi"]


def test_search_filters_and_fusion(spark):
    points = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta"), (3, "gamma")], "id long, text string")
    q = search.sparse_entries(spark.createDataFrame([(0, "beta")], "query_id long, text string"), "query_id")
    ranked = search.best(search.sparse_scores(q, search.sparse_entries(points, "id")), 5)
    assert [(r["id"], r["score"]) for r in ranked.orderBy("rank").collect()] == [(2, 2.0), (1, 1.0)]
    assert search.filtered(points, text="gamma").count() == 1 and search.filtered(points, text="").count() == 3
    fused = search.fuse([ranked, ranked], 2).orderBy("rank").collect()
    assert [r["id"] for r in fused] == [2, 1] and fused[0]["score"] == round(2 / 61, 9)
