"""Symbols of small sources in each language, and chunks made of them."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, symbols

PYTHON = '''import os, sys as s
from app.db import x as y, z

__all__ = ["run", 'A']


@app.get("/h")
async def run(a: int, b: dict[str, int] = {}) -> int:
    # first
    if a:

        return 1
    return {"b": 2}


class A(Base, Mixin):
    def one(self):
        return (
1)

    @router.post('/two')
    def two(self): return 2
x = 1
'''
TYPESCRIPT = """import def, {a, b as c} from 'm'
import type {T} from "types"
import {
  long,
} from './long'
/* a block
   comment */
export default class B extends Base implements I, J {
  constructor(private x: number) {
    super()
  }
  async load(id: string): Promise<void> {
    if (id) { return }
  } // end
}
export interface I { x: number }
export const f = (a, b) => {
  return "{" // brace
}
export async function GET(req) {
}
const y = require('z')
router.post('/p', f)
app.get("/q", f)
export { f as g, y }
export * from './all'
export default f
"""
GO = """package x

import (
\t"fmt"
\tm "net/http"
)

// T is one
type T struct {
\tn int
}

type R interface {
\tRead() int
}

func (t *T) Read(a int, b string) int {
\treturn 1
}

func run() {
}

func main() { r.HandleFunc("/g", run); router.POST("/p", run) }
"""
JAVA = """package a;
import java.util.List;
import static java.util.Map.*;

@RequestMapping(value = "/api", method = RequestMethod.POST)
public class D extends Base implements Runnable, Closeable {
  public D(int a) { }
  @GetMapping()
  public List<String> all(int page, String q) throws X {
    return null;
  }
  @PostMapping("/d")
  private static void go(String a) {
  }
  int size() { return 0; }
}

interface E {
  void f();
}
"""


@pytest.fixture(scope="module")
def parsed(spark):
    sources = [("a.py", PYTHON), ("src/b.ts", TYPESCRIPT), ("c.go", GO), ("d.java", JAVA), ("node_modules/x.js", "f()"), ("e.md", "# x"), ("f.py", None), ("g.js", "export default () => 1\n")]
    files = spark.createDataFrame(sources, "path string, text string")
    return symbols.parse_files(files).cache()


@pytest.fixture(scope="module")
def rows(parsed):
    return {r["path"]: r for r in parsed.collect()}


def names(row, what):
    return [x["name"] for x in row[what]]


def places(row, what):
    return {x["name"]: (x["start_line"], x["end_line"]) for x in row[what]}


def test_only_files_that_are_read(rows):
    assert set(rows) == {"a.py", "src/b.ts", "c.go", "d.java", "f.py", "g.js"}
    assert all(rows["f.py"][c] == [] for c in ("imports", "exports", "functions", "classes", "apis", "comments", "dependencies"))


def test_python(rows):
    r = rows["a.py"]
    assert [(i["module"], i["names"]) for i in r["imports"]] == [("os", []), ("sys", []), ("app.db", ["x", "z"])] and r["dependencies"] == ["app.db", "os", "sys"]
    assert places(r, "functions") == {"run": (8, 15), "one": (17, 20), "two": (22, 22)} and places(r, "classes") == {"A": (16, 22)}
    run = r["functions"][0]
    assert run["is_async"] and run["parameters"] == ["a: int", "b: dict[str, int] = {}"] and run["signature"] == "async def run(a: int, b: dict[str, int] = {}) -> int"
    assert r["classes"][0]["methods"] == ["one", "two"] and r["classes"][0]["bases"] == ["Base", "Mixin"] and r["classes"][0]["kind"] == "class"
    assert [tuple(a) for a in r["api_references"]] == [("run", "GET", "/h", "app"), ("one", "POST", "/two", "router")]
    assert [tuple(e) for e in r["exports"]] == [("run", "__all__", False), ("A", "__all__", False)]
    assert [tuple(c) for c in r["comments"]] == [("# first", "line_comment", 9, 9)]
    assert r["outline"] == ["File: a.py [Python]", "Imports: os, sys, app.db", "Functions: run, one, two", "Classes: A", "APIs: GET /h, POST /two"]


def test_typescript(rows):
    r = rows["src/b.ts"]
    assert [(i["module"], i["names"]) for i in r["imports"]] == [("m", ["def", "a", "b", "c"]), ("types", ["T"]), ("./long", ["long"]), ("z", [])]
    assert places(r, "classes") == {"B": (8, 15), "I": (16, 16)} and [c["kind"] for c in r["classes"]] == ["class", "interface"]
    assert r["classes"][0]["methods"] == ["constructor", "load"] and r["classes"][0]["bases"] == ["Base", "I", "J"]
    assert places(r, "functions") == {"constructor": (9, 11), "load": (12, 14), "f": (17, 19), "GET": (20, 21)}
    assert {f["name"]: f["is_async"] for f in r["functions"]} == {"constructor": False, "load": True, "f": False, "GET": True}
    assert {f["name"]: f["parameters"] for f in r["functions"]}["f"] == ["a", "b"]
    assert [tuple(a) for a in r["api_references"]] == [("GET", "POST", "/p", "router"), ("GET", "GET", "/q", "app"), ("GET", "GET", "/", "next-route-handler")]
    assert [(e["name"], e["is_default"]) for e in r["exports"]] == [("B", True), ("I", False), ("f", False), ("GET", False), ("g", False), ("y", False), ("export * from './all'", False), ("f", True), ("GET", False)]
    assert [(c["kind"], c["start_line"], c["end_line"]) for c in r["comments"]] == [("block_comment", 6, 7), ("line_comment", 14, 14), ("line_comment", 18, 18)]
    assert [tuple(e) for e in rows["g.js"]["exports"]] == [("default", "export", True)]


def test_go(rows):
    r = rows["c.go"]
    assert r["dependencies"] == ["fmt", "net/http"] and places(r, "functions") == {"Read": (17, 19), "run": (21, 22), "main": (24, 24)}
    assert [(c["name"], c["kind"], c["methods"]) for c in r["classes"]] == [("T", "class", ["Read"]), ("R", "interface", [])]
    assert [(a["method"], a["route"], a["source"]) for a in r["api_references"]] == [("GET", "/g", "r"), ("POST", "/p", "router")]
    assert [tuple(e)[:2] for e in r["exports"]] == [("Read", "public-function"), ("T", "public-type"), ("R", "public-type")]
    assert r["functions"][0]["parameters"] == ["a int", "b string"]


def test_java(rows):
    r = rows["d.java"]
    assert r["dependencies"] == ["java.util.List", "java.util.Map.*"]
    assert places(r, "functions") == {"D": (7, 7), "all": (9, 11), "go": (13, 14), "size": (15, 15), "f": (19, 19)}
    assert [(c["name"], c["kind"], c["methods"], c["bases"]) for c in r["classes"]] == [("D", "class", ["D", "all", "go", "size"], ["Base", "Runnable", "Closeable"]), ("E", "interface", ["f"], [])]
    assert [tuple(a) for a in r["api_references"]] == [("D", "POST", "/api", "spring-annotation"), ("all", "GET", "/", "spring-annotation"), ("go", "POST", "/d", "spring-annotation")]
    assert [tuple(e)[:2] for e in r["exports"]] == [("D", "public-type"), ("E", "public-type"), ("D", "public-method"), ("all", "public-method")]


def test_summary_and_records(parsed):
    row = symbols.parsed_summary(parsed).first()
    assert (row["file_count"], row["function_count"], row["class_count"], row["api_count"]) == (6, 15, 7, 10) and row["languages"] == ["Go", "Java", "JavaScript", "Python", "TypeScript"]
    record = json.loads({r["path"]: r["record"] for r in symbols.record_json(parsed).collect()}["c.go"])
    assert record["language"] == "Go" and "start_line" not in record["imports"][0]
    assert symbols.parsed_summary(parsed.limit(0)).first()["function_count"] == 0


def test_chunks_take_extracted_symbols(parsed):
    found = chunking.chunks(parsed).collect()
    kinds = {}
    for r in found:
        kinds.setdefault(r["chunk_type"], []).append(r["symbol"])
    assert set(kinds) == {"module", "class", "function", "route"} and kinds["class"].count("A") == 1
    related = {r["symbol"]: r["related"] for r in found if r["chunk_type"] == "function" and r["path"] == "a.py"}
    assert related == {"run": [], "one": ["A"], "two": ["A"]}


PROBES = {
    "one.ts": """/*
function commented() {
}
*/
class A { get(x: {a: number}) { return "}" }
  put() {
  }
}
class B {
  get() {
    return `
function quoted() {
}`
  }
}
""",
    "two.py": """from os import (
    path,  # a comment
    sep as s,
)
'''
def quoted():
    pass
'''
class A:
    def get(self): return 1

class B:
    def get(self):
        return (1,
2)
    def put(self):
        pass
""",
    "three.java": """import a.B;
class A { int get() { return 1; } }
class B {
  int get() { return "{".length(); }
  /* int hidden() { */
  abstract int later(int a,
    int b);
}
""",
    "four.go": "package x\n\ntype A struct {\n}\n\ntype B struct {\n}\n\nfunc (a A) Get() {\n}\n\nfunc (b *B) Get() {\n}\n",
}


def test_scopes_of_comments_strings_and_repeated_names(spark):
    found = {r["path"]: r for r in symbols.parse_files(spark.createDataFrame(list(PROBES.items()), "path string, text string")).collect()}
    methods = {p: {c["name"]: c["methods"] for c in r["classes"]} for p, r in found.items()}
    assert methods == {"one.ts": {"A": ["get", "put"], "B": ["get"]}, "two.py": {"A": ["get"], "B": ["get", "put"]}, "three.java": {"A": ["get"], "B": ["get", "later"]}, "four.go": {"A": ["Get"], "B": ["Get"]}}
    assert places(found["one.ts"], "functions") == {"get": (5, 5), "put": (6, 7)} and places(found["one.ts"], "classes") == {"A": (5, 8), "B": (9, 15)}
    assert places(found["two.py"], "classes") == {"A": (9, 11), "B": (12, 17)} and [(i["module"], i["names"], i["start_line"]) for i in found["two.py"]["imports"]] == [("os", ["path", "sep"], 1)]
    assert places(found["three.java"], "functions") == {"get": (2, 2), "later": (6, 7)}
    assert {f["name"]: f["signature"] for f in found["one.ts"]["functions"]}["put"] == "put()"
    assert [c["kind"] for c in found["one.ts"]["comments"]] == ["block_comment"]


def test_node_counts_and_token_tables(spark):
    from tessera.operators import nesting

    sources = {"a.ts": "f(a, [1]) // c\n", "b.py": "x = {'k': (1, 2)} # (\n", "c.ts": "", "d.ts": ") }"}
    rows = spark.createDataFrame(list(sources.items()), "path string, text string")
    found = {r["path"]: r["node_count"] for r in symbols.parse_files(rows).collect()}
    # f ( a , [ 1 ] ) //c: a leaf each, pairs once, and the root; closing brackets that close nothing are none.
    assert found == {"a.ts": 8, "b.py": 11, "c.ts": 1, "d.ts": 1}
    table = nesting.token_table(rows, F.col("path").endswith(".py")).where("path = 'a.ts'").orderBy("at").collect()
    assert [(r["kind"], r["token"], r["depth"], r["parent"]) for r in table] == [
        ("word", "f", 0, None), ("open", "(", 0, None), ("word", "a", 1, 1), ("mark", ",", 1, 1), ("open", "[", 1, 1), ("word", "1", 2, 4), ("close", "]", 1, 1), ("close", ")", 0, None), ("comment", "// c", 0, None),
    ]


def test_added_languages_have_hooks(spark):
    def names(text, kind):
        return F.transform(F.regexp_extract_all(text, F.lit(kind), F.lit(1)), lambda n: F.struct(n.alias("module"), F.array().cast("array<string>").alias("names"), F.lit(None).cast("int").alias("start_line")))

    def exports(text, lines, functions, classes):
        return F.transform(functions, lambda f: F.struct(f["name"].alias("name"), F.lit("fn").alias("kind"), F.lit(False).alias("is_default")))

    plain = symbols.Language((".rs",), (r"^\s*(?:pub\s+)?fn\s+(\w+)",), ())
    hooked = symbols.Language((".rs",), (r"^\s*(?:pub\s+)?fn\s+(\w+)",), (), find_imports=lambda text, lines: names(text, r"(?m)^use\s+([\w:]+)"), find_exports=exports)
    rows = spark.createDataFrame([("a.rs", "use std::io;\nexport fn no() {}\nfn run() {\n}\n// fn hidden() {}\n")], "path string, text string")
    bare = symbols.parse_files(rows, symbols.REGISTRY | {"Rust": plain}).first()
    assert bare["imports"] == [] and bare["exports"] == [] and names_of(bare) == ["run"]
    full = symbols.parse_files(rows, symbols.REGISTRY | {"Rust": hooked}).first()
    assert [i["module"] for i in full["imports"]] == ["std::io"] and [tuple(e) for e in full["exports"]] == [("run", "fn", False)]


def names_of(row):
    return [f["name"] for f in row["functions"]]


def test_hostile_texts_take_linear_time():
    import time

    from tessera.operators.nesting import scan

    for text in ("{" * 200_000, '"' * 100_001, "/*" * 100_000, "`a{" * 60_000, "'''" * 99_999, "(\n" * 100_000, "import {\n" * 50_000, "{;" * 90_000, "class A { f() {\n" * 4000):
        for indented in (True, False):
            began = time.process_time()
            scan(text, indented)
            assert time.process_time() - began < 10
