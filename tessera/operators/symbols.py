"""Symbols of source files in five languages, and in those that are added to the registry.

One pass over a text (operators.nesting) finds its tokens, what is comment or string, and where blocks begin and end: by braces, or by
indentation. Declarations, imports, routes and exports are found by patterns on what is left, as column expressions; they follow the
languages' grammars and the documentation of the web frameworks. Comments are found by a pattern of the whole text.

The tree is that of brackets: node_count counts its tokens, pairs and root. Root types are not given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import base_name, contains_any, non_blank, strip
from tessera.operators.metadata import is_ignored, is_parsed, language_of, sorted_set
from tessera.operators.nesting import scanned

# Items of each outline line, and characters of an export without a name.
OUTLINE_ITEMS, EXPORT_CHARS = 8, 80
# Kinds of exports, and sources of routes that have no receiver.
NAMED_EXPORT, PUBLIC_TYPE, PUBLIC_FUNCTION, PUBLIC_METHOD, LISTED = "named-export", "public-type", "public-function", "public-method", "__all__"
HANDLER_SOURCE, ANNOTATION_SOURCE = "next-route-handler", "spring-annotation"

STRINGS = "array<string>"
IMPORTS = "array<struct<module:string,names:array<string>,start_line:int>>"
APIS = "array<struct<name:string,method:string,route:string,source:string>>"
EXPORTS = "array<struct<name:string,kind:string,is_default:boolean>>"


@dataclass(frozen=True)
class Language:
    """How one language is read.

    functions, classes: patterns of a line whose last group is the name; interfaces: the same, for the classes among them that are interfaces.
    route: a pattern of the text, with the groups of receiver (0: none), method and the possible places of the route.
    positional: whether the n-th route belongs to the n-th function.
    Hooks, for languages that are added: find_imports and find_exports take the text and its lines, without comments, and give arrays like IMPORTS and EXPORTS
    (find_exports also takes functions and classes); extra_imports adds to the imports of a language that has its own; find_routes gives an array of
    method, route, source and fallback (the name of a route that no function handles). Without a hook, an added language has no imports and no exports.
    """

    suffixes: tuple[str, ...]
    functions: tuple[str, ...]
    classes: tuple[str, ...]
    interfaces: tuple[str, ...] = ()
    route: str = ""
    receiver: int = 1
    method: int = 2
    places: tuple[int, ...] = (3,)
    positional: bool = False
    indented: bool = False
    comments: str = r"(?s)/\*.*?\*/|(?<![:\w\"'`/])//[^\n]*"
    exports: str = ""
    find_imports: Callable[[Column, Column], Column] | None = None
    extra_imports: Callable[[Column, Column], Column] | None = None
    find_exports: Callable[[Column, Column, Column, Column], Column] | None = None
    find_routes: Callable[[Column, Column], Column] | None = None


_VERBS = "get|post|put|patch|delete|options|head"
_NOT_A_NAME = r"(?!(?:if|for|while|switch|catch|return|new|else|do|throw|function|await|typeof|super|synchronized)\b)"
_SCRIPT = {
    "functions": (
        r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*([A-Za-z_$][\w$]*)",
        r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>",
        rf"^\s+(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*\*?{_NOT_A_NAME}([A-Za-z_$#][\w$]*)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^;{{]+)?(?:\{{.*)?$",
    ),
    "classes": (r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", r"^\s*(?:export\s+)?(?:declare\s+)?interface\s+([A-Za-z_$][\w$]*)"),
    "interfaces": (r"^\s*(?:export\s+)?(?:declare\s+)?interface\s+([A-Za-z_$][\w$]*)",),
    "route": rf"(?i)\b(app|router)\s*\.\s*({_VERBS})\s*\(\s*(?:\"([^\"']+)\"|'([^\"']+)')",
    "places": (3, 4),
}

#: The registry: a language's name and how it is read. Others can be added by passing a larger one.
REGISTRY: dict[str, Language] = {
    "Python": Language(
        (".py",),
        (r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)",),
        (r"^[ \t]*class[ \t]+(\w+)",),
        route=rf"(?i)@\s*([A-Za-z_][\w.]*)\.({_VERBS})\s*\(\s*[rbuf]{{0,2}}(?:\"([^\"']+)\"|'([^\"']+)')",
        places=(3, 4),
        positional=True,
        indented=True,
        comments=r"(?m)(?:(?<=\s)|^)#[^\n]*",
    ),
    "TypeScript": Language((".ts", ".tsx"), **_SCRIPT, exports="export_statement"),
    "JavaScript": Language((".js", ".jsx", ".mjs", ".cjs"), **_SCRIPT, exports="export"),
    "Go": Language(
        (".go",),
        (r"^func\s+(?:\([^)]*\)\s*)?(\w+)",),
        (r"^type\s+(\w+)\s+\w", r"^\t(\w+)\s+(?:struct|interface)\b"),
        route=r"(?i)\b(router|engine|http|r)\s*\.\s*(get|post|put|patch|delete|handlefunc)\s*\(\s*\"([^\"\n]+)\"",
    ),
    "Java": Language(
        (".java",),
        (
            rf"^\s*(?:@\w+\s+)*(?:(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)+(?:<[^>]*>\s*)?(?:[\w.]+(?:<[^()]*>)?(?:\[\])*\s+)?{_NOT_A_NAME}(\w+)\s*\(",
            rf"^\s+{_NOT_A_NAME}[A-Za-z_][\w.]*(?:<[^()]*>)?(?:\[\])*\s+{_NOT_A_NAME}(\w+)\s*\([^;=]*\)\s*(?:throws\s+[\w., ]+)?\s*(?:\{{.*|;\s*)$",
        ),
        (r"^\s*(?:@\w+\s+)*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(?:class|interface)\s+(\w+)",),
        (r"^\s*(?:@\w+\s+)*(?:(?:public|protected|private|static|abstract|sealed)\s+)*interface\s+(\w+)",),
        route=r"@(Get|Post|Put|Patch|Delete|Request)Mapping\s*\(([^)]*)\)",
        receiver=0,
        method=1,
        places=(2,),
        positional=True,
    ),
}


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _joined(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.concat(*(_all(text, p) for p in patterns)) if patterns else F.array().cast(STRINGS)


def first_by(items: Column, key) -> Column:
    """items without those whose key an earlier one has."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def _declared(pieces: Column, patterns: tuple[str, ...]) -> Column:
    """The first declaration of each piece that has one, with the piece: name, start_line, line (the piece's text), at, opens and ends."""
    made = F.transform(
        pieces,
        lambda p, i: F.struct(F.get(_joined(p["text"], patterns), F.lit(0)).alias("name"), p["line"].alias("start_line"), p["text"].alias("line"), i.alias("at"), p["opens"].alias("opens"), p["ends"].alias("ends")),
    )
    return F.filter(made, lambda x: x["name"].isNotNull())


def _by_name(items: Column) -> Column:
    """items without those whose name an earlier one has."""
    return first_by(items, lambda x: x["name"])


def _split_arguments(listed: Column) -> Column:
    """The parts between commas that are in no bracket."""
    return non_blank(F.split(listed, r",(?![^(\[{<]*[)\]}>])", -1))


def _after_as(names: Column) -> Column:
    return F.transform(names, lambda n: F.regexp_replace(n, r"\s+as\s+\S+\s*$", ""))


def _imports(language: str, own: Language, text: Column, lines: Column) -> Column:
    """module, names and start_line of each import, in order; of equal ones the first."""
    if own.find_imports or language not in REGISTRY:
        found = own.find_imports(text, lines).cast(IMPORTS) if own.find_imports else F.array().cast(IMPORTS)
        return first_by(F.filter(found, lambda x: x["module"] != ""), lambda x: F.struct(x["module"], x["names"]))

    def of_lines(make, wanted: str) -> Column:
        numbered = F.filter(F.transform(lines, lambda line, i: F.struct(line.alias("line"), (i + 1).alias("n"))), lambda x: x["line"].rlike(wanted))
        return F.flatten(F.transform(numbered, lambda x: make(x["line"], x["n"])))

    def one(module: Column, names: Column, n: Column) -> Column:
        return F.struct(strip(module).alias("module"), names.cast(STRINGS).alias("names"), n.cast("int").alias("start_line"))

    none = F.array().cast(STRINGS)
    if language == "Python":
        source = r"^\s*from\s+([\w.]+)\s+import\b\s*\(?([^#)]*)"
        plain = lambda line: non_blank(_after_as(F.split(F.regexp_extract(line, r"^\s*import\s+([\w., \t]+)", 1), ",", -1)))
        found = of_lines(
            lambda line, n: F.when(line.rlike(source), F.array(one(F.regexp_extract(line, source, 1), _after_as(non_blank(F.split(F.regexp_extract(line, source, 2), ",", -1))), n))).otherwise(
                F.transform(plain(line), lambda m: one(m, none, n))
            ),
            r"^\s*(?:from\s+[\w.]+\s+import\b|import\s+\w)",
        )
    elif language in ("TypeScript", "JavaScript"):
        clause, quoted = r"^\s*(?:import|\}\s*from)\b([^'\"]*)", r"^[^'\"]*(?:\"([^\"]+)\"|'([^']+)')"
        words = lambda line: F.filter(F.array_distinct(_all(F.regexp_extract(line, clause, 1), r"([A-Za-z_$][\w$]*)")), lambda w: ~w.isin("as", "from", "type"))
        module = lambda line: F.concat(F.regexp_extract(line, quoted, 1), F.regexp_extract(line, quoted, 2))
        found = of_lines(lambda line, n: F.array(one(module(line), words(line), n)), r"^\s*(?:import\b|\}\s*from\b)[^'\"]*['\"]")
        required = r"\brequire\s*\(\s*(?:\"([^\"\n]+)\"|'([^'\n]+)')\s*\)"
        more = F.zip_with(_all(text, required, 1), _all(text, required, 2), lambda a, b: one(F.concat(a, b), none, F.lit(None)))
        found = F.concat(found, more)
    elif language == "Go":
        inside = F.regexp_replace(F.regexp_replace(text, r"(?s)^.*?\bimport\s*\(", ""), r"(?s)\).*$", "")
        block = F.when(text.rlike(r"\bimport\s*\("), _all(inside, r"\"([^\"\n]+)\"")).otherwise(none)
        single = _all(text, r"(?m)^import\s+(?:[\w.]+\s+)?\"([^\"\n]+)\"")
        found = F.transform(F.concat(single, block), lambda m: one(m, none, F.lit(None)))
    else:
        pattern = r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"
        found = of_lines(lambda line, n: F.array(one(F.regexp_extract(line, pattern, 1), F.array(F.substring_index(F.regexp_extract(line, pattern, 1), ".", -1)), n)), pattern)
    if own.extra_imports:
        found = F.concat(found.cast(IMPORTS), own.extra_imports(text, lines).cast(IMPORTS))
    return first_by(F.filter(found, lambda x: x["module"] != ""), lambda x: F.struct(x["module"], x["names"])).cast(IMPORTS)


def _routes(language: Language, text: Column, lines: Column) -> Column:
    """method, route and source of each route, in order."""
    if language.find_routes:
        return language.find_routes(text, lines)
    if not language.route:
        return F.array()
    found = [_all(text, language.route, g) for g in (language.method, *language.places)]
    places = F.arrays_zip(*(x.alias(f"c{i}") for i, x in enumerate(found)), (_all(text, language.route, language.receiver) if language.receiver else found[0]).alias("source"))

    def one(x: Column) -> Column:
        method = F.upper(x["c0"])
        if language.receiver:
            route = F.concat(*(x[f"c{i + 1}"] for i in range(len(language.places))))
            return F.struct(F.when(method == "HANDLEFUNC", "GET").otherwise(method).alias("method"), route.alias("route"), x["source"].alias("source"), x["source"].alias("fallback"))
        arguments = x["c1"]
        asked = F.upper(F.regexp_extract(arguments, r"RequestMethod\s*\.\s*([A-Za-z]+)", 1))
        route = F.regexp_extract(arguments, r"[\"'](/[^\"']*)[\"']", 1)
        method = F.when(method != "REQUEST", method).when(asked != "", asked).otherwise("GET")
        return F.struct(method.alias("method"), F.when(route != "", route).otherwise("/").alias("route"), F.lit(ANNOTATION_SOURCE).alias("source"), F.concat(x["c0"], F.lit("Mapping")).alias("fallback"))

    return F.transform(places, one)


def _exports(name: str, language: Language, text: Column, lines: Column) -> Column:
    def listed(names: Column, kind: str, default: Column | None = None) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind"), (F.lit(False) if default is None else default).alias("is_default"))).cast(EXPORTS)

    functions, classes = F.col("functions"), F.col("classes")
    if language.find_exports or name not in REGISTRY:
        return language.find_exports(text, lines, functions, classes) if language.find_exports else F.array().cast(EXPORTS)
    names = lambda items: F.transform(items, lambda x: x["name"])
    if name == "Python":
        values = F.split(F.regexp_extract(text, r"__all__\s*=\s*[\[(]([^\])]*)[\])]", 1), ",", -1)
        return listed(non_blank(F.transform(values, lambda v: F.regexp_replace(v, r"^[\s'\"]+|[\s'\"]+$", ""))), LISTED)
    if name == "Go":
        capital = lambda items: F.filter(names(items), lambda n: n.rlike(r"^\p{Lu}"))
        return F.concat(listed(capital(functions), PUBLIC_FUNCTION), listed(capital(classes), PUBLIC_TYPE))
    if name == "Java":
        types = F.when(contains_any(text, ("public class", "public interface")), names(classes)).otherwise(F.array().cast(STRINGS))
        public = names(F.filter(functions, lambda f: f["line"].rlike(r"\bpublic\b")))
        return F.concat(listed(types, PUBLIC_TYPE), listed(public, PUBLIC_METHOD))
    declared = r"^\s*export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\b\s*\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)"
    statements = F.filter(lines, lambda line: line.rlike(r"^\s*export\b"))

    def of(line: Column) -> Column:
        own, braced = F.regexp_extract(line, declared, 1), F.regexp_extract(line, r"^\s*export\s+(?:type\s+)?\{([^}]*)", 1)
        other = F.regexp_extract(line, r"^\s*export\s+default\s+([A-Za-z_$][\w$]*)\s*;?\s*$", 1)
        default = line.rlike(r"\bdefault\b")
        many = F.transform(non_blank(F.split(braced, ",", -1)), lambda n: F.regexp_extract(n, r"([A-Za-z_$][\w$]*)\s*$", 1))
        alone = F.when(own != "", own).when(other != "", other).when(default, "default").otherwise(F.substring(strip(line), 1, EXPORT_CHARS))
        return listed(F.when(braced != "", many).otherwise(F.array(alone)), language.exports, default)

    found = F.flatten(F.transform(statements, of))
    if name == "TypeScript":
        found = F.concat(found, listed(F.filter(names(functions), lambda n: (F.upper(n) == n) & (F.lower(n) != n)), NAMED_EXPORT))
    return found


def _comments(pattern: str, text: Column) -> Column:
    """text, kind and lines of each comment: the text between comments says on which line the next one begins."""
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    pairs = F.arrays_zip(_all(text, pattern, 0).alias("c"), F.split(text, pattern, -1).alias("before"))
    empty = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<text:string,kind:string,start_line:int,end_line:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["line"] + newlines(x["before"])
        kind = F.when(x["c"].startswith("/*"), "block_comment").otherwise("line_comment")
        one = F.struct(strip(x["c"]).alias("text"), kind.alias("kind"), start.alias("start_line"), (start + newlines(x["c"])).alias("end_line"))
        return F.struct((start + newlines(x["c"])).alias("line"), F.array_append(acc["out"], one).alias("out"))

    return F.aggregate(F.filter(pairs, lambda x: x["c"].isNotNull()), empty, step)["out"]


def _described(x: Column, lines: Column, indented: bool) -> Column:
    """A function: its signature, the text before its block, and what that says."""
    whole = F.array_join(F.slice(lines, x["start_line"], F.greatest(x["end_line"] - x["start_line"] + 1, F.lit(1))), "\n")
    code = F.when(whole.startswith(x["line"]), whole).otherwise(x["line"])  # a declaration behind another one on its line has its piece alone
    head = F.regexp_extract(code, r"(?s)^(.*?\)[^:\n]*):", 1) if indented else F.regexp_replace(F.substring_index(code, "{", 1), r"\s*(?:=>)?\s*;?\s*$", "")
    signature = strip(F.when(head == "", x["line"]).otherwise(head))
    parameters = F.regexp_extract(signature, r"(?s)^(?:func\s*\([^)]*\)\s*)?[^(]*\(((?:[^()]|\([^()]*\))*)\)", 1)
    return F.struct(
        x["name"].alias("name"), signature.alias("signature"), signature.rlike(r"(?:^|[\s=])async\b").alias("is_async"), _split_arguments(parameters).alias("parameters"),
        x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), x["line"].alias("line"), x["at"].alias("at"),
    )


def _bases(line: Column) -> Column:
    """Names that a class is derived from, in the notations of Python and of the others."""
    called = F.regexp_extract(line, r"^\s*class\s+\w+\s*\(([^)]*)\)", 1)
    worded = F.regexp_extract_all(line, F.lit(r"\b(?:extends|implements)\s+([\w$.<>, ]+?)(?=\s+implements\b|\s*\{|\s*$)"), F.lit(1))
    return F.concat(_split_arguments(called), F.flatten(F.transform(worded, _split_arguments)))


def _by_language(language: Column, registry: dict[str, Language], make, kind: str) -> Column:
    out = None
    for name, own in registry.items():
        made = make(name, own).cast(kind)
        out = F.when(language == name, made) if out is None else out.when(language == name, made)
    return F.coalesce(out, F.array().cast(kind))


DECLARED = "array<struct<name:string,start_line:int,line:string,at:int,opens:int,ends:int>>"
FUNCTIONS = "array<struct<name:string,signature:string,is_async:boolean,parameters:array<string>,start_line:int,end_line:int,line:string,at:int>>"


def extract_symbols(files: DataFrame, registry: dict[str, Language] = REGISTRY) -> DataFrame:
    """files (path, language, text) with imports, exports, functions, classes, apis, comments, dependencies, outline and node_count.

    api_references are the apis with what they were called on. The result is what chunking.chunks takes. Functions and classes of one name are listed once, the first;
    each class has all its methods, whatever others are called. Null texts count as empty; files of other languages have empty lists.
    """
    language = F.col("language")
    indented = language.isin(*[name for name, p in registry.items() if p.indented])
    rows = scanned(files, "_scan", indented).withColumn("_text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"_lines": F.col("_scan.lines"), "_pieces": F.col("_scan.pieces"), "_bare": F.array_join("_scan.lines", "\n")})
    text, lines, pieces = F.col("_bare"), F.col("_lines"), F.col("_pieces")

    def by(make, kind):
        return _by_language(language, registry, make, kind)

    rows = rows.withColumns({
        "_functions": by(lambda _, p: _declared(pieces, p.functions), DECLARED),
        "_classes": by(lambda _, p: _declared(pieces, p.classes), DECLARED),
        "_interfaces": by(lambda _, p: F.flatten(F.transform(lines, lambda line: _joined(line, p.interfaces))), STRINGS),
        "_routes": by(lambda _, p: _routes(p, text, lines), "array<struct<method:string,route:string,source:string,fallback:string>>"),
        "imports": by(lambda n, p: _imports(n, p, text, lines), IMPORTS),
        "comments": by(lambda _, p: _comments(p.comments, F.col("_text")), "array<struct<text:string,kind:string,start_line:int,end_line:int>>"),
        "node_count": F.col("_scan.nodes"),
    })
    rows = rows.withColumn("_places", F.array_sort(F.array_distinct(F.transform(F.concat("_functions", "_classes"), lambda x: x["at"]))))

    def ended(x: Column) -> Column:
        """A block ends where it closes, unless another declaration begins before it opens."""
        following = F.get("_places", F.array_position(F.col("_places"), x["at"]).cast("int"))
        own = (x["opens"] >= 0) & (following.isNull() | (following > x["opens"]))
        return x.withField("end_line", F.when(own, F.greatest("_one", x["ends"], x["start_line"])).otherwise(x["start_line"]))

    rows = rows.withColumn("_one", F.lit(1)).withColumns({c: F.transform(c, ended) for c in ("_functions", "_classes")})
    described = F.when(indented, F.transform("_functions", lambda x: _described(x, lines, True))).otherwise(F.transform("_functions", lambda x: _described(x, lines, False)))
    rows = rows.withColumn("_described", described.cast(FUNCTIONS)).withColumn("functions", _by_name(F.col("_described")))

    def of_class(x: Column) -> Column:
        inside = F.filter("_described", lambda f: (f["at"] > x["at"]) & (f["end_line"] <= x["end_line"]))
        received = F.filter("_described", lambda f: F.regexp_extract(f["line"], r"^func\s*\(\s*\w*\s*\*?\s*(\w+)", 1) == x["name"])
        methods = F.transform(F.when(language == "Go", received).otherwise(inside), lambda f: f["name"])
        kind = F.when(F.array_contains("_interfaces", x["name"]) | x["line"].rlike(r"^(?:type\s+|\t)\w+\s+interface\b"), "interface").otherwise("class")
        return F.struct(x["name"].alias("name"), kind.alias("kind"), _bases(x["line"]).alias("bases"), methods.alias("methods"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"))

    rows = rows.withColumn("classes", F.transform(_by_name(F.col("_classes")), of_class))
    names = F.transform("functions", lambda f: f["name"])
    positional = language.isin(*(k for k, p in registry.items() if p.positional))
    # By position where routes precede their handlers; otherwise one name stands for the file: the least.
    handler = lambda i: F.when(positional, F.get(names, i)).otherwise(F.array_min(names))
    apis = F.transform("_routes", lambda r, i: F.struct(F.coalesce(handler(i), r["fallback"]).alias("name"), r["method"].alias("method"), r["route"].alias("route"), r["source"].alias("source")))
    exported = r"(?m)^\s*export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE)\b"
    handlers = F.transform(_all(text, exported), lambda m: F.struct(m.alias("name"), m.alias("method"), F.lit("/").alias("route"), F.lit(HANDLER_SOURCE).alias("source")))
    rows = rows.withColumn("api_references", F.concat(apis, F.when(language == "TypeScript", handlers).otherwise(F.array().cast(APIS))).cast(APIS))
    rows = rows.withColumn("apis", F.transform("api_references", lambda a: a.dropFields("source")))
    rows = rows.withColumn("exports", first_by(by(lambda name, p: _exports(name, p, text, lines), EXPORTS), lambda x: x))
    rows = rows.withColumn("functions", F.transform("functions", lambda f: f.dropFields("line", "at")))
    modules = F.transform("imports", lambda x: x["module"])
    rows = rows.withColumns({"dependencies": F.array_sort(F.array_distinct(modules)), "outline": outline(modules)})
    return rows.drop("_scan", "_text", "_lines", "_pieces", "_bare", "_functions", "_classes", "_interfaces", "_routes", "_places", "_one", "_described")


def outline(modules: Column) -> Column:
    """Lines that describe a file: its name, and the first of each kind of symbol."""

    def line(label: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(label + ": "), F.array_join(F.slice(items, 1, OUTLINE_ITEMS), ", ")))

    name = F.concat(F.lit("File: "), base_name(F.col("path")), F.lit(" ["), F.col("language"), F.lit("]"))
    names = lambda c: F.transform(c, lambda x: x["name"])
    routes = F.transform("apis", lambda a: F.concat_ws(" ", a["method"], a["route"]))
    return F.array_compact(F.array(name, line("Imports", modules), line("Functions", names("functions")), line("Classes", names("classes")), line("APIs", routes)))


def parse_files(files: DataFrame, registry: dict[str, Language] = REGISTRY) -> DataFrame:
    """Symbols of the files (path, text) that are read at all: not ignored, and of a language of the registry."""
    suffixes = [s for p in registry.values() for s in p.suffixes]
    by_suffix = {s: name for name, p in registry.items() for s in p.suffixes}
    known = F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1))
    own = F.create_map(*(F.lit(x) for item in by_suffix.items() for x in item))
    kept = files.where(~is_ignored(F.col("path")) & (is_parsed(F.col("path")) | known.isin(*suffixes)))
    return extract_symbols(kept.withColumn("language", F.coalesce(F.try_element_at(own, known), language_of(F.col("path")))), registry)


#: Counters of a parsed collection, and the lists that they count.
COUNTED = {"function_count": "functions", "class_count": "classes", "import_count": "imports", "export_count": "exports", "api_count": "apis", "comment_count": "comments"}


def parsed_summary(parsed: DataFrame) -> DataFrame:
    """One row: number of files, sums of list sizes, and languages."""
    sums = [F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0))), F.lit(0)).cast("long").alias(n) for n, c in COUNTED.items()]
    return parsed.agg(F.count("*").alias("file_count"), F.count("*").alias("file_count_estimate"), *sums, sorted_set(F.nullif(F.col("language"), F.lit(""))).alias("languages"))


def record_json(parsed: DataFrame) -> DataFrame:
    """path and record: a parsed file as JSON, without fields that are null."""
    fields = ["path", "language", "imports", "exports", "functions", "classes", "api_references", "comments", "dependencies", "outline"]
    return parsed.select("path", F.to_json(F.struct(*fields)).alias("record"))
