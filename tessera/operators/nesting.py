"""Tokens of source texts and how they nest: one pass over a text, in time that grows with its length alone.

Comments and strings are tokens, so brackets and declarations within them are none. Brackets nest as a tree; where blocks are indented, statements do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BREAK = r"\r\n|[\n\r\v\f]"
_REST = rf"""|(?P<open>[{{(\[])|(?P<close>[}})\]])|(?P<break>{_BREAK})|(?P<word>[\w$]+)|(?P<mark>[^\s\w$])"""
_LINE = r"[^\n\r\v\f]"
_QUOTED = r""""(?:\\.|[^"\\\n\r\v\f])*"|'(?:\\.|[^'\\\n\r\v\f])*'"""
# Every alternative either ends at the first place that can end it or runs to the end of the text, and a quote that is not closed on its line is a mark.
_BRACED = re.compile(rf"""(?s)(?P<comment>(?<![:\w"'`/])//{_LINE}*|/\*.*?(?:\*/|\Z))|(?P<string>\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|{_QUOTED}|`(?:\\.|[^`\\])*(?:`|\Z)){_REST}""")
_INDENTED = re.compile(rf"""(?s)(?P<comment>\#{_LINE}*)|(?P<string>\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|{_QUOTED}){_REST}""")
# The same with words and marks between as one run, which is all that a scan needs; what is in a run is counted at once.
_RUN = r"""|(?P<run>[^"'`/#{}()\[\];\n\r\v\f]+)|(?P<mark>[^\s])|\s"""
_RUNS = {indented: re.compile(p.pattern.replace("|(?P<word>[\\w$]+)|(?P<mark>[^\\s\\w$])", _RUN)) for indented, p in ((False, _BRACED), (True, _INDENTED))}
_ATOM = re.compile(r"[\w$]+|[^\s\w$]")
_LIST = re.compile(r"export[^\S\n\r\v\f]*(?:[{*]|type\b)")
_BREAK_AT = re.compile(_BREAK)
_BLANK = re.compile(_LINE)

#: A scan. lines: those of the text, with comments and all lines but the first of strings blanked, and a statement of names (import, from, export of a list) over
#: several lines put on its first. pieces: what of the lines can declare one thing, which ends after a curly bracket; opens: the piece in which the next block opens or a
#: semicolon comes before that (-1: neither does); ends: the line where that closes. nodes: tokens, pairs of brackets and the root of their tree.
SCAN = "struct<lines:array<string>,pieces:array<struct<text:string,line:int,opens:int,ends:int>>,nodes:int>"


def tokens(text: str, indented: bool) -> Iterator[tuple[str, int, int]]:
    """kind, begin and end of each token and line break; other white space is none."""
    for m in (_INDENTED if indented else _BRACED).finditer(text):
        yield m.lastgroup, m.start(), m.end()


def _blocks(count: int, found: list[tuple], last: int) -> list[tuple[int, int]]:
    """opens and ends of each piece. found: (piece, line, closing line or 0 for a semicolon, piece of the round or square bracket around it) in order."""
    out, later = [(-1, 0)] * count, []
    at = len(found) - 1
    for n in range(count - 1, -1, -1):
        while at >= 0 and found[at][0] == n:
            later.append(found[at])
            at -= 1
        while later and later[-1][3] >= n:  # in brackets of the declaration itself, or of one before it
            later.pop()
        if later:
            piece, line, closes, _ = later[-1]
            out[n] = (piece, min(closes or line, last))
    return out


def _indented_blocks(depths: list[int | None], last: int) -> list[tuple[int, int]]:
    """opens and ends of each line: the last line before a statement that is not indented further."""
    ends, waiting = [0] * len(depths), []
    for n, depth in enumerate(depths):
        if depth is not None:
            while waiting and depths[waiting[-1]] >= depth:
                ends[waiting.pop()] = n
            waiting.append(n)
    for n in waiting:
        ends[n] = last
    return [(n, max(n + 1, end)) for n, end in enumerate(ends)]


def scan(text: str, indented: bool) -> tuple[list[str], list[tuple[str, int, int, int]], int]:
    """The fields of SCAN."""
    bare, at, line, nodes, begin_of_line = [], 0, 1, 1, 0
    cuts: list[tuple[int, int, int]] = []  # pieces: begin, end, line
    breaks: list[tuple[int, int]] = []
    stack: list[tuple[str, int, int]] = []  # open brackets, their pieces, and their places in found
    found: list[list[int]] = []
    depths: list[int | None] = []
    first, fresh, names, joined = None, True, None, []  # the first word of the line; whether a statement can begin; the open statement of names; those found

    def cut(end: int, to: int) -> None:
        nonlocal piece
        if end > piece or not cuts or cuts[-1][2] < line:  # nothing behind a bracket is no piece
            cuts.append((piece, end, line))
        piece = to

    def broken(begin: int, end: int) -> None:
        nonlocal line, begin_of_line, first, fresh, names
        if not indented or kind == "break":
            cut(begin, end)
        breaks.append((begin, end))
        depths.append(depth)
        if names is not None and len(stack) <= names[1]:
            if line > names[0]:
                joined.append((names[0], line))
            names = None
        line, begin_of_line, first, fresh = line + 1, end, None, not stack and kind == "break"

    piece, depth, runs = 0, None, []
    for m in _RUNS[indented].finditer(text):
        kind, begin, end = m.lastgroup, m.start(), m.end()
        if kind == "break":
            broken(begin, end)
            depth = None
            continue
        own = text[begin:end]
        if kind == "run":
            runs.append(own)
        elif kind is None:  # other white space
            continue
        else:
            nodes += kind != "close"
        if kind != "comment" and first is None and (kind != "run" or own.strip()):
            word = _ATOM.search(text, begin)
            first = word[0]
            depth = word.start() - begin_of_line if fresh else None
            if fresh and first in ("import", "from") or not indented and first == "import" or first == "export" and _LIST.match(text, word.start()):
                names = (line, len(stack))
        if kind == "run":
            continue
        if kind in ("comment", "string"):
            inner = list(_BREAK_AT.finditer(own))
            kept = 0 if kind == "comment" else inner[0].start() if inner else len(own)
            bare += [text[at:begin], own[:kept], _BLANK.sub(" ", own[kept:])]
            at = end
            for m in inner:
                broken(begin + m.start(), begin + m.end())
                depth = None
        elif kind == "open":
            if own == "{":
                inner_block = not stack or stack[-1][0] == "{"
                around = -1 if inner_block else stack[-1][1]
                found.append([len(cuts), line, len(text) + 1, around])
            stack.append((own, len(cuts), len(found) - 1))
        elif kind == "close" and stack:
            bracket, _, place = stack.pop()
            if bracket == "{":
                found[place][2] = line
        elif own == ";" and not (stack and stack[-1][0] == "("):
            found.append([len(cuts), line, 0, -1])
        if not indented and (own == "{" and inner_block or own == "}" and (not stack or stack[-1][0] == "{")):
            cut(end, end)
    kind = "break"
    broken(len(text), len(text))
    nodes += len(_ATOM.findall("\n".join(runs)))
    bare.append(text[at:])
    plain = "".join(bare)
    lines = [plain[a:b] for a, b in zip([0, *(end for _, end in breaks)], [begin for begin, _ in breaks])]
    last = len(lines) - (len(lines) > 1 and lines[-1] == "" and text[-1:] in ("\n", "\r", "\v", "\f"))
    if indented:
        pieces = [(own, n, *block) for n, (own, block) in enumerate(zip(lines, _indented_blocks(depths, last)), 1)]
    else:
        blocks = _blocks(len(cuts), found, last)
        # A piece that does not begin its line stands for one that does: further in, as if on a line of its own.
        pieces = [((" " if i and cuts[i - 1][2] == n else "") + plain[a:b], n, *block) for i, ((a, b, n), block) in enumerate(zip(cuts, blocks))]
    for begin, end in joined:
        lines[begin - 1 : end] = [" ".join(lines[begin - 1 : end]), *[""] * (end - begin)]
    return lines[:last], [p for p in pieces if p[1] <= last], nodes


def scanned(files: DataFrame, name: str, indented: Column) -> DataFrame:
    """files (text) with the scan of each text under name; a null text counts as empty."""
    kept = files.columns
    rows = files.withColumns({"_scan_text": F.coalesce("text", F.lit("")), "_indented": F.coalesce(indented, F.lit(False))})
    schema = files.withColumn(name, F.lit(None).cast(SCAN)).schema
    piece = pa.struct([("text", pa.string()), ("line", pa.int32()), ("opens", pa.int32()), ("ends", pa.int32())])
    kind = pa.struct([("lines", pa.list_(pa.string())), ("pieces", pa.list_(piece)), ("nodes", pa.int32())])

    def made(text: str, by_indent: bool) -> dict:
        lines, pieces, nodes = scan(text, by_indent)
        return {"lines": lines, "pieces": [dict(zip(("text", "line", "opens", "ends"), p)) for p in pieces], "nodes": nodes}

    def scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 64) for b in batches for at in range(0, len(b), 64)):
            found = [made(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("_scan_text", "_indented")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, kind)], names=[*kept, name])

    return rows.mapInArrow(scan_all, schema)


def nested_tokens(text: str, indented: bool) -> Iterator[tuple]:
    """at (from 0), kind, token, line (from 1), depth and parent (at of the bracket around it, None outside of all) of each token."""
    at, line, stack = 0, 1, []
    for kind, begin, end in tokens(text, indented):
        own = text[begin:end]
        if kind == "close" and stack:
            stack.pop()
        if kind != "break":
            yield at, kind, own, line, len(stack), stack[-1] if stack else None
            if kind == "open":
                stack.append(at)
            at += 1
        line += len(_BREAK_AT.findall(own))


def token_table(files: DataFrame, indented: Column) -> DataFrame:
    """path and what nested_tokens gives, for each token of files (path, text)."""
    rows = files.select("path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(indented, F.lit(False)).alias("indented"))
    names = ("path", "at", "kind", "token", "line", "depth", "parent")

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=list(names))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, text, by_indent in zip(*(batch.column(c).to_pylist() for c in ("path", "text", "indented"))):
                out += [(path, *token) for token in nested_tokens(text, by_indent)]
                if len(out) > 1 << 16:
                    yield made(out)
                    out = []
            yield made(out)

    return rows.mapInArrow(listed, "path string, at int, kind string, token string, line int, depth int, parent int")
