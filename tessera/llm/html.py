"""Main-text extraction with wrappers inferred from pages of one host.

A page is a stream of tokens: structural tags and text. All different pages of a host are aligned. Each
page is a wrapper at first, a union-free regular expression over tags; neighbouring elements of one
signature are folded into a repeated group. Wrappers are matched against each other: equal tags are aligned,
unaligned ones become optional groups, further neighbours repeated groups, and differing strings text
slots. This goes in rounds: groups of about GROUP wrappers of a host, dealt by the pages' digests, give one wrapper each, until
each host has one. That wrapper then decides for every element, named by its path of signatures:

* the content element is the one marked as such (article, main), or else the one whose own blocks hold most text in slots:
  strings of the template and of links do not count; it is widened while its parent has twice as much;
* strings of the template within it are left out. The wrapper proposes those, optional groups already
  where two pages have them; all pages of the host then have to agree, and enough of them (more within a marked element) with
  different long blocks, so that copies of one page say nothing;
* without a marked one, repeated groups that are links are menus;
* elements whose names only hint at boilerplate (related-work, search-results) go if their text on the host's pages is
  mostly links or the template's, and stay otherwise. Those that name it (nav, form, class ad) go, inline ones too.

Pages are read with their host's wrapper; elements that the wrapper does not name follow the same rules by themselves.

Blocks are the texts of block-level elements, in page order; inline tags and line breaks belong to the text around
them. Character references are decoded once; white space within a block becomes one space.

Defined results: a null or empty page, or one without main text, gives the empty string; a null url is a host of its
own; unclosed elements are closed by the next one that cannot be inside them; elements nested deeper than DEPTH are read as
blocks of that depth; repeated rows are extracted alike, and of equally good content elements the outer one counts; other columns
are not read; no rows give no rows. Whole pages are read, however long.
"""

from __future__ import annotations

import hashlib
import html as references
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_broadcast, keyed_join, materialize, slices

#: Wrappers aligned in one group; pages from which on a string that never changes is boilerplate, and within a marked element; bytes of wrappers handed on at once.
GROUP, CONSTANT_PAGES, MARKED_PAGES, ALIGN_BYTES = 64, 4, 8, 1 << 18
#: Characters up to which a wrapper holds a string itself; of a longer one it holds a digest.
SLOT_CHARS = 64
#: Characters of a block that tells one page's main text from another's; nesting; pairs of children that are aligned one by one.
LONG_BLOCK, DEPTH, ALIGNED_PAIRS = 80, 150, 250_000
#: Shares of link text from which on a hint at boilerplate is right, and a repeated group is a menu.
LINKS, MENU = 0.5, 0.8
#: The content element is widened to its parent as long as that has so many times its text.
WIDER = 2
#: Wrapper bytes, over all hosts, up to which they are broadcast.
BROADCAST_BYTES = 32 << 20

# Tag sets.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript svg iframe textarea title object canvas math".split())
#: Raw elements whose end tag may be left out: without one, only the start tag is.
NESTED = frozenset("template noscript svg object canvas math".split())
#: What a head can hold; anything else, text included, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript script style template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset("nav footer aside form button select option menu dialog fieldset input script style template noscript iframe textarea head title object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = ("article", "main")
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd tr td th".split()
)
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts of a class, id or role that name boilerplate, those that hint at it (they name it if they are the whole class), and names of content.
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr login masthead"
    " menu nav navbar navigation newsletter pagination paywall popup replies reply respond sidebar sponsor sponsored sponsors subscribe toolbar".split()
)
HINTS = frozenset("banner form header modal notice notices overlay promo promos promotion related search share sharing skip social tracking widget".split())
MARKED = re.compile(r"(^|[-_ ])(article|articlebody|content|entry|main|post|story)($|[-_ ])")

_open = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: Where a tag can end, and where a quoted value can begin: right after an equals sign.
_stop = re.compile(r">|=\s*[\"']")
_edges = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*(?:>|$)", re.IGNORECASE) for tag in RAW}
_named = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


class Linked(str):
    """A string inside a link."""


@dataclass
class Element:
    """children: elements and strings. open: for inline boilerplate, how many of its tags are open."""

    tag: str
    names: str = ""
    children: list = field(default_factory=list)
    open: int = 1

    @property
    def signature(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag

    @property
    def own(self) -> str:
        return tidy("".join(c for c in self.children if isinstance(c, str)))

    @property
    def blocks(self) -> list[Element]:
        """Child elements, without the inline ones, which are boilerplate."""
        return [c for c in self.children if not isinstance(c, str) and c.tag not in INLINE]

    def text_sizes(self) -> tuple[int, int]:
        """Characters in all, and in links."""
        sizes = [(len(self.own), sum(len(tidy(c)) for c in self.children if isinstance(c, Linked))), *(c.text_sizes() for c in self.blocks)]
        return sum(n for n, _ in sizes), sum(n for _, n in sizes)


def raw_end(page: str, tag: str, at: int) -> int | None:
    """Where the raw element whose content begins at at ends: after its literal end tag, or None if that is missing."""
    depth = 1
    for m in _edges[tag].finditer(page, at):
        if m[1]:
            depth -= 1
            if not depth:
                return m.end()
        elif tag in NESTED and not m[0].endswith("/>"):
            depth += 1
    return None


class Tags:
    """Where the tags of a page end, each found in time that grows with the page alone, however many do not."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.stops = [(m.start(), m.end(), m[0][-1]) for m in _stop.finditer(page)]
        self.starts = [start for start, _, _ in self.stops]
        self.dead: set[int] = set()  # stops from which no tag ends
        self.unclosed: set[str] = set()  # quotes that do not occur any more

    def end(self, at: int) -> int | None:
        """The place of the bracket that ends a tag whose name ends at at: the first outside of a quoted value. A quote elsewhere is a plain character."""
        seen, stop = [], bisect_left(self.starts, at)
        while stop < len(self.stops) and stop not in self.dead:
            start, end, mark = self.stops[stop]
            if mark == ">":
                return start
            seen.append(stop)
            close = -1 if mark in self.unclosed else self.page.find(mark, end)
            if close < 0:
                self.unclosed.add(mark)
                stop += 1
            else:
                stop = bisect_left(self.starts, close + 1)
        self.dead.update(seen)
        return None

    def tokens(self, at: int) -> Iterator[tuple[str | None, str | None, str, str | None, int]]:
        """From at on: (closing, tag, attributes, None, end) of each tag and (None, None, "", text, end) of each text; comments and declarations have neither."""
        page = self.page
        while at < len(page):
            if page[at] != "<":
                end = page.find("<", at)
                end = len(page) if end < 0 else end
                yield None, None, "", page[at:end], end
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
            elif at < self.last and page[at + 1] in "!?":
                end = page.index(">", at) + 1
            elif at < self.last and (m := _open.match(page, at)) and (close := self.end(m.end())) is not None:
                end = close + 1
                yield m[1], m[2], page[m.end() : close], None, end
            else:
                end = at + 1
                yield None, None, "", "<", end
            at = end


def names_of(attributes: str) -> str:
    """The class, id, role and itemprop, lower-cased, with numbers as 0."""
    found = [a or b or c for _, a, b, c in _named.findall(attributes)]
    return " ".join(re.sub(r"\d+", "0", v.lower()).strip() for v in found if v)


def names_noise(names: str, parts: bool = True) -> bool | None:
    """Whether names name boilerplate, by a whole word or (if parts) by part of one; None if they only hint at it."""
    words = [w.strip("-_0") for w in names.split()]
    if any(w in NAMES or w in HINTS for w in words):
        return True
    found = {x for w in words for x in re.split("[-_0]+", w)} if parts else set()
    return True if found & NAMES else None if found & HINTS else False


def named_noise(names: str) -> bool:
    """Whether names name boilerplate without any hint."""
    words = [w.strip("-_0") for w in names.split()]
    return any(w in NAMES or NAMES.intersection(re.split("[-_0]+", w)) for w in words)


def parse(page: str) -> Element:
    """The block structure of a page: inline tags are dropped, raw elements are left out with what they hold."""
    root = Element("")
    stack, in_head, endless, link = [root], False, set(), 0
    tags = Tags(page)
    tokens = tags.tokens(0)
    while (token := next(tokens, None)) is not None:
        closing, tag, attributes, text, end_of_tag = token
        if text:
            if in_head and text.isspace():
                continue
            in_head = False
            stack[-1].children.append(Linked(text) if link else text)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag == "head":
            in_head = not closing
            continue
        if in_head and (closing or (tag in IN_HEAD and tag not in RAW)):
            continue
        in_head = in_head and tag in IN_HEAD
        top = stack[-1]
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else len(stack)
            if tag in ("br", "wbr", "img"):
                top.children.append(" " if tag != "wbr" else "")
            elif top.tag == tag:
                top.open += -1 if closing else 1
                if not top.open:
                    stack.pop()
            elif not closing and attributes and top.tag not in INLINE and names_noise(names := names_of(attributes), False):
                top.children.append(Element(tag, names))
                stack.append(top.children[-1])
            continue
        if top.tag in INLINE:
            stack.pop()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            link = link if link <= len(stack) else 0
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/") and tag not in endless:
                end = raw_end(page, tag, end_of_tag)
                if end is not None:
                    tokens = tags.tokens(end)
                elif tag not in NESTED:
                    break
                else:
                    endless.add(tag)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in SIBLING.get(tag, ()):
                del stack[i:]
                break
            if stack[i].tag not in ("p", "li", "dt", "dd", "td", "th"):
                break
        element = Element(tag, names_of(attributes) if attributes else "")
        if len(stack) > DEPTH:
            stack.pop()
        stack[-1].children.append(element)
        link = link if link <= len(stack) else 0
        if tag not in VOID and not (attributes.endswith("/") and tag not in CLOSES_P):
            stack.append(element)
    return root


def tidy(text: str) -> str:
    return " ".join(references.unescape(text).split())


def slot_of(text: str) -> str:
    """What a wrapper holds of a string: itself, or a digest of a long one."""
    return text if len(text) <= SLOT_CHARS and not text.startswith("\0") else "\0" + hashlib.blake2b(text.encode(errors="replace"), digest_size=16).hexdigest()


@dataclass
class Node:
    """An element of the wrapper. slot: its string (see slot_of) on the aligned pages (strings, if repeated, by line), None once it differed; chars, linked: characters in all and in links."""

    signature: str
    seen: int = 1
    optional: bool = False
    repeated: bool = False
    slot: str | None = ""
    chars: int = 0
    linked: int = 0
    children: list = field(default_factory=list)

    def sizes(self) -> tuple[int, int]:
        below = [c.sizes() for c in self.children]
        return self.chars + sum(n for n, _ in below), self.linked + sum(n for _, n in below)

    def listed(self) -> list:
        return [self.signature, self.seen, self.optional, self.repeated, self.slot, self.chars, self.linked, [c.listed() for c in self.children]]

    @classmethod
    def made_of(cls, values: list) -> Node:
        return cls(*values[:-1], [cls.made_of(c) for c in values[-1]])


def wrapper_of(element: Element) -> Node:
    """A page as a wrapper: neighbours of one signature fold into a repeated group."""
    own = element.own
    node = Node(element.signature, slot=slot_of(own), chars=len(own), linked=sum(len(tidy(c)) for c in element.children if isinstance(c, Linked)))
    for child in element.blocks:
        add(node.children, wrapper_of(child))
    return node


def add(children: list[Node], made: Node) -> None:
    if children and children[-1].signature == made.signature:
        children[-1] = merge(children[-1], made, within=True)
        children[-1].repeated = True
    else:
        children.append(made)


def folded(nodes: list[Node]) -> list[Node]:
    """One repeated group for each signature, for element lists that are too long to align one by one."""
    out: dict[str, list[Node]] = {}
    for node in nodes:
        add(out.setdefault(node.signature, []), node)
    return [group[0] for group in out.values()]


def merge(a: Node, b: Node, within: bool = False) -> Node:
    """The wrapper of everything that a and b describe; within: both are of one page."""
    out = Node(a.signature, a.seen if within else a.seen + b.seen, a.optional or b.optional, a.repeated or b.repeated)
    if within:
        out.slot = None if a.slot is None or b.slot is None else "\n".join(filter(None, (a.slot, b.slot)))
    else:
        out.slot = a.slot if a.slot == b.slot else None
    out.chars, out.linked = a.chars + b.chars, a.linked + b.linked
    x, y = a.children, b.children
    if [c.signature for c in x] == [c.signature for c in y]:
        for i, j in zip(x, y):
            add(out.children, merge(i, j, within))
        return out
    if len(x) * len(y) > ALIGNED_PAIRS:
        x, y = folded(x), folded(y)
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].signature == y[j].signature else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i].signature == y[j].signature:
            made = merge(x[i], y[j], within)
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            made, i = x[i], i + 1
            made.optional = True
        else:
            made, j = y[j], j + 1
            made.optional = True
        add(out.children, made)
    return out


def expression(node: Node) -> str:
    """The wrapper as text, for people: groups in brackets with ? and +, slots as #."""
    inner = " ".join(filter(None, ["#" if node.slot is None else node.slot and repr(node.slot[:20]), *map(expression, node.children)]))
    text = f"<{node.signature}>{inner}</>"
    return f"({text}){'+' if node.repeated else ''}{'?' if node.optional else ''}" if node.repeated or node.optional else text


def is_noise(tag: str, names: str, inside: bool) -> bool | None:
    """Whether an element is boilerplate by itself; None: its names hint at it."""
    if tag in BOILERPLATE or (tag == "header" and not inside):
        return True
    verdict = False if tag in CONTENT or not names else names_noise(names)
    # What a heading or a paragraph is called may be how it looks: a hint stays one there, even as the whole class.
    return None if verdict and (tag in HEADINGS or tag == "p") and not named_noise(names) else verdict


def by_links(chars: int, linked: int) -> bool:
    return linked >= LINKS * chars


@dataclass
class Rules:
    """What extraction needs of a wrapper: the content path (None: take it from the page), constant strings by path, and whether what is
    at a path goes: where names hint at boilerplate, and menus."""

    content: str | None
    constant: dict[str, str]
    noise: dict[str, bool] = field(default_factory=dict)

    @property
    def marked(self) -> bool:
        return self.content is not None and tag_at(self.content) in CONTENT

    def packed(self) -> str:
        return json.dumps([self.content, self.constant, self.noise])

    @classmethod
    def unpacked(cls, text: str | None) -> Rules:
        return cls(*json.loads(text)) if text else cls(None, {})


def tag_at(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def rules_of(node: Node, agreed: dict[str, str] | None = None) -> Rules:
    """The rules of a wrapper; agreed: the constant strings that may be left out (all that it proposes, if absent)."""
    constant: dict[str, str] = {}
    noise: dict[str, bool] = {}
    menus: list[str] = []
    blocks: dict[str, int] = {}
    totals: dict[str, int] = {}
    marked: dict[str, int] = {}

    def template(n: Node, path: str) -> bool:
        enough = n.seen >= (2 if n.optional else CONSTANT_PAGES)
        return bool(n.slot) and enough and n.signature.partition(".")[0] not in HEADINGS and (agreed is None or agreed.get(path) == n.slot)

    def varies(n: Node, path: str) -> int:
        """Characters in slots of n itself."""
        return 0 if template(n, path) else max(0, n.chars - n.linked)

    def constant_only(n: Node, path: str) -> bool:
        return (not n.chars or template(n, path)) and all(constant_only(c, f"{path}/{c.signature}") for c in n.children)

    def walk(n: Node, path: str, inside: bool) -> int:
        tag, _, names = n.signature.partition(".")
        verdict = is_noise(tag, names, inside) if path else False
        if verdict is None:
            verdict = noise[path] = by_links(*n.sizes()) or constant_only(n, path)
        if verdict:
            return 0
        if template(n, path):
            constant[path] = n.slot
        if n.repeated and tag not in HEADINGS:
            chars, linked = n.sizes()
            if chars and linked >= MENU * chars:
                menus.append(path)
        inside = inside or tag in CONTENT
        total = varies(n, path) + sum(walk(c, f"{path}/{c.signature}", inside) for c in n.children)
        totals[path] = totals.get(path, 0) + total
        near = [(c, f"{path}/{c.signature}") for c in n.children if c.signature.partition(".")[0] in ("p", "pre", "blockquote", "li") or c.signature.partition(".")[0] in HEADINGS]
        blocks[path] = blocks.get(path, 0) + varies(n, path) + sum(varies(c, at) for c, at in near)
        if tag in CONTENT or (names and MARKED.search(names)):
            marked[path] = max(marked.get(path, 0), total)
        return total

    total = walk(node, "", False)
    named = [p for p in marked if tag_at(p) == "article"] or [p for p in marked if tag_at(p) == "main"] or list(marked)
    named = [p for p in named if 2 * marked[p] >= total or tag_at(p) in CONTENT]
    if named:
        content = max(named, key=lambda p: (marked[p], -len(p)))
    else:
        content = max(blocks, key=lambda p: (blocks[p], -len(p)), default=None)
        while content and totals[content.rpartition("/")[0]] >= WIDER * totals[content]:
            content = content.rpartition("/")[0]
    rules = Rules(content, constant, noise)
    if not rules.marked:
        rules.noise |= dict.fromkeys(menus, True)
    return rules


def infer(pages: list[str]) -> Node | None:
    wrapper = None
    for page in pages:
        made = wrapper_of(parse(page))
        wrapper = made if wrapper is None else merge(wrapper, made)
    return wrapper


def extract(page: str | None, rules: Rules) -> str:
    if not page:
        return ""
    root = parse(page)
    found: list[tuple[Element, str]] = []

    def find(e: Element, path: str, want: str) -> None:
        if path == want:
            found.append((e, path))
            return
        for c in e.children:
            if not isinstance(c, str):
                at = f"{path}/{c.signature}"
                if want == at or want.startswith(at + "/"):
                    find(c, at, want)

    if rules.content is not None:
        find(root, "", rules.content)
    if not found:
        own = rules_of(wrapper_of(root))
        rules = Rules(own.content, rules.constant, own.noise | rules.noise)
        find(root, "", own.content or "")
    out: list[str] = []
    constant = {path: set(text.split("\n")) for path, text in rules.constant.items()}

    def emit(text: list[str], path: str) -> None:
        whole = tidy("".join(text))
        text.clear()
        if whole and not (path in constant and slot_of(whole) in constant[path]):
            out.append(whole)

    def goes(e: Element, path: str) -> bool:
        verdict = is_noise(e.tag, e.names, True)
        if verdict is False and path in rules.noise:
            return by_links(*e.text_sizes())
        return rules.noise.get(path, by_links(*e.text_sizes())) if verdict is None else verdict

    def walk(e: Element, path: str, header: bool) -> None:
        run: list[str] = []
        for c in e.children:
            if isinstance(c, str):
                if not header or e.tag in HEADINGS:
                    run.append(c)
            elif c.tag in INLINE:
                run.append(" ")
            else:
                emit(run, path)
                at = f"{path}/{c.signature}"
                if not goes(c, at):
                    walk(c, at, header or c.tag == "header")
        emit(run, path)

    for e, path in found:
        walk(e, path, False)
    return "\n".join(out)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def agreement(page: str, rules: Rules) -> tuple[str | None, dict[str, bool]]:
    """The longest block of a page that is no proposed constant, None if it is short; and for each constant path that it has, whether its strings are the constant."""
    strings: dict[str, list[str]] = {}
    longest = ""

    def walk(e: Element, path: str) -> None:
        nonlocal longest
        own = e.own
        if path in rules.constant:
            strings.setdefault(path, []).extend([slot_of(own)] if own else [])
        if len(own) > len(longest) and slot_of(own) not in rules.constant.get(path, "").split("\n"):
            longest = own
        for c in e.blocks:
            walk(c, f"{path}/{c.signature}")

    walk(parse(page), "")
    return longest if len(longest) >= LONG_BLOCK else None, {path: "\n".join(own) == rules.constant[path] for path, own in strings.items()}


def confirmed(pages: DataFrame, proposed: DataFrame) -> DataFrame:
    """host and agreed (the JSON of path and string) of the proposed constants that all pages of their host confirm."""
    proposed = proposed.where("rules is not null")
    hosts = proposed.select("host", F.when(F.col("marked"), MARKED_PAGES).otherwise(CONSTANT_PAGES).alias("least"))
    size = proposed.agg(F.sum(F.octet_length("rules") + 64)).first()[0] or 0
    rows = pages.where("html <> ''").select(host_of(F.col("url")).alias("host"), "html")
    rows = rows.join(F.broadcast(proposed.select("host", "rules")) if size <= BROADCAST_BYTES else proposed.select("host", "rules"), "host")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Rules] = {}
        for batch in slices(batches):
            out = []
            for host, page, packed in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "rules"))):
                if packed not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[packed] = Rules.unpacked(packed)
                text, found = agreement(page, known[packed])
                name = None if text is None else int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=8).digest(), "big", signed=True)
                out += [(host, path, known[packed].constant[path], same, name) for path, same in found.items()]
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "path", "string", "same", "main"])

    found = rows.select("host", "html", "rules").mapInArrow(seen, "host string, path string, string string, same boolean, main long")
    found = found.join(F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts, "host")
    texts = found.groupBy("host", "path", "string", "main").agg(F.min("same").alias("same"), F.min("least").alias("least"))
    agreed = texts.groupBy("host", "path", "string").agg(F.min("same").alias("same"), F.count("main").alias("mains"), F.min("least").alias("least"))
    agreed = agreed.where((F.col("mains") >= F.col("least")) & F.col("same"))
    return agreed.groupBy("host").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "string")))).alias("agreed"))


def page_wrappers(pages: DataFrame) -> DataFrame:
    """host, at (a digest of the page) and wrapper of all pages that are not empty, equal pages of a host once."""
    rows = pages.where("html <> ''").select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("at"), "html")
    names = ["host", "at", "wrapper"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            begin, held, size = 0, [], 0
            for i, page in enumerate(batch.column("html").to_pylist(), 1):
                held.append(json.dumps(wrapper_of(parse(page)).listed(), separators=(",", ":")))
                size += len(held[-1])
                if size >= ALIGN_BYTES or i == len(batch):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begin, i - begin) for c in names[:2]), pa.array(held, pa.string())], names=names)
                    begin, held, size = i, [], 0

    return rows.mapInArrow(read, "host string, at long, wrapper string").distinct()


def align(group: pd.DataFrame) -> pd.DataFrame:
    """One wrapper for those of a group, in the order of their digests."""
    group = group.sort_values(["at", "wrapper"])
    whole = None
    for text in group["wrapper"]:
        made = Node.made_of(json.loads(text))
        whole = made if whole is None else merge(whole, made)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "at": [group["part"].iloc[0]], "wrapper": [json.dumps(whole.listed(), separators=(",", ":"))]})


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper, aligned from all pages of the host in groups of about GROUP, then from those groups' wrappers, and so on."""
    level = materialize(page_wrappers(pages), "page-wrappers")
    while True:
        counts = materialize(level.groupBy("host").agg(F.count("*").alias("n")), "host-counts")
        most = counts.agg(F.max("n")).first()[0] or 0
        rows = keyed_join(level, counts, "host", "at").withColumn("part", F.pmod("at", F.ceil(F.col("n") / GROUP)))
        level = materialize(rows.groupBy("host", "part").applyInPandas(align, "host string, at long, wrapper string"), "aligned")
        if most <= GROUP:
            return level.select("host", "wrapper")


def wrappers(pages: DataFrame) -> DataFrame:
    """host and rules, from all pages of each host."""
    found = host_wrappers(pages)

    def propose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [rules_of(Node.made_of(json.loads(text))) for text in frame["wrapper"]]
            yield pd.DataFrame({"host": frame["host"], "rules": [r.packed() if r.constant else None for r in made], "marked": [r.marked for r in made]})

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [rules_of(Node.made_of(json.loads(text)), json.loads(agreed) if agreed else {}) for text, agreed in zip(frame["wrapper"], frame["agreed"])]
            yield pd.DataFrame({"host": frame["host"], "rules": [r.packed() for r in made]})

    proposed = materialize(found.mapInPandas(propose, "host string, rules string, marked boolean"), "proposed")
    agreed = materialize(confirmed(pages, proposed), "agreed")
    return found.join(bounded_broadcast(agreed), "host", "left").mapInPandas(decide, "host string, rules string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = materialize(wrappers(pages), "wrappers")
    size = found.agg(F.sum(F.octet_length("rules") + 64)).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left").select("page_id", "url", "html", "rules")
    kinds = dict(pages.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Rules] = {}
        for batch in slices(batches):
            texts = []
            for page, rules in zip(batch.column("html").to_pylist(), batch.column("rules").to_pylist()):
                if rules not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[rules] = Rules.unpacked(rules)
                texts.append(extract(page, known[rules]))
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
