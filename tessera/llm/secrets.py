"""Secret scans with inferred grammars.

Three fixed patterns give the base spans. What they matched in a sample of documents are labelled credentials;
for each label a prefix tree is built over character classes, and statistically compatible states are merged (ALERGIA:
Carrasco and Oncina, 1994) into a probabilistic automaton. States are compatible if neither their next symbols nor
the lengths of what follows them differ significantly, a few steps ahead included. Formats of one length so keep a state for
each position, those of many lengths become loops, and a character that never changes at its position is kept as such.

Every long run of credential characters is a candidate, or each stretch that base spans leave of it. Its score
is the mean log-likelihood ratio per character between the best automaton and a bigram model of ordinary runs; candidates
that score as labelled credentials do, and better than any ordinary run of the sample, are added as spans of kind "learned". What
stands after an equals sign in a run is a candidate too. Base spans are scored alike.

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive; without labelled
credentials in the sample nothing is learned, and the base spans remain, without scores; repeated rows get equal spans, and null
ids are kept; no rows give no rows; other columns are not read. Texts and runs are scanned whole, however long.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import lean, slices

# The base patterns, their least lengths, and the order of kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "learned")

#: A candidate is a run of these, or what base spans leave of it, of so many at least; only the sample has a most.
RUN = r"[A-Za-z0-9+/_.=-]"
SHORTEST, LONGEST = 16, 512
#: These do not belong to a stretch where it borders on a base span.
SEPARATORS = "+/_.=-"
#: Bounds of the sample on the driver: documents read for it, credentials of a kind, and ordinary runs.
FIT_DOCUMENTS, FIT_CREDENTIALS, FIT_RUNS = 20_000, 400, 4000
#: What two shares, and two distributions of lengths, must differ by (in standard errors, and by Kolmogorov and Smirnov), and how many steps ahead.
SHARES, LENGTHS, AHEAD = 3.5, 1.63, 8
#: Uses of one character from which on it is the only one of its place, and the share of others there.
LITERAL, OTHERS = 5, 0.05
#: Smoothing of unseen symbols, and the quantile of labelled scores to reach.
FLOOR, QUANTILE = 1e-4, 0.05

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(ACCESS[:-1] + "{%d,}" % (LEAST["access"] - 4))
_hex = re.compile(HEX[:-1] + "{%d,}" % LEAST["hex"])
_runs = re.compile(f"(?<!{RUN}){RUN}{{{SHORTEST},}}")
_short_runs = re.compile(f"(?<!{RUN}){RUN}{{4,}}")
_CUES = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind.

    The least lengths of access and hex are in their patterns: runs are maximal, so that drops the same matches.
    """
    found = []
    low = text.lower()
    if any(cue in low for cue in _CUES):
        found += [(m.start(), m.end(), 0) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _access.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _hex.finditer(text)]
    return [(start, end, KINDS[k]) for start, end, k in sorted(found, key=lambda x: (x[0], x[2]))]


def symbol(c: str) -> str:
    """Character class: digit, hexadecimal letter, other small or capital letter, or the character itself."""
    if c.isdigit():
        return "9"
    if c in "abcdefABCDEF":
        return "f"
    return "z" if "a" <= c <= "z" else "Z" if "A" <= c <= "Z" else c


CLASS_SIZE = {"9": 10, "f": 12, "z": 20, "Z": 20}


@dataclass
class State:
    """count and ends: words through it and at its end; only: the one character of a symbol, "" if there are several; rest: lengths of what follows."""

    count: int = 0
    ends: int = 0
    to: dict[str, int] = field(default_factory=dict)
    uses: Counter = field(default_factory=Counter)
    only: dict[str, str] = field(default_factory=dict)
    rest: Counter = field(default_factory=Counter)

    def probability(self, s: str, c: str) -> float:
        """Of the character c with the symbol s here; unseen symbols count as half a use."""
        share = max(self.uses[s], 0.5) / (self.count + 1)
        size = CLASS_SIZE.get(s, 1)
        literal = self.only.get(s, "")
        if literal and self.uses[s] >= LITERAL:
            return share * (1 - OTHERS if c == literal else OTHERS / size)
        return share / size

    def follow(self, s: str) -> int | None:
        """The next state: that of the symbol, else where most go."""
        if s in self.to or not self.to:
            return self.to.get(s)
        return self.to[max(self.to, key=lambda k: (self.uses[k], k))]


def shares_differ(f1: int, n1: int, f2: int, n2: int) -> bool:
    both = (f1 + f2) / (n1 + n2)
    return abs(f1 / n1 - f2 / n2) > SHARES * math.sqrt(both * (1 - both) * (1 / n1 + 1 / n2))


def lengths_differ(a: Counter, b: Counter) -> bool:
    """Whether their ranges are apart, or the distributions differ."""
    if max(a) < min(b) or max(b) < min(a):
        return True
    n, m, x, y = a.total(), b.total(), 0, 0
    most = LENGTHS * math.sqrt(1 / n + 1 / m)
    if most >= 1:
        return False
    for length in sorted(a.keys() | b.keys()):
        x, y = x + a[length], y + b[length]
        if abs(x / n - y / m) > most:
            return True
    return False


def infer(words: list[str]) -> list[State]:
    """The automaton that red-blue merging makes of the words' prefix tree; state 0 is the start."""
    states = [State()]
    for word in words:
        at = 0
        for i, c in enumerate(word):
            state, s = states[at], symbol(c)
            state.count += 1
            state.rest[len(word) - i] += 1
            if s not in state.to:
                state.to[s] = len(states)
                states.append(State())
            state.uses[s] += 1
            if state.only.setdefault(s, c) != c:
                state.only[s] = ""
            at = state.to[s]
        states[at].count += 1
        states[at].ends += 1
        states[at].rest[0] += 1

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b, 0)]
        while todo:
            x, y, steps = todo.pop()
            p, q = states[x], states[y]
            if lengths_differ(p.rest, q.rest) or shares_differ(p.ends, p.count, q.ends, q.count):
                return False
            for s in p.to.keys() | q.to.keys():
                if shares_differ(p.uses[s], p.count, q.uses[s], q.count):
                    return False
                if s in p.to and s in q.to and steps < AHEAD:
                    todo.append((p.to[s], q.to[s], steps + 1))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree under b to a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            p, q = states[x], states[y]
            p.count += q.count
            p.ends += q.ends
            p.rest.update(q.rest)
            for s, t in q.to.items():
                p.uses[s] += q.uses[s]
                if p.only.setdefault(s, q.only[s]) != q.only[s]:
                    p.only[s] = ""
                if s in p.to:
                    todo.append((p.to[s], t))
                else:
                    p.to[s] = t

    red, merged = [0], {0}
    while True:
        blue = [(r, s, t) for r in red for s, t in sorted(states[r].to.items()) if t not in merged]
        if not blue:
            break
        r, s, t = max(blue, key=lambda x: (states[x[2]].count, -x[2]))
        # The latest states first: those of the same place in a format of one length.
        for other in reversed(red):
            if compatible(other, t):
                states[r].to[s] = other
                fold(other, t)
                break
        else:
            red.append(t)
            merged.add(t)
    number = {old: new for new, old in enumerate(red)}
    for r in red:
        states[r].to = {s: number[t] for s, t in states[r].to.items()}
    return [states[r] for r in red]


@dataclass
class Grammars:
    automata: dict[str, list[State]]
    pairs: dict[str, float]
    thresholds: dict[str, float]

    def ordinary(self, word: str) -> float:
        least = math.log(FLOOR)
        return sum(self.pairs.get(a + b, least) for a, b in zip("^" + word, word + "$"))

    @staticmethod
    def reads(automaton: list[State], word: str) -> bool:
        """Whether the word leads to an end, by unseen symbols at a tenth of its places at most."""
        at, unseen = 0, 0
        for s in map(symbol, word):
            unseen += s not in automaton[at].to
            at = automaton[at].follow(s)
            if at is None:
                return False
        return automaton[at].ends > 0 and 10 * unseen <= len(word)

    @staticmethod
    def likelihood(automaton: list[State], word: str) -> float:
        total, at = 0.0, 0
        for c in word:
            s, state = symbol(c), automaton[at]
            after = state.follow(s)
            if after is None:
                return total + (len(word) + 1) * math.log(FLOOR)
            total += math.log(state.probability(s, c))
            at = after
        return total + math.log(max(FLOOR, automaton[at].ends / max(1, automaton[at].count)))

    def score(self, kind: str, word: str) -> float:
        return (self.likelihood(self.automata[kind], word) - self.ordinary(word)) / (len(word) + 1)

    def accepts(self, word: str) -> bool:
        return any(self.score(kind, word) >= least for kind, least in self.thresholds.items())

    def best(self, word: str) -> float | None:
        return max((self.score(kind, word) for kind in self.automata), default=None)


def fit(credentials: dict[str, list[str]], ordinary: list[str]) -> Grammars:
    """Automata from labelled credentials, the bigram model from ordinary runs, and the thresholds.

    Ordinary runs may hold credentials that no pattern labels: long runs of letters and digits that an automaton can
    read are left out. Plain numbers stay.
    """
    # The value of an assignment has a format of its own only where it is long enough to be a candidate.
    long = {kind: [w for w in words if SHORTEST <= len(w) <= LONGEST] for kind, words in credentials.items()}
    grammars = Grammars({kind: infer(words) for kind, words in long.items() if words}, {}, {})

    def suspect(word: str) -> bool:
        mixed = any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
        parts = [word, *re.split("=(?!=)", word)]
        return mixed and any(len(x) >= SHORTEST and grammars.reads(a, x) for a in grammars.automata.values() for x in parts)

    ordinary = [w for w in ordinary if not suspect(w)]
    uses, totals = Counter(), Counter()
    for word in ordinary:
        for a, b in zip("^" + word, word + "$"):
            uses[a + b] += 1
            totals[a] += 1
    grammars.pairs = {ab: math.log(n / totals[ab[0]]) for ab, n in uses.items()}
    for kind in grammars.automata:
        own = sorted(grammars.score(kind, w) for w in long[kind])
        others = [grammars.score(kind, w) for w in ordinary if SHORTEST <= len(w) <= LONGEST]
        grammars.thresholds[kind] = max(own[int(QUANTILE * len(own))], max(others, default=-math.inf) + 1e-9, 0.0)
    return grammars


def sample_values(text: str) -> Iterator[tuple[str, str]]:
    """(label, value) of the labelled credentials of a text, and of the ordinary runs ("short" or "long") that no base span touches."""
    spans = base_spans(text)
    for start, end, kind in spans:
        yield kind, _assign.match(text, start)[2] if kind == "assign" else text[start:end]
    i, reach = 0, 0
    for m in _short_runs.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            reach = max(reach, spans[i][1])
            i += 1
        if reach <= m.start():
            yield ("short" if len(m[0]) < SHORTEST else "long"), m[0]


#: Values kept for each label of the sample.
_KEPT = {"assign": FIT_CREDENTIALS, "access": FIT_CREDENTIALS, "hex": FIT_CREDENTIALS, "short": FIT_RUNS, "long": FIT_RUNS}


def learn(documents: DataFrame) -> Grammars:
    """Fit on the documents of lowest hashed id, FIT_DOCUMENTS or so, in one pass: of each label the distinct values of lowest hash."""
    share = min(1.0, FIT_DOCUMENTS / max(1, documents.count()))
    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    @lean
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, set] = {label: set() for label in _KEPT}
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                for label, value in sample_values(text):
                    if len(value) <= LONGEST:
                        held[label].add((zlib.crc32(value.encode()), value))
            for label, n in _KEPT.items():
                if len(held[label]) > 2 * n:
                    held[label] = set(heapq.nsmallest(n, held[label]))
        rows = [(label, *x) for label, n in _KEPT.items() for x in heapq.nsmallest(n, held[label])]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()))], names=["label", "h", "v"])

    rows = sample.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(values, "label string, h long, v string").distinct()
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h", "v"))).where(F.col("n") <= max(_KEPT.values()))
    found: dict[str, list[str]] = {label: [] for label in _KEPT}
    for r in sorted(rows.collect(), key=lambda r: (r["label"], r["n"])):
        if r["n"] <= _KEPT[r["label"]]:
            found[r["label"]].append(r["v"])
    credentials = {kind: found[kind] for kind in LEAST}
    labelled = {v for own in credentials.values() for v in own}
    return fit(credentials, [w for w in found["short"] + found["long"] if w not in labelled])


def all_spans(text: str, grammars: Grammars) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    found, i = list(base), 0
    by_start = sorted(base)
    for m in _runs.finditer(text) if grammars.automata else ():
        at, stop = m.span()
        while i < len(by_start) and by_start[i][1] <= at:
            i += 1
        # i stays at the first base span that can reach into a later run.
        k, cut = i, False
        while at < stop:
            covered = k < len(by_start) and by_start[k][0] < stop
            end = max(at, by_start[k][0]) if covered else stop
            start, to = at, end
            if cut:
                start = to - len(text[start:to].lstrip(SEPARATORS))
            if covered:
                to = start + len(text[start:to].rstrip(SEPARATORS))
            found += [(*span, "learned") for span in accepted(text, start, to, grammars)]
            if not covered:
                break
            at, cut, k = max(at, by_start[k][1]), cut or by_start[k][1] > m.start(), k + 1
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def accepted(text: str, start: int, to: int, grammars: Grammars) -> list[tuple[int, int]]:
    """The candidate text[start:to], or its parts after equals signs where those are more likely, as far as they are accepted."""
    if to - start < SHORTEST:
        return []
    cuts = [start, *(i + 1 for i in range(start, to - 1) if text[i] == "=" and text[i + 1] != "="), to + 1]
    parts = [(a, b - 1) for a, b in zip(cuts, cuts[1:]) if b - 1 - a >= SHORTEST] if len(cuts) > 2 else []
    parts = [(a, b) for a, b in parts if grammars.accepts(text[a:b])]
    if parts and max(grammars.best(text[a:b]) for a, b in parts) > grammars.best(text[start:to]):
        return parts
    return [(start, to)] if grammars.accepts(text[start:to]) else parts


SPANS = "array<struct<start:long,end:long,kind:string,score:double>>"


def find_secrets(documents: DataFrame, grammars: Grammars | None = None) -> DataFrame:
    """doc_id and spans, by start and kind, of every document; score: that of the best automaton (of an assignment's value)."""
    shared = documents.sparkSession.sparkContext.broadcast(grammars or learn(documents))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def scored(text: str) -> list[dict]:
        found = all_spans(text, shared.value)
        values = [_assign.match(text, a)[2] if kind == "assign" else text[a:b] for a, b, kind in found]
        return [dict(zip(("start", "end", "kind", "score"), (*span, shared.value.best(v)))) for span, v in zip(found, values)]

    @lean
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [scored(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    key = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(scanned, f"doc_id {key}, spans {SPANS}")


def listed(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "learned")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"), count("learned"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("best_score"),
    )


REPLACEMENT = "[secret]"


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each stretch that spans cover replaced."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], REPLACEMENT]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(documents: DataFrame) -> DataFrame:
    """documents, with all secrets in text replaced and n_chars, if there is such a column, counted anew."""
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents))
    place = documents.columns.index("text")

    @lean
    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else redact(t, all_spans(t, shared.value)) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, "text", pa.array(texts, pa.string()))

    out = documents.mapInArrow(cleaned, documents.schema)
    if "n_chars" not in documents.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(dict(documents.dtypes)["n_chars"]))
