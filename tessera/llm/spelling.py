"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, vocabulary acceptor.

Mohri, "Finite-state transducers in language and speech processing" (1997); Daciuk, Mihov, Watson, Watson, "Incremental construction of minimal
acyclic finite-state automata" (2000). A composed state is (p, q, edited): before the edit both sides have read the same, so p = q; an
edit leads to two states of the acceptor, and from there both sides read the same again, so what follows is in both right languages.

Pairs are enumerated per initial state: words are dealt by their first START code points, and a task builds the minimal acceptor of what
follows them. Every pair has one edit place that counts, the first place at which its words differ.

* It lies behind the first START code points: the words share their initial state, and the pair is found there.
* Otherwise the words end alike, and the pair is found in the same way from the reversed words, where fewer than START code points follow the edit.

An initial state with more than LIMIT words is left by every arc to further initial states, as often as needed. The composition's edits at the state
itself join what is in both right languages by the text without the edited place; a key of that join has one word for each letter at most.

Words are maximal runs of letters A-Z, a-z and U+00C0 to U+00FF with A-Z lowered; where 31 divides the CRC-32 of "doc_id:run", one of the run's code
points is left out before counting (the planted misspellings). Runs are found and counted over Arrow batches of whole texts.

Defined results: a null text has no words; a null doc_id is written as nothing in front of the colon; repeated rows and ids count like others; ties of
forms go to the smaller word in code-point order; no words give no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_broadcast, discard, materialize, slices

# Least length and count of a word, what a form must have more, and the divisor of runs that lose a letter.
LEAST_LENGTH, LEAST_COUNT, TIMES, LOSES = 7, 2, 10, 31
#: Code points of an initial state, and words of one at most. The first must be at most half of LEAST_LENGTH.
START, LIMIT = 3, 10_000
#: States of the acceptors that a task keeps; then it starts anew.
STATES = 1 << 18
#: Bytes of text that are scanned together, and of runs that are hashed together; longer ones are taken by themselves.
CHUNK, TOGETHER = 1 << 22, 64

_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.zeros(256, np.uint32)
for _byte in range(256):
    _CRC[_byte] = reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 * (c & 1)), range(8), _byte)


def _crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CRC-32 of stretches of data, each continuing a CRC of its own."""
    order = np.argsort(-sizes, kind="stable")
    state, begin, size = ~seeds[order], starts[order], sizes[order]
    long = int(np.searchsorted(-size, -TOGETHER))
    for place in range(int(size[long]) if long < len(size) else 0):
        here = slice(long, int(np.searchsorted(-size, -place)))
        state[here] = _CRC[(state[here] ^ data[begin[here] + place]) & np.uint32(255)] ^ (state[here] >> np.uint32(8))
    out = np.empty(len(sizes), np.uint32)
    out[order] = ~state
    for at in order[:long].tolist():
        out[at] = zlib.crc32(data[starts[at] : starts[at] + sizes[at]], int(seeds[at]))
    return out


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of UTF-8 bytes as strings."""
    ends = np.r_[0, np.cumsum(sizes)]
    values = data[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values))


def chunk_words(data: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> pa.Array:
    """All results of at least LEAST_LENGTH code points of texts data[bounds[i]:bounds[i + 1]]; seeds: the CRC-32 of each text's "doc_id:"."""
    lead = np.zeros(len(data) + 1, bool)
    lead[:-1] = data == 0xC3  # U+00C0 to U+00FF are C3 and one more byte
    high = lead[:-1]
    following = np.r_[False, lead[:-2]] if len(data) else high
    inside = _PLAIN[data] | high | following
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside & (~np.r_[True, inside[:-1]] | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (~np.r_[inside[1:], True] | edge[1:])) + 1 if len(data) else starts
    points = ends - starts - np.diff(np.r_[0, np.cumsum(lead)][np.stack([starts, ends])], axis=0)[0]
    kept = points >= LEAST_LENGTH
    starts, ends, points = starts[kept], ends[kept], points[kept]
    low = _LOWER[data]
    own = np.searchsorted(bounds, starts, side="right") - 1
    crcs = _crcs(low, starts, ends - starts, seeds[own])
    losing = crcs % np.uint32(LOSES) == 0
    out = [_gathered(low, starts[~losing], (ends - starts)[~losing])]
    shortened = []
    for a, b, n, crc in zip(starts[losing].tolist(), ends[losing].tolist(), points[losing].tolist(), crcs[losing].tolist()):
        if n > LEAST_LENGTH:
            run = low[a:b].tobytes().decode()
            shortened.append(run[: crc % n] + run[crc % n + 1 :])
    return pa.concat_arrays([*out, pa.array(shortened, pa.large_string())])


def vocabulary(documents: DataFrame) -> DataFrame:
    """word and n of all words, LEAST_COUNT times at least."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            seeds = np.array([zlib.crc32(f"{key}:".encode()) for key in batch.column("key").to_pylist()], np.uint32)
            at = 0
            while at < len(texts):
                to = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1))
                found = pc.value_counts(chunk_words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], seeds[at:to]))
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])
                at = to

    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """Minimal acceptors of several sorted lists of words with states in common, and their composition with one edit."""

    _BITS = 61

    def __init__(self, most: int | None = None):
        """most: code points that may follow an edit."""
        self.most = sys.maxsize if most is None else most
        self.register: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self.shortest: list[int] = []  # length of the shortest word of a right language, and which lengths (modulo _BITS) it has
        self.lengths: list[int] = []
        self.edits: list[list[tuple[str, str]]] = []  # pairs of right parts that an edit in this state gives
        self.below: list[bool] = []  # whether it, or a state after it, has any
        self._meets: dict[tuple[int, int], bool] = {}

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, tuple(arcs))
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.final)
            lengths = int(final)
            for _, to in arcs:
                own = self.lengths[to]
                lengths |= (own << 1 | own >> (self._BITS - 1)) & ((1 << self._BITS) - 1)
            self.final.append(final)
            self.arcs.append(dict(arcs))
            self.shortest.append(0 if final else 1 + min((self.shortest[to] for _, to in arcs), default=0))
            self.lengths.append(lengths)
            self.edits.append(self._edited(final, arcs, self.arcs[-1]))
            self.below.append(bool(self.edits[-1]) or any(self.below[to] for _, to in arcs))
        return state

    def add(self, words: list[str]) -> int:
        """The initial state of an acceptor of sorted, different words."""
        path: list[tuple[list[bool], list[tuple[str, int]]]] = [([False], [])]
        last = ""

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], self._state(final[0], arcs)))

        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            close(same)
            path.extend(([False], []) for _ in word[same:])
            path[-1][0][0] = True
            last = word
        close(0)
        return self._state(path[0][0][0], path[0][1])

    def meets(self, p: int, q: int) -> bool:
        """Whether two right languages have a word in common."""
        if p == q or self.final[p] and self.final[q]:
            return True
        if not self.lengths[p] & self.lengths[q]:
            return False
        key = (p, q) if p < q else (q, p)
        known = self._meets.get(key)
        if known is None:
            other = self.arcs[q]
            known = self._meets[key] = any(c in other and self.meets(to, other[c]) for c, to in self.arcs[p].items())
        return known

    def _common(self, p: int, q: int, most: int, path: list[str], out: list[str]) -> None:
        """All words of both right languages of at most so many code points, each after path."""
        if self.shortest[p] > most or self.shortest[q] > most:
            return
        if self.final[p] and self.final[q]:
            out.append("".join(path))
        if most:
            other = self.arcs[q]
            for c, to in self.arcs[p].items():
                further = other.get(c)
                if further is not None and (to == further or self.meets(to, further)):
                    path.append(c)
                    self._common(to, further, most - 1, path, out)
                    path.pop()

    def _edited(self, final: bool, arcs: list[tuple[str, int]], own: dict[str, int]) -> list[tuple[str, str]]:
        out, most = [], self.most
        near = [(c, to) for c, to in arcs if self.shortest[to] <= most]
        for i, (a, p) in enumerate(near):
            for b, q in near[i + 1 :]:  # one letter for another
                if self.lengths[p] & self.lengths[q] and self.meets(p, q):
                    found: list[str] = []
                    self._common(p, q, most, [], found)
                    out += [(a + s, b + s) for s in found]
            # One letter more: behind it both read the same, which does not begin with that letter.
            if final and self.final[p]:
                out.append((a, ""))
            for c, to in self.arcs[p].items():
                further = own.get(c)
                if c != a and further is not None and most and self.meets(to, further):
                    found = []
                    self._common(to, further, most - 1, [c], found)
                    out += [(a + s, s) for s in found]
        return out

    def pairs(self, state: int) -> list[tuple[str, str]]:
        """All pairs of words of a state's right language with one edit between them."""
        out: list[tuple[str, str]] = []
        path: list[str] = []

        def walk(now: int) -> None:
            if self.edits[now]:
                begin = "".join(path)
                out.extend((begin + x, begin + y) for x, y in self.edits[now])
            for c, to in self.arcs[now].items():
                if self.below[to]:
                    path.append(c)
                    walk(to)
                    path.pop()

        walk(state)
        return out


NEAR = "word string, near string, near_n long"


def _composed(placed: DataFrame, backwards: bool) -> DataFrame:
    """Near pairs, in both directions, of words (word, n, initial) that share their initial state. backwards: words are reversed."""

    def enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(1 << 30)  # a word can be very long; such calls take no native stack
        acceptor, initial, held = None, None, {}

        def found() -> Iterator[pa.RecordBatch]:
            nonlocal acceptor
            if acceptor is None or len(acceptor.final) > STATES:
                acceptor = Acceptor(START - 1 if backwards else None)
            start = len(initial)
            pairs = [(initial + x, initial + y) for x, y in acceptor.pairs(acceptor.add([w[start:] for w in held]))]
            if backwards:  # one of each pair, and those alone that do not begin alike
                pairs = [(x, y) for x, y in pairs if x[-START:] != y[-START:]]
            if pairs:
                pairs += [(y, x) for x, y in pairs]
                turned = [(x[::-1], y[::-1]) for x, y in pairs] if backwards else pairs
                counts = [held[y] for _, y in pairs]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in turned]), pa.array([y for _, y in turned]), pa.array(counts, pa.int64())], names=["word", "near", "near_n"])

        for batch in batches:
            for word, n, key in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "initial"))):
                if key != initial:
                    if len(held) > 1:
                        yield from found()
                    initial, held = key, {}
                held[word] = n
        if len(held) > 1:
            yield from found()

    return placed.repartition("initial").sortWithinPartitions("initial", "word").mapInArrow(enumerated, NEAR)


def _edits_at(words: DataFrame) -> DataFrame:
    """Near pairs of words (word, n, initial, place) of one initial state that differ first at its place, in both directions: words that are the same text without it."""
    at, whole = F.expr("substr(word, place + 1, 1)"), F.struct(F.col("word").alias("rest"), F.lit("").alias("letter"))
    without = F.struct(F.expr("concat(left(word, place), substr(word, place + 2))").alias("rest"), at.alias("letter"))
    forms = F.when(F.length("word") > F.col("place"), F.array(whole, without)).otherwise(F.array(whole))
    rows = words.select("word", "n", "initial", at.alias("at"), F.explode(forms).alias("f"))
    groups = rows.groupBy("initial", "f.rest").agg(F.collect_list(F.struct("f.letter", "at", "word", "n")).alias("x")).where("size(x) > 1")
    pairs = groups.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b")).where("a.letter <> b.letter and a.at <> b.at")
    return pairs.select(F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


#: Code points that two words begin with in common.
_ALIKE = "coalesce(nullif(array_position(zip_with(split(least, ''), split(most, ''), (x, y) -> x = y and x is not null), false), 0) - 1, length(least))"


def _pairs(words: DataFrame, limit: int, backwards: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of near pairs, and the tables that they read.

    The least and the largest word of an initial state with more than limit words tell how far all of them are alike: it is split there.
    """
    rows = words.withColumn("word", F.reverse("word")) if backwards else words
    rows = rows.withColumn("initial", F.substring("word", 1, START))
    placed, found, read = [], [], []
    while True:
        sizes = rows.groupBy("initial").agg(F.count("*").alias("size"), F.min("word").alias("least"), F.max("word").alias("most"))
        large = materialize(sizes.where(F.col("size") > limit).select("initial", F.expr(_ALIKE).cast("int").alias("place")), "initials")
        if large.isEmpty():
            discard(large)
            placed.append(rows)
            break
        marked = bounded_broadcast(large)
        placed.append(rows.join(marked, "initial", "left_anti"))
        split = materialize(rows.join(marked, "initial").select("word", "n", "initial", "place"), "split")
        crossing = _edits_at(split)
        if backwards:
            crossing = crossing.where(F.expr(f"right(word, {START}) <> right(near, {START})"))
            crossing = crossing.select(F.reverse("word").alias("word"), F.reverse("near").alias("near"), "near_n")
        found.append(crossing)
        read += [large, split]
        rows = split.select("word", "n", F.expr("left(word, place + 1)").alias("initial"))
    together = reduce(DataFrame.unionByName, [p.select("word", "n", "initial") for p in placed])
    return [_composed(together, backwards), *found], read


def near_words(words: DataFrame, limit: int | None = None) -> DataFrame:
    """word, near and near_n of all pairs of words (word, n; different, of at least 2 * START code points) at one edit, in both directions; materialized."""
    limit = LIMIT if limit is None else limit
    sides = [_pairs(words, limit, backwards) for backwards in (False, True)]
    out = materialize(reduce(DataFrame.unionByName, [p for pairs, _ in sides for p in pairs]), "near")
    discard(*(table for _, read in sides for table in read))
    return out


def variant_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of words (word, n), which are read several times: materialize them.

    Forms have times as many occurrences each, so a chain of them is short; roots are found by doubling.
    """
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    form = (-F.col("best.m")) >= times * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.m")).alias("form_n"))
    rows = materialize(rows, "forms")
    discard(near)
    chains = materialize(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        # Many words can have one root: broadcast where it is small; a larger join is on the side of the words, which adaptive execution splits.
        new = materialize(chains.join(bounded_broadcast(further), "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")), "roots")
        discard(chains)
        moved = not new.where("moved").isEmpty()
        chains = new
        if not moved:
            break
    return rows.join(chains.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
