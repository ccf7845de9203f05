"""Spelling variants against brute force: the whole small table, odd texts, split initial states, long words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import spelling
from tessera.llm.queries import QUERIES
from tessera.llm.shared import materialize, read_table

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def groups(counts):
    """All rows by the definition; candidates by the texts without one code point, each checked."""

    def one_edit(a, b):
        a, b = sorted((a, b), key=len)
        if a == b or len(b) - len(a) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[i + (len(a) == len(b)) :] == b[i + 1 :]

    by_rest = defaultdict(set)
    for w in counts:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_rest[rest].add(w)
    near = {w: {v for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in by_rest[rest] if one_edit(w, v)} for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def rows_of(frame):
    got = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, folder, "documents").collect()]
    assert rows_of(QUERIES["op13_spelling_variants"](spark, folder)) == groups(words_of(docs))


def vocabulary(seed, n=700):
    r = random.Random(seed)
    made = set()
    while len(made) < n:
        base = "".join(r.choice("aabéz") for _ in range(r.randint(7, 9)))
        made.add(base)
        at = r.randrange(len(base))
        made |= {base[:at] + base[at + 1 :] + "a" * (len(base) < 8), base[:at] + r.choice("abéz") + base[at:], base[:at] + "z" + base[at + 1 :]}
    return {w: r.choice([2, 3, 30, 400, 5000]) for w in made if len(w) >= 7}


@pytest.mark.parametrize("limit", [10_000, 20, 1])
def test_split_initial_states(spark, monkeypatch, limit):
    monkeypatch.setattr(spelling, "LIMIT", limit)
    counts = vocabulary(limit) | {"x" * 400 + "y" * 900: 2, "x" * 400 + "y" * 901: 50, "x" * 399 + "zy" * 4: 3, "aaaaaaa": 4, "aaaaaaaa": 41}
    words = materialize(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5), "test-words")
    assert rows_of(spelling.variant_groups(words)) == groups(counts)


def test_texts(spark):
    r = random.Random(2)
    pieces = ["Straße", "GRÖSSE", "Éclair", "abcdefgh", "ABCDEFGHI", "naïveté", "×÷×÷×÷×", "wörterbuch", "wörterbuuch", "日本語", "don't", "ābcdefghij", "x" * 300, "é" * 90]
    docs = [(n, " ".join(r.choices(pieces, k=40)) + r.choice(["", "\n", "1"])) for n in range(300)] + [(None, "straßen " * 9), (7, None), (7, ""), (5, "abcdefgh"), (5, "abcdefgh"), (1, "ab" * 60_000)] * 2
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, N int").repartition(3)
    words = materialize(spelling.vocabulary(frame), "test-words")
    expected = words_of(docs)
    assert {tuple(x) for x in words.collect()} == set(expected.items())
    assert rows_of(spelling.variant_groups(words)) == groups(expected)


def test_no_words(spark):
    frame = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    for docs in (frame, frame.where("false")):
        words = materialize(spelling.vocabulary(docs), "test-words")
        assert spelling.variant_groups(words).collect() == []


def test_acceptors_are_minimal():
    acceptor = spelling.Acceptor()
    first = acceptor.add(sorted(["walking", "walked", "talking", "talked"]))
    # w and t lead to one state, ed and ing end in one.
    assert len(acceptor.final) == len({"", "g", "ng", "d", "ed|ing", "k", "lk", "alk", "walk|talk"}) and acceptor.pairs(first)
    before = len(acceptor.final)
    assert acceptor.add(sorted(["walking", "walked", "talking", "talked"])) == first and len(acceptor.final) == before
