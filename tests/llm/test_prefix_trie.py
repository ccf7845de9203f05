"""The trie against one built in plain Python, on the whole table, hot keys and odd rows; list ranking and running sums in small parts."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import list_ranking, prefix_trie
from tessera.llm.queries import QUERIES
from tessera.llm.scans import running
from tessera.llm.shared import read_table

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(turns):
    """Ordered (role, text) of each conv_id; equal turns must be equal in all."""
    found = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(own)] for c, own in found.items()}


def rebuilt(found):
    out = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = found.get(c - c % 100, [])[:h] + own[h:]
    return out


def trie(found):
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in found.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
        ends[tuple(own)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        saved[node] = (len(members[node]) - 1) * len(node[-1][1] if node else "") + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
    rows = set()
    for node, own in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        rows.add((min(own), len(node), parent, len(own), len(children[node]), leaves[node], saved[node], digest))
    return rows


def rows_of(frame):
    got = [tuple(r) for r in frame.select(COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in read_table(spark, folder, "conversations").collect()]
    assert rows_of(QUERIES["op12_prefix_trie"](spark, folder)) == trie(rebuilt(conversations(turns)))


def odd_turns():
    r = random.Random(3)
    turns = []
    for c in [*range(0, 40), *range(198, 212), 305, 1 << 60, -5, -103]:  # 305: its family has no first conversation
        for t in range(r.randint(1, 9)):
            turns.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None, "ünï" * 50])))
    turns += [(7, None, "user", "first"), (8, 2, "user", "again"), (8, 2, "user", "again"), (None, 1, "user", "lost")]
    turns += [(500, t, "user", "long") for t in range(400)] + [(c, 0, "user", "common") for c in range(600, 900)]
    return turns


@pytest.mark.parametrize("last", [8192, 5])
def test_odd_rows(spark, monkeypatch, last):
    monkeypatch.setattr(list_ranking, "LAST", last)
    # Rows of one turn number with different texts have an order of their own; here they are the same or alone.
    turns = list({(c, t): row for row in odd_turns() if (row[0], row[1]) != (8, 2) for c, t in [row[:2]]}.values()) + [(8, 2, "user", "again")] * 2
    frame = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, Depth int, k1 string").repartition(5)
    ordered = prefix_trie.ordered_turns(frame)
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.rebuilt(ordered))) == trie(rebuilt(conversations(turns)))
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.sequences(ordered))) == trie(conversations(turns))


def test_no_conversations(spark):
    empty = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    for rows in (empty, empty.where("false")):
        assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.ordered_turns(rows))).collect() == []


def test_ties_have_one_order(spark):
    turns = spark.createDataFrame([(1, 0, "user", t) for t in "abcdefgh"], "conv_id long, turn long, role string, text string")
    orders = [[tuple(r) for r in prefix_trie.ordered_turns(turns.orderBy(F.rand(seed))).orderBy("position").collect()] for seed in (1, 2)]
    assert orders[0] == orders[1] and len({r[2] for r in orders[0]}) == 8


def test_long_lists_of_ends_are_cut(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    turns = [(c, 0, "user", "same") for c in range(1, 99)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.sequences(prefix_trie.ordered_turns(frame)))) == trie(conversations(turns))


def test_list_ranking(spark):
    r = random.Random(8)
    ids = [(i, i % 3) for i in range(500)]
    r.shuffle(ids)
    links = [(*x, *y, f"v{n}") for n, (x, y) in enumerate(zip(ids, ids[1:]))] + [(*ids[-1], None, None, "v499")]
    frame = spark.createDataFrame(links, "a long, b long, next_a long, next_b long, v string").repartition(4)
    for last in (1, 40, 10_000):
        found = list_ranking.list_rank(frame, last).collect()
        assert {r["position"]: (r["a"], r["b"], r["v"]) for r in found} == {n: (*x, f"v{n}") for n, x in enumerate(ids)}


def test_running_sums_cross_partitions(spark):
    r = random.Random(4)
    big = (1 << 63) - 1
    rows = [(r.choice([1, 1, 1, 2, 3, 9]), n, r.choice([1, big, -7])) for n in range(3000)]
    frame = spark.createDataFrame(rows, "g long, n long, v long").repartition(7)
    found = {r["n"]: r for r in running(frame, ["g"], [F.col("n").desc()], ["v"], ["n", "v"]).collect()}
    total, last = defaultdict(int), {}
    for g, n, v in sorted(rows, key=lambda x: -x[1]):
        total[g] = (total[g] + v + (1 << 63)) % (1 << 64) - (1 << 63)
        assert (found[n]["v_sum"], found[n]["n_previous"], found[n]["v_previous"]) == (total[g], *last.get(g, (None, None)))
        last[g] = n, v
