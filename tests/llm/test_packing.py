"""Packing: every id in one piece, sequences gapless and full but for powers of two, levels chosen by the least sum of squares."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.queries import QUERIES
from tessera.llm.shared import read_table

ODD = [
    "", "a  b\n\nc it's ''re ...word.,x", "É́ é́ ΑΣ Σ ÀÇ×÷ ſ K İ", "<|endoftext|> a <|STARTOFTEXT|>", "tab\tsep\x0bx\x1cy z　ok",
    "naïve, über. ß; 日本語テスト ， 12345 a1b2 don't DON'T 'sun o'clock's", "x" * 5000, "a\x85b 👩‍👩‍👧", "Ǆ ﬁ Å ａｂｃ Straße***", "\r\n hi\r", "end_. of-liné é'",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def plain(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def held(pieces, docs, tokenizer, length=packing.LENGTH):
    """Check pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) against docs (doc_id, text) with different ids; the share of padding."""
    ids = {d: plain(tokenizer, t) for d, t in docs}
    own, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["length"] == len(part) > 0 and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    assert set(own) == set(ids)
    for d, parts in own.items():
        parts.sort(key=lambda p: p["start"])
        assert [p["start"] for p in parts] == list(np.cumsum([0] + [p["length"] for p in parts])[:-1]) and sum(p["length"] for p in parts) == len(ids[d])
    padded = 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p["offset"])
        ends = np.cumsum([0] + [p["length"] for p in parts])
        assert [p["offset"] for p in parts] == list(ends[:-1]) and ends[-1] <= length
        padded += 0 if ends[-1] & (ends[-1] - 1) == 0 else length - ends[-1]
    return padded / sum(map(len, ids.values()))


def test_whole_table(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    pieces = QUERIES["op11_packing"](spark, folder)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, folder, "documents").collect()]
    assert held(pieces.collect(), docs, tokenizer) == 0


def test_odd_rows(spark, tokenizer):
    docs = [*enumerate(ODD), (100, None)]
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, length string, Offset int").repartition(3)
    assert held(packing.pack_documents(rows).collect(), docs, tokenizer) == 0
    small = packing.pack_documents(rows, length=8, ids=True).collect()
    assert held(small, docs, tokenizer, 8) == 0
    assert all(len(p["ids"]) == p["length"] <= 8 for p in small)
    with pytest.raises(ValueError):
        packing.pack_documents(rows, length=100)


def test_null_and_repeated_ids(spark, tokenizer):
    rows = spark.createDataFrame([(None, "one two"), (None, "three"), (1, "four"), (1, "four"), (1, None)], "doc_id long, text string")
    pieces = packing.pack_documents(rows).collect()
    expected = sum(len(plain(tokenizer, r["text"])) for r in rows.collect())
    assert sum(p["length"] for p in pieces) == expected and sum(p["doc_id"] is None for p in pieces) >= 2
    assert packing.pack_documents(rows.where("false")).count() == 0


def test_remembered_runs_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    encoder = packing.Encoder(packing.tokenizer_path())
    for text in ODD * 2:
        assert encoder.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_levels_have_the_least_sum_of_squares():
    r = random.Random(5)
    length = 16
    packer = packing.Packer(lambda window: None, length, most=10_000)
    for n in range(400):
        size = r.randint(1, length - 1)
        counts = [0, *(len(w) for w in packer.windows[1:])]

        def squares(level):
            after = counts[:]
            after[level] -= level > 0
            if level + size < length:
                after[level + size] += 1
            return sum(c * c for c in after[1:])

        possible = [h for h in range(length - size + 1) if h == 0 or counts[h]]
        level = packer.level_for(size)
        assert squares(level) == min(map(squares, possible)) and level == max(h for h in possible if squares(h) == squares(level))
        packer.place(n, np.arange(size))


def test_settling_keeps_every_id_and_fills_windows():
    full = []
    packer = packing.Packer(full.append, 16, most=6)
    sizes = [9] * 50 + [40, 16, 1]  # no two of the first fit together
    for n, size in enumerate(sizes):
        packer.place(n, np.arange(size))
        assert packer.open < 6
    packer.finish()
    lengths = [sum(len(ids) for _, _, ids in w) for w in full]
    assert sum(lengths) == sum(sizes) and all(n & (n - 1) == 0 for n in lengths)
    found = defaultdict(list)
    for window in full:
        for n, at, ids in window:
            assert ids.tolist() == list(range(at, at + len(ids)))
            found[n] += ids.tolist()
    assert all(sorted(found[n]) == list(range(size)) for n, size in enumerate(sizes))
