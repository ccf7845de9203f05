"""Runs of every length are scored, and what base spans leave of a run is a candidate of its own."""

import random

from tessera.llm import secrets


def grammars():
    r = random.Random(3)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(r.randint(24, 64))) for _ in range(300)]
    ordinary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(4, 30))) for _ in range(400)]
    return secrets.fit({"hex": hexes}, ordinary), r


def test_long_runs_are_scored():
    found, r = grammars()
    for n in (40, secrets.LONGEST + 1, 5000):
        key = "".join(r.choice("0123456789ABCDEF") for _ in range(n))
        assert secrets.all_spans(f"key {key} end", found) == [(4, 4 + n, "learned")]
        assert secrets.redact(f"key {key} end", secrets.all_spans(f"key {key} end", found)) == f"key {secrets.REPLACEMENT} end"


def test_stretches_beside_base_spans_are_scored():
    found, r = grammars()
    key = ["A" + "".join(r.choice("0123456789ABCDEF") for _ in range(38)) + "F" for _ in range(2)]
    low = "a" + "".join(r.choice("0123456789abcdef") for _ in range(30)) + "f"
    text = f"see {key[0]}-{low}.{key[1]} and {low} {key[0]} /{low} x"
    at = [text.index(key[0]), text.index(low), text.index(key[1])]
    spans = secrets.all_spans(text, found)
    assert spans[:3] == [(at[0], at[0] + 40, "learned"), (at[1], at[1] + 32, "hex"), (at[2], at[2] + 40, "learned")]
    assert [k for *_, k in spans[3:]] == ["hex", "learned", "hex"]
    assert key[0] not in (clean := secrets.redact(text, spans)) and key[1] not in clean and low not in clean


def test_overlapping_base_spans():
    found, _ = grammars()
    text = "token=" + "a1" * 20 + "AKIA" + "Q" * 20
    assert [s for s in secrets.all_spans(text, found) if s[2] != "learned"] == secrets.base_spans(text)
    assert secrets.redact(text, secrets.all_spans(text, found)) == secrets.REPLACEMENT
