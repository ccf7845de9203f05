"""Shingle sets of whole texts, computed over Arrow batches with numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A set holds a
64-bit fingerprint for each distinct run of five words; a text of one to four words has one
fingerprint, of the whole sequence; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text that are fingerprinted together; a longer text is taken by itself.
CHUNK = 1 << 19

_draw = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _draw.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _draw.integers(0, 2**64, WIDTH, dtype=np.uint64) | np.uint64(1)
_SHORT = _draw.integers(0, 2**64, WIDTH, dtype=np.uint64)
_BASE = int(_draw.integers(0, 2**63)) * 2 + 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_of_base(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) <= n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, CHUNK) + 1, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = made[0], made[1]
    return _powers


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and for each text where its words begin (one more entry ends the last)."""
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    gap = np.ones(n + 2, dtype=bool)
    gap[1:-1] = _SPACE[data]
    word = ~gap[1:-1]
    starts = np.flatnonzero(word & (gap[:-2] | edge[:-1]))
    ends = np.flatnonzero(word & (gap[2:] | edge[1:])) + 1
    up, down = _powers_of_base(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, bounds)


def chunk_sets(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted set of each text data[bounds[i]:bounds[i + 1]]."""
    words, first = word_hashes(data, bounds)
    whole = np.zeros(0, np.uint64)
    if len(words) >= WIDTH:
        m = len(words) - WIDTH + 1
        whole = words[:m] * _PLACE[0]
        for i in range(1, WIDTH):
            whole += words[i : m + i] * _PLACE[i]
        whole = mix(whole)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WIDTH:
            own = np.sort(whole[a : b - WIDTH + 1])
            distinct = np.empty(len(own), dtype=bool)
            distinct[0] = True
            np.not_equal(own[1:], own[:-1], out=distinct[1:])
            yield own[distinct]
        elif b > a:
            yield mix(np.sum(words[a:b] * _PLACE[: b - a], keepdims=True) + _SHORT[b - a : b - a + 1])
        else:
            yield words[:0]


def batch_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of each text of a binary Arrow array; null counts as empty."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        to = min(to, len(texts))
        yield from chunk_sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
