"""SentencePiece encoding and decoding by suffix-array matching, for BPE models.

The texts of a batch are cut where no piece can reach across (before a run of word marks, around
characters that occur in no piece), and the distinct segments are concatenated. A suffix array over
that text, as deep as the longest piece, is searched for all pieces at once; the occurrence ranges
become edges (position, length, piece), which are sorted by position into a table. The relaxation goes over
this table: BPE does not minimise a path's cost but takes, again and again, the best edge that joins two
neighbouring symbols, leftmost first, so that is what each step does, for all segments together.
Characters without a piece become byte pieces.

Decoding joins the pieces' bytes, turns marks into spaces and drops the first, which encoding added.

Only models with the identity normaliser, a dummy prefix and byte fallback are accepted.

Defined results: a null or empty text has no ids; a text with U+2581 decodes with spaces in its
place, as in the reference library, and is marked as not round-trip; control names such as <s> inside a text are
ordinary text; repeated rows are encoded alike; very long texts are encoded whole, by themselves; other columns are not read; no
rows give no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import lean, slices, unused

MARK = "▁"
#: Where the public vocabulary file is looked for if no path is given.
MODEL_NAME = "piece_bpe_32k.model"
#: Characters indexed together, segments remembered by a task, and the length from which a segment is relaxed by itself.
INDEX_CHARS, MEMORY, LONG = 1 << 17, 1 << 18, 96
_CODES = 1 << 16


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL_NAME)


class _Segments(dict):
    """Numbers segments in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


@dataclass
class Vocabulary:
    """What encoding needs of a model: texts, ids and ranks of its ordinary pieces, and the byte pieces."""

    texts: list[str]
    ids: np.ndarray  # by rank: best first
    byte_ids: np.ndarray
    output: list[bytes]  # by id

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            raw = f.read()
        proto.ParseFromString(raw)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        if spec.model_type != spec.BPE or not spec.byte_fallback or spec.treat_whitespace_as_suffix or not plain:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and the identity normaliser can be encoded")
        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        size = model.get_piece_size()
        byte_ids = np.zeros(256, np.int32)
        output, ordinary = [b""] * size, []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                output[i] = bytes([int(piece[1:-1], 16)])
            elif not model.is_control(i) and not model.is_unknown(i):
                ordinary.append((-model.get_score(i), i, piece))
                output[i] = piece.replace(MARK, " ").encode()
        ordinary.sort()
        return cls([p for _, _, p in ordinary], np.array([i for _, i, _ in ordinary], np.int32), byte_ids, output)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        alphabet = sorted(set("".join(v.texts)))
        if len(alphabet) >= _CODES - 2:
            raise ValueError("the pieces have too many different characters")
        #: Code points to dense codes; 1 stands for a character of no piece, 0 for the end of a segment.
        self.code = np.ones(0x110000, np.uint16)
        self.code[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
        self.depth = max(4, -(-max(map(len, v.texts)) // 4) * 4)
        self.lengths = np.array([len(p) for p in v.texts])
        low = np.zeros((len(v.texts), self.depth), np.uint16)
        for row, piece in zip(low, v.texts):
            row[: len(piece)] = self.code[[ord(c) for c in piece]]
        high = np.where(np.arange(self.depth) < self.lengths[:, None], low, _CODES - 1).astype(np.uint16)
        self.low, self.high = self._keys(low), self._keys(high)
        outside = "".join(c for c in "\n\t\r" if c not in set(alphabet))
        inner = re.escape(MARK + outside)
        # A mark after another character begins a segment, as no piece has a mark but at its start.
        if any(MARK in p.lstrip(MARK) for p in v.texts):
            raise ValueError("pieces with inner marks are not supported")
        self.segments = re.compile((f"[{re.escape(outside)}]|" if outside else "") + f"{MARK}*[^{inner}]+|{MARK}+").findall
        self.forget()

    def forget(self) -> None:
        """Drop the segments encoded so far."""
        self.seen = _Segments()
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def _keys(codes: np.ndarray) -> list[np.ndarray]:
        """Four codes to a 64-bit number, so that the numbers order as the code sequences do."""
        wide = codes.astype(np.uint64)
        return [(wide[:, i] << np.uint64(48)) | (wide[:, i + 1] << np.uint64(32)) | (wide[:, i + 2] << np.uint64(16)) | wide[:, i + 3] for i in range(0, codes.shape[1], 4)]

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """Table [position, length - 1] of the rank + 1 of the piece there, 0 for none; codes end with depth zeros."""
        n = len(codes) - self.depth
        wide = codes.astype(np.uint64)
        four = (wide[:-3] << np.uint64(48)) | (wide[1:-2] << np.uint64(32)) | (wide[2:-1] << np.uint64(16)) | wide[3:]
        keys = [four[i : i + n] for i in range(0, self.depth, 4)]
        suffixes = np.lexsort(keys[::-1])
        ordered = [k[suffixes] for k in keys]

        def bound(wanted: list[np.ndarray], after: bool) -> np.ndarray:
            """Binary search of all pieces at once: the first suffix not before, or after, the wanted keys."""
            lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    return lo
                mid = (lo[open_] + hi[open_]) // 2
                less, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
                for have, want in zip(ordered, wanted):
                    h, w = have[mid], want[open_]
                    less |= equal & (h < w)
                    equal &= h == w
                right = less | equal if after else less
                lo[open_[right]] = mid[right] + 1
                hi[open_[~right]] = mid[~right]

        first, last = bound(self.low, False), bound(self.high, True)
        count = last - first
        piece = np.repeat(np.arange(len(count)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        table = np.zeros((n, self.depth), np.uint16 if len(count) < _CODES - 1 else np.int32)
        # Storing by position sorts the edges: each (position, length) has one piece at most.
        table[suffixes[at], self.lengths[piece] - 1] = piece + 1
        return table

    def relax(self, table: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Start of every symbol after all merges; bounds: where segments begin, and the end."""
        n = len(table)
        alive = np.ones(n + 1, bool)
        segment = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        active = np.flatnonzero((np.diff(bounds) > 1) & (np.diff(bounds) <= LONG))
        is_active = np.zeros(len(bounds) - 1, bool)
        is_active[active] = True
        starts = np.flatnonzero(is_active[segment])
        while len(starts):
            own = segment[starts]
            # Ends of symbols: the next start in the segment, or the segment's end.
            last = np.ones(len(starts), bool)
            last[:-1] = own[1:] != own[:-1]
            ends = np.empty(len(starts), np.int64)
            ends[:-1] = starts[1:]
            ends[last] = bounds[own[last] + 1]
            left = np.flatnonzero(~last)
            span = ends[left + 1] - starts[left]
            fits = span <= self.depth
            left, span = left[fits], span[fits]
            rank = table[starts[left], span - 1].astype(np.int64)
            left, rank = left[rank > 0], rank[rank > 0]
            if not len(left):
                break
            heads = np.flatnonzero(np.r_[True, own[left][1:] != own[left][:-1]])
            best = np.minimum.reduceat((rank << 32) | left, heads) & 0xFFFFFFFF
            gone = best + 1
            alive[starts[gone]] = False
            going = np.zeros(len(bounds) - 1, bool)
            going[own[best]] = True
            keep = going[own]
            keep[gone] = False
            starts = starts[keep]
        for s in np.flatnonzero(np.diff(bounds) > LONG).tolist():
            self._relax_long(table, int(bounds[s]), int(bounds[s + 1]), alive)
        return np.flatnonzero(alive[:n])

    def _relax_long(self, table: np.ndarray, begin: int, end: int, alive: np.ndarray) -> None:
        """The same for one long segment, with a heap of the edges that join two symbols."""
        after, before = {i: i + 1 for i in range(begin, end)}, {i: i - 1 for i in range(begin, end)}
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            middle = after[i]
            if i >= begin and middle < end and (span := after[middle] - i) <= self.depth and (rank := int(table[i, span - 1])):
                heapq.heappush(heap, (rank, i, i + span))

        for i in range(begin, end):
            offer(i)
        while heap:
            _, i, to = heapq.heappop(heap)
            if i not in after or (middle := after[i]) >= end or after[middle] != to:
                continue
            alive[middle] = False
            after[i] = to
            del after[middle]
            if to < end:
                before[to] = i
            offer(i)
            if before[i] >= begin:
                offer(before[i])

    def _learn(self, fresh: list[str]) -> None:
        """Encode new segments and add their ids to flat and ends."""
        at = 0
        while at < len(fresh):
            to, chars = at, 0
            while to < len(fresh) and (to == at or chars + len(fresh[to]) < INDEX_CHARS):
                chars += len(fresh[to]) + 1
                to += 1
            self._index(fresh[at:to])
            at = to

    def _index(self, segments: list[str]) -> None:
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        points = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[points]
        begins = np.cumsum(lengths + 1) - lengths - 1
        codes[begins + lengths] = 0
        inside = np.ones(len(points), bool)
        inside[begins + lengths] = False
        table = self.edges(np.concatenate([codes, np.zeros(self.depth, np.uint16)]))[inside]
        points, bounds = points[inside], np.r_[0, np.cumsum(lengths)]
        starts = self.relax(table, bounds)
        ends = np.r_[starts[1:], len(points)]
        rank = table[starts, ends - starts - 1].astype(np.int64)
        known = rank > 0
        sizes = np.ones(len(starts), np.int64)
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in points[starts[~known]].tolist()]
        sizes[~known] = [len(b) for b in spelled]
        to = np.cumsum(sizes)
        ids = np.empty(to[-1] if len(to) else 0, np.int32)
        ids[(to - sizes)[known]] = self.vocabulary.ids[rank[known] - 1]
        is_byte = np.ones(len(ids), bool)
        is_byte[(to - sizes)[known]] = False
        ids[is_byte] = self.vocabulary.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        first = np.searchsorted(starts, bounds)
        edge = np.r_[0, to][first]
        self.ends = np.concatenate([self.ends, self.ends[-1] + edge[1:]])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.seen) > MEMORY:
            self.forget()
        before, number = len(self.seen), self.seen.__getitem__
        rows = []
        for text in texts:
            cut = self.segments(MARK + text.replace(" ", MARK)) if text else []
            rows.append(np.fromiter(map(number, cut), np.int64, len(cut)))
        if len(self.seen) > before:
            fresh = list(self.seen)[before:]
            self._learn(fresh)
        out = []
        for row in rows:
            begin, size = self.ends[row], self.ends[row + 1] - self.ends[row]
            to = np.cumsum(size)
            index = np.arange(to[-1] if len(to) else 0) + np.repeat(begin - to + size, size)
            out.append(self.flat[index])
        return out

    def decode(self, ids: np.ndarray) -> str:
        output = self.vocabulary.output
        return b"".join([output[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


_loaded: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(Vocabulary.load(path))
    return _loaded[path]


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every document. path: a model file that every executor has."""
    path = path or model_path()
    kind = dict(documents.dtypes)["doc_id"]

    @lean
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            rows = encoder.encode(texts)
            same = [encoder.decode(ids) == (text or "") for ids, text in zip(rows, texts)]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"])
        encoder.forget()

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(encoded, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds the text that ids stand for; null ids give a null text."""
    path = path or model_path()
    text = unused("text", encoded.columns)
    schema = encoded.withColumn(text, F.lit(None).cast("string")).schema

    @lean
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(path).decode
        for batch in slices(batches):
            texts = [None if ids is None else decode(np.array(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return encoded.mapInArrow(decoded, schema)
