"""Sum-of-squares online packing of documents into sequences of a fixed length.

Csirik, Johnson, Kenyon, Orlin, Shor, Weber, "On the sum-of-squares algorithm for bin packing" (2006). A window is a sequence that
is being filled. The level array counts the open windows of every fill level; a document goes to the level for which the sum of the
squared counts afterwards is least (an empty window is level 0, full ones do not count; ties go to the fullest window). Full
lengths of a longer document are sequences of their own and the rest is placed.

Every task packs its own rows as they come, so nothing is shuffled, and holds the ids of its open windows alone. Windows that are
still open when the task ends, or when OPEN of them are, are settled: the emptiest are taken apart, and their pieces are cut to fill the
fullest to the end. What is left is less than one sequence; at the task's end it is cut into lengths that are powers of two, which
need no padding.

Ids come from the tokenizer of a file that every executor has. It drops white space and handles what lies between by itself, so each
distinct run of other characters is encoded once by a task and looked up from then on.

Defined results: a null text is empty and has the end id alone; equal ids and repeated rows are documents like any other; an empty
table gives no rows; other columns are not read. Texts are read whole. sequence_id follows from the partition and the order in it.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import slices

LENGTH = 4096
#: The id that ends every document.
END = 2
#: Open windows at which a task settles them.
OPEN = 2048
#: Distinct runs of characters that a worker remembers at most; then it starts anew. A matter of speed only.
REMEMBERED = 1 << 21
#: Bare words that are encoded in one call.
AT_ONCE = 4096

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as the tokenizer gives them, without its own special ids.

    Lower case is the tokenizer's own; here A-Z alone are lowered before the look-up, which changes nothing but for texts
    that name a special token ("<|"); those are encoded as they are.
    """

    #: A word of letters that normalisation at most lowers, and the run of marks after it; the tokenizer parts them there.
    BARE = re.compile(r"([a-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, runs: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(runs, range(len(self.known), len(self.known) + len(runs))))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of runs, one after the other."""
        size = self.size[rows]
        to = np.cumsum(size)
        return self.flat[np.arange(to[-1] if len(to) else 0) + np.repeat(self.begin[rows] - to + size, size)]

    def _plain(self, runs: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch(runs, add_special_tokens=False)]

    def learn(self, runs: list[str]) -> None:
        matched = [(run, self.BARE.fullmatch(run)) for run in runs]
        others = list({m.group(2) if m else run for run, m in matched}.difference(self.known))
        plain = self._plain(others)
        self._add(others, np.concatenate([np.zeros(0, np.int32), *plain]), np.fromiter(map(len, plain), np.int64, len(plain)))
        words = list({m.group(1) for _, m in matched if m}.difference(self.known))
        for at in range(0, len(words), AT_ONCE):  # many in one call: the tokenizer says which word each id belongs to
            part = words[at : at + AT_ONCE]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            self._add(part, np.array(found.ids, np.int32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
        marked = [m for _, m in matched if m and m.group(2)]
        if marked:
            both = np.array([self.known[x] for m in marked for x in m.groups()])
            self._add([m.group() for m in marked], self._gather(both), self.size[both].reshape(-1, 2).sum(1))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget()
        cut = [None if "<|" in t else t.encode().lower().decode().replace("\n", " ").split(" ") for t in texts]
        fresh = set().union(*(c for c in cut if c is not None)).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        out = []
        for text, runs in zip(texts, cut):
            if runs is None:
                out += self._plain([text])
                continue
            out.append(self._gather(np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))))
        return out


class Packer:
    """Windows of one task. A piece is (document, its place in the document, ids); full windows go to emit as lists of pieces."""

    def __init__(self, emit, length: int = LENGTH, most: int = OPEN):
        self.emit, self.length, self.most, self.open = emit, length, most, 0
        self.windows: list[list[list]] = [[] for _ in range(length)]
        # Twice the counts, with ends that make an empty window and a full one come out right; and the same where there is a window to take, else -inf.
        self.after = np.zeros(length + 1)
        self.after[0], self.after[length] = 1, -1
        self.taken = np.full(length, -np.inf)
        self.taken[0] = 1

    def _count(self, level: int, by: int) -> None:
        self.after[level] += 2 * by
        self.taken[level] = self.after[level] if self.after[level] else -np.inf
        self.open += by

    def level_for(self, size: int) -> int:
        """The fill level at which size more make the least sum of squared counts."""
        change = self.after[size:] - self.taken[: self.length - size + 1]
        return len(change) - 1 - int(change[::-1].argmin())

    def place(self, document, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.length
        for at in range(0, whole, self.length):
            self.emit([(document, at, ids[at : at + self.length])])
        if whole < len(ids):
            self._put((document, whole, ids[whole:]))
            if self.open >= self.most:
                self.settle()

    def _put(self, piece: tuple) -> None:
        level = self.level_for(len(piece[2]))
        window = []
        if level:
            window = self.windows[level].pop()
            self._count(level, -1)
        window.append(piece)
        level += len(piece[2])
        if level == self.length:
            self.emit(window)
        else:
            self.windows[level].append(window)
            self._count(level, 1)

    def settle(self) -> None:
        """Fill the fullest open windows with pieces of the emptiest; one that is not full stays open at most."""
        levels = [(level, window) for level, own in enumerate(self.windows) for window in own]
        for level, _ in levels:
            self.windows[level].clear()
        self.after[1:-1], self.taken[1:], self.open = 0, -np.inf, 0
        low, high, loose, room = 0, len(levels) - 1, [], 0
        while low <= high:
            level, window = levels[high]
            high -= 1
            room = self.length - level
            while room and (loose or low <= high):
                if not loose:
                    loose = levels[low][1]
                    low += 1
                document, at, ids = loose.pop()
                window.append((document, at, ids[:room]))
                if len(ids) > room:
                    loose.append((document, at + room, ids[room:]))
                room -= len(window[-1][2])
            if room:
                self.windows[self.length - room].append(window)
                self._count(self.length - room, 1)
            else:
                self.emit(window)
        if loose:  # what is left of the last window that was taken apart
            level = sum(len(ids) for _, _, ids in loose)
            self.windows[level].append(loose)
            self._count(level, 1)

    def finish(self) -> None:
        """Settle, and cut the rest into lengths that are powers of two."""
        self.settle()
        rest = [piece for own in self.windows for window in own for piece in window]
        left = sum(len(ids) for _, _, ids in rest)
        for bit in reversed(range(left.bit_length())):
            room, window = left & 1 << bit, []
            while room:
                document, at, ids = rest.pop()
                window.append((document, at, ids[:room]))
                if len(ids) > room:
                    rest.append((document, at + room, ids[room:]))
                room -= len(window[-1][2])
            if window:
                self.emit(window)


_loaded: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def pack_documents(documents: DataFrame, path: str | None = None, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id and the columns of SCHEMA, with ids the piece's ids (array of int) as well.

    start and doc_tokens count ids of the piece's document, the end id included; offset is the piece's place in its sequence. A sequence is
    of at most length ids, which must be a power of two.
    """
    if length & length - 1:
        raise ValueError("length must be a power of two")
    path = path or tokenizer_path()
    kind = dict(documents.dtypes)["doc_id"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ready, sequence, key_type = _encoder(path), [], TaskContext.get().partitionId() << 32, None

        def emit(window: list) -> None:
            nonlocal sequence
            offset = 0
            for (key, tokens), at, own in window:
                ready.append((key, at, len(own), zlib.crc32(own.astype("<u4").tobytes()), tokens, sequence, offset, own if ids else None))
                offset += len(own)
            sequence += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*ready)) if ready else [[]] * 8
            ready.clear()
            arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            names = ["doc_id", *(field.split()[0] for field in SCHEMA.split(", "))]
            if ids:
                arrays, names = [*arrays, pa.array(columns[7], pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        packer = Packer(emit, length)
        for part in slices(batches, 256):
            key_type = part.schema.field("doc_id").type
            rows = encoder.encode(part.column("text").to_pylist())
            for key, own in zip(part.column("doc_id").to_pylist(), rows):
                packer.place((key, len(own) + 1), np.append(own, np.int32(END)))
            if ready:
                yield batch()
        packer.finish()
        if ready:
            yield batch()

    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(packed, f"doc_id {kind}, {SCHEMA}" + (", ids array<int>" if ids else ""))
