"""Quality classification by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A whole text
is cut into blocks, and every block is compressed by itself with either dictionary: short blocks keep the
dictionary, and not the text's own history, in charge. Two numbers are left, over the whole text:

    difference = (bad size - good size) / (bad size + good size)
    ratio      = good size / bytes

and a logistic curve over them, fitted on labelled rows that the dictionaries have not seen, turns them into the
probability of label 1. The ratio tells text that any dictionary compresses well (endless
repetition), for which the difference has little to say.

Defined results: a null or empty text has difference 0 and ratio 1; labels outside 0 and 1, or null,
are not learned from; if one class has no labelled row, every score is the share of label 1 (1/2 without
any label); several labels for a doc_id, or several rows of it, each count as a row; equal texts have equal scores; very long texts are
scored whole, and left out of the fit; other columns are kept or not read, whatever they are called; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import lean, slices, unused

BLOCK = 2048
LEVEL = 3
DICTIONARY_BYTES = 64 * 1024
#: Bounds of the labelled sample that is fitted on the driver: rows for each class, and bytes of a text.
FIT_ROWS, FIT_BYTES = 2000, 32 * 1024
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def terms(difference: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    d, r = 10 * difference, 3 * ratio
    return np.stack([np.ones_like(d), d, r, r * r, d * r], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: list[float]
    constant: float | None = None
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": []}

    def _compressors(self) -> list:
        if not self._made:
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
                d.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._made

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        good, bad = self._compressors()
        g = np.array([sum(len(good.compress(b)) for b in blocks(t)) for t in texts], dtype=float)
        b = np.array([sum(len(bad.compress(b)) for b in blocks(t)) for t in texts], dtype=float)
        n = np.array([len(t) for t in texts], dtype=float)
        return (b - g) / np.maximum(g + b, 1), np.where(n > 0, g / np.maximum(n, 1), 1.0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        return 1 / (1 + np.exp(-np.clip(terms(*self.features(texts)) @ np.array(self.weights), -30, 30)))


def fit(rows: list[tuple[int, bytes, int]]) -> CompressionModel:
    """Rows are (doc_id, text, label). Half of them build the dictionaries, the others the curve."""
    n, ones = len(rows), sum(label for _, _, label in rows)
    if not 0 < ones < n:
        return CompressionModel(b"", b"", [], ones / n if n else 0.5)
    by_class = {label: sorted((zlib.crc32(f"half {key}".encode()), text) for key, text, x in rows if x == label) for label in (0, 1)}
    for label, own in by_class.items():
        by_class[label] = [text for _, text in own]
    raw, curve_x, curve_y = {}, [], []
    for label, own in by_class.items():
        samples = [b for text in own[::2] for b in blocks(text)]
        try:
            raw[label] = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples to select from: their text itself is the dictionary
            raw[label] = b"".join(samples)[-DICTIONARY_BYTES:]
        rest = own[1::2] or own
        curve_x += rest
        curve_y += [label] * len(rest)
    model = CompressionModel(raw[1], raw[0], [])
    model.weights = [float(w) for w in fit_logistic(terms(*model.features(curve_x)), np.array(curve_y, dtype=float))]
    return model


def learn(documents: DataFrame, labels: DataFrame) -> CompressionModel:
    """Fit on a bounded sample: for each class the FIT_ROWS rows of lowest hashed id whose text has at most FIT_BYTES.

    Classes are sampled at one rate, so that the curve sees their true shares.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("quality").cast("int").alias("label"), F.xxhash64("doc_id").alias("at"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = min(1.0, FIT_ROWS / max([1, *counts.values()]))
    picked = known.where(F.pmod("at", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("at").limit(2 * FIT_ROWS)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).where(F.octet_length("text") <= FIT_BYTES)
    # An id can stand for many rows: the sample is bounded once more.
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label").orderBy(F.xxhash64("doc_id", "text"), "label").limit(2 * FIT_ROWS).collect()
    return fit(sorted((r["doc_id"], bytes(r["text"]), r["label"]) for r in rows))


def with_scores(documents: DataFrame, model: CompressionModel, score: str, *keep: str) -> DataFrame:
    """The columns keep, and the new column score, of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    whole = unused("whole", documents.columns)
    rows = documents.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias(whole))
    schema = documents.select(*keep, F.lit(0.0).alias(score)).schema

    @lean
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in slices(batches):
            values = pa.array(found.score(batch.column(whole).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), values], names=[*keep, score])

    return rows.mapInArrow(scored, schema)


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = with_scores(documents, learn(documents, labels), "score", "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents, with their columns, whose score reaches the threshold."""
    score = unused("score", documents.columns)
    scored = with_scores(documents, learn(documents, labels), score, *documents.columns)
    return scored.where(F.col(score) >= THRESHOLD).select(*documents.columns)
