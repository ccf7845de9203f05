"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models. Each sees the counts of its own vocabulary of telling
words and word beginnings, and the probabilities of all earlier categories; the last one, toxic, decides. In training those
probabilities are out-of-fold: for each fold a vocabulary is chosen and a model fitted without its rows, so a
later model learns how far to trust an earlier one.

The labels know two marks; the chain's categories are made of nothing else:

    junk           of low quality
    toxic_junk     marked toxic, and of low quality
    toxic_prose    marked toxic, and not of low quality
    toxic          marked toxic

Words are runs of letters of the lower-cased text. A vocabulary holds words, and beginnings of words (written with
a star), whose shares of rows with and without the category differ significantly.

Defined results: a null or empty text has the probabilities of a text without telling words; unlabelled rows and null
marks are not learned from, and a null quality is not low; without marked or without unmarked rows all probabilities
are the shares of the labelled rows; a category that no row or every row has keeps its share; equal texts, and repeated
rows, are scored alike; several labels of an id each count as a row; very long texts are scored whole, and left out
of the fit; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import slices

CATEGORIES = ("junk", "toxic_junk", "toxic_prose", "toxic")
THRESHOLD = 0.25
#: Bounds of the labelled sample on the driver: rows (twice this number, all drawn at one rate), and bytes of a text; words in a vocabulary; folds.
FIT_ROWS, FIT_BYTES, VOCABULARY, FOLDS = 3000, 32 * 1024, 256, 5
#: A word must be in so many rows, and the two shares so many standard errors apart.
LEAST_ROWS, LEAST_Z = 3, 4.0

#: Lengths of the word beginnings that are features too.
BEGINNINGS = (5, 6, 7)

_words = re.compile(r"[^\W\d_]+").findall


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 20) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept and is not shrunk."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    shrink = np.full(len(w), penalty)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (p - y) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Link:
    """One model of the chain: the columns of its vocabulary, and the weights of those, of earlier categories and the intercept."""

    columns: np.ndarray
    weights: np.ndarray


@dataclass
class Chain:
    """vocabulary numbers the features of all links. shares: the shares of the categories in the sample, the answer where there is no link."""

    vocabulary: dict[str, int]
    links: list[Link | None]
    shares: list[float]
    _heads: set = field(default_factory=set, repr=False)

    def __post_init__(self):
        self._heads = {f[:4] for f in self.vocabulary}

    def counts(self, text: str) -> np.ndarray:
        row = np.zeros(len(self.vocabulary))
        heads = self._heads
        for word, n in Counter([w for w in _words(text.lower()) if w[:4] in heads]).items():
            for f in features(word):
                if f in self.vocabulary:
                    row[self.vocabulary[f]] += n
        return np.log1p(row)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.counts(t) for t in texts]).reshape(len(texts), len(self.vocabulary))
        out = np.zeros((len(texts), 0))
        for link, share in zip(self.links, self.shares):
            p = np.full(len(texts), share) if link is None else predict(link.weights, np.c_[x[:, link.columns], out])
            out = np.c_[out, p]
        return out


@dataclass
class Sample:
    """Feature counts of labelled rows: the entries row, feature and log count, by row, and the names of the features."""

    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    names: pa.Array
    rows: int

    def telling(self, y: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The features whose shares of rows with and without y differ, among some rows."""
        entries = among[self.row]
        marked = y[self.row].astype(bool)
        with_, without = (np.bincount(self.feature[entries & m], minlength=len(self.names)) for m in (marked, ~marked))
        n1, n0 = max(1, int((y[among] == 1).sum())), max(1, int((y[among] == 0).sum()))
        share = (with_ + without + 1) / (n0 + n1 + 2)
        z = np.abs(with_ / n1 - without / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
        found = np.flatnonzero((with_ + without >= LEAST_ROWS) & (z >= LEAST_Z))
        return np.sort(found[np.lexsort((found, -z[found]))][:VOCABULARY])

    def matrix(self, columns: np.ndarray) -> np.ndarray:
        place = np.full(len(self.names), -1)
        place[columns] = np.arange(len(columns))
        known = place[self.feature] >= 0
        x = np.zeros((self.rows, len(columns)))
        x[self.row[known], place[self.feature[known]]] = self.value[known]
        return x


def sample_of(words: pa.Array, counts: np.ndarray, sizes: np.ndarray) -> Sample:
    """Features in the order of their names, so that the order of the rows' words has no effect."""
    coded = words.dictionary_encode()
    code, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    length = pc.utf8_length(known).to_numpy(zero_copy_only=False)
    parts = [(known, np.ones(len(known), bool)), *((pc.binary_join_element_wise(pc.utf8_slice_codeunits(known, 0, n), "*", ""), length >= n) for n in BEGINNINGS)]
    all_names = pa.concat_arrays([p.filter(pa.array(k)).cast(pa.string()) for p, k in parts]).dictionary_encode()
    order = pc.array_sort_indices(all_names.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    names, ids = all_names.dictionary.take(pa.array(order)), rank[all_names.indices.to_numpy(zero_copy_only=False)]
    owner, row, feature, value, at = np.repeat(np.arange(len(sizes)), sizes), [], [], [], 0
    for _, kept in parts:
        own = np.full(len(known), -1)
        own[kept] = ids[at : at + kept.sum()]
        at += int(kept.sum())
        mine = own[code]
        row.append(owner[mine >= 0])
        feature.append(mine[mine >= 0])
        value.append(counts[mine >= 0])
    key = np.concatenate(row) * max(1, len(names)) + np.concatenate(feature)
    key, entry = np.unique(key, return_inverse=True)
    total = np.bincount(entry, weights=np.concatenate(value), minlength=len(key))
    return Sample(key // max(1, len(names)), key % max(1, len(names)), np.log1p(total), names, len(sizes))


def fit(sample: Sample, toxic: np.ndarray, low: np.ndarray, seed: int = 5) -> Chain:
    targets = (low, toxic * low, toxic * (1 - low), toxic)
    shares = [float(y.mean()) if len(y) else 0.0 for y in targets]
    if not len(toxic) or toxic.min() == toxic.max():
        return Chain({}, [None] * len(targets), shares)
    fold = np.random.Generator(np.random.PCG64(seed)).permutation(len(toxic)) % FOLDS
    everything = np.ones(len(toxic), bool)
    earlier, found = np.zeros((len(toxic), 0)), []

    def link(y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if y[rows].min() == y[rows].max():
            return None
        columns = sample.telling(y, rows)
        x = np.c_[sample.matrix(columns), earlier]
        return columns, fit_linear(x[rows], y[rows]), x

    for y, share in zip(targets, shares):
        whole = link(y, everything)
        found.append(whole)
        out = np.full(len(y), share)
        for f in range(FOLDS if whole else 0):
            if not (fold == f).any():
                continue
            part = link(y, fold != f)
            out[fold == f] = predict(part[1], part[2][fold == f]) if part else y[fold != f].mean()
        earlier = np.c_[earlier, out]
    used = np.unique(np.concatenate([x[0] for x in found if x])) if any(found) else np.zeros(0, int)
    vocabulary = {name: i for i, name in enumerate(sample.names.take(pa.array(used)).to_pylist())}
    return Chain(vocabulary, [Link(np.searchsorted(used, x[0]), x[1]) if x else None for x in found], shares)


def learn(documents: DataFrame, labels: DataFrame) -> Chain:
    """Fit on a bounded sample of labelled rows: the lowest hashed ids, whatever their marks, texts of FIT_BYTES at most.

    Their words are counted by the executors.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0)).alias("low"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "low").limit(2 * FIT_ROWS)
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= FIT_BYTES)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(Counter(_words(t.lower())).items()) for t in batch.column("text").to_pylist()]
            words, counts = ([[x[i] for x in own] for own in found] for i in (0, 1))
            arrays = [*(batch.column(c) for c in ("doc_id", "toxic", "low")), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "toxic", "low", "words", "counts"])

    kind = dict(documents.dtypes)["doc_id"]
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "low", "text")
    table = rows.mapInArrow(counted, f"doc_id {kind}, toxic int, low int, words array<string>, counts array<long>")
    # An id can stand for many rows: the sample is bounded once more.
    table = table.orderBy(F.xxhash64("doc_id", "words", "counts"), "toxic", "low").limit(2 * FIT_ROWS).toArrow()
    order = [(c, "ascending") for c in ("doc_id", "toxic", "low")]
    table = table.append_column("size", pc.list_value_length(table.column("words"))).sort_by([*order, ("size", "ascending")]).combine_chunks()
    words, counts = (table.column(c).combine_chunks() for c in ("words", "counts"))
    sizes, toxic, low = (table.column(c).to_numpy() for c in ("size", "toxic", "low"))
    sample = sample_of(words.flatten(), counts.flatten().to_numpy(zero_copy_only=False), sizes)
    return fit(sample, toxic.astype(int), low.astype(int))


def score_toxicity(documents: DataFrame, labels: DataFrame, chain: Chain | None = None) -> DataFrame:
    """doc_id and the probability of every category, for every document."""
    shared = documents.sparkSession.sparkContext.broadcast(chain or learn(documents, labels))
    kind = dict(documents.dtypes)["doc_id"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in slices(batches):
            p = chain.probabilities(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, i], pa.float64()) for i in range(len(CATEGORIES)))], names=["doc_id", *CATEGORIES])

    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(scored, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in CATEGORIES))


def flag_toxic(documents: DataFrame, labels: DataFrame, chain: Chain | None = None) -> DataFrame:
    """doc_id, is_toxic (true) and the probabilities of the documents that reach the threshold for toxic, the last category."""
    found = score_toxicity(documents, labels, chain).where(F.col(CATEGORIES[-1]) >= THRESHOLD)
    return found.select("doc_id", F.lit(True).alias("is_toxic"), *CATEGORIES)
