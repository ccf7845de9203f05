"""The last link of the chain decides, on what the earlier ones say; their inputs in training are out-of-fold."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import toxicity


def corpus(n=900):
    """A sharp word is marked in prose and hardly in junk; words of junk are too rare each to tell anything but junk, so only that link sees them."""
    r = random.Random(2)
    rows = []
    for i in range(n):
        junk, sharp = r.random() < 0.4, r.random() < 0.5
        words = [r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(12)] + [chr(97 + k % 26) * 3 + chr(97 + k // 26) for k in r.sample(range(60), 3 if junk else 0)]
        words += ["sharp"] * 2 * sharp
        rows.append((i, " ".join(words), int(not junk), int(sharp and (not junk or r.random() < 0.05))))
    return rows


def test_an_earlier_link_changes_the_flagged_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    chain = toxicity.learn(docs, labels)
    assert toxicity.CATEGORIES[-1] == "toxic" and len(chain.links) == 4
    flagged = {r["doc_id"] for r in toxicity.flag_toxic(docs, labels, chain).collect()}
    truth = {i for i, _, _, x in rows if x}
    assert len(flagged & truth) >= 0.9 * len(truth) and len(flagged - truth) <= 0.1 * len(flagged)
    without = toxicity.Chain(chain.vocabulary, [None, *chain.links[1:]], chain.shares)
    others = {r["doc_id"] for r in toxicity.flag_toxic(docs, labels, without).collect()}
    assert flagged != others
    assert all(abs(chain.links[-1].weights[len(chain.links[-1].columns) + k]) > 1e-3 for k in range(3))


def brute_counts(texts):
    out = []
    for text in texts:
        own = {}
        for word in toxicity._words(text.lower()):
            for f in toxicity.features(word):
                own[f] = own.get(f, 0) + 1
        out.append(own)
    return out


def test_sample_holds_the_counts_of_all_features():
    texts = ["Über über idiot idiotic", "", "a b idiots " * 3, "naïveté"]
    found = [sorted({w: toxicity._words(t.lower()).count(w) for w in toxicity._words(t.lower())}.items()) for t in texts]
    words, counts = [w for own in found for w, _ in own], np.array([n for own in found for _, n in own])
    sample = toxicity.sample_of(pa.array(words), counts, np.array([len(own) for own in found]))
    names = sample.names.to_pylist()
    assert names == sorted(names, key=lambda s: s.encode())
    for i, own in enumerate(brute_counts(texts)):
        mine = {names[f]: v for r, f, v in zip(sample.row, sample.feature, sample.value) if r == i}
        assert mine.keys() == own.keys() and all(np.isclose(mine[k], np.log1p(v)) for k, v in own.items())


def test_null_and_clashing_columns(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t, _, _ in rows] + [(None, None, 1.0, "y"), (5, "", 0.0, "z"), (5, rows[0][1], 0.0, "z")], "doc_id long, text string, toxic double, words string")
    labels = spark.createDataFrame([(i, q, x, "l") for i, _, q, x in rows] + [(1, None, None, "m"), (None, 0, 1, "n"), (2, None, 1, "o")], "doc_id long, quality int, toxic int, text string")
    found = toxicity.score_toxicity(docs, labels).collect()
    assert len(found) == 203 and all(0 <= p <= 1 for r in found for p in r[1:])
    assert [r[1:] for r in found if r["doc_id"] is None][0] in [r[1:] for r in found if r["doc_id"] == 5]
