"""Every pair within reach is a link, also inside one component."""

import random

import pytest

from tessera.llm import jaccard_join


@pytest.mark.parametrize("small", [32, 2])
def test_link_counts(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    r = random.Random(5)
    base, texts = [f"w{r.randrange(400)}" for _ in range(120)], []
    for i in range(14):
        words = list(base)
        for p in r.sample(range(120), i % 5):
            words[p] = f"c{i}"
        texts.append(" ".join(words))
    texts += [texts[1], "alone " + " ".join(f"v{i}" for i in range(20)), "", None]
    own = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for t in texts)]
    near = lambda x, y: bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: x["n_links"] for x in jaccard_join.link_counts(docs).collect()}
    assert found == {i: sum(near(own[i], y) for j, y in enumerate(own) if j != i) for i in range(len(own))}
    assert max(found.values()) > 5
