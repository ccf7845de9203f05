"""Toxicity learns the true share of marked rows, however many labels there are."""

from tessera.llm import toxicity


def test_share_is_learned_from_cut_samples(spark, monkeypatch):
    """Every marked document and half of the others have one word: a tenth of those with it are marked."""
    rows = [(i, "some grey words" if i % 20 == 0 or i % 2 else "some other words", int(i % 20 == 0)) for i in range(2000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, mark) for i, _, mark in rows], "doc_id long, quality int, toxic int")
    highest = []
    for most in (2000, 100):
        monkeypatch.setattr(toxicity, "FIT_ROWS", most)
        highest.append(toxicity.score_toxicity(docs, labels).agg({"toxic": "max"}).first()[0])
        assert toxicity.flag_toxic(docs, labels).count() == 0
    assert abs(highest[0] - 1 / 11) < 0.03 and abs(highest[1] - highest[0]) < 0.05
