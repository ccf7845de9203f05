"""Scores recomputed block by block with compressors of their own; all columns of the shards against a plain sort."""

import math
import random
import zlib

import zstandard

from tessera.llm import quality, sharding


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(n))


def test_scores_equal_brute_force(spark):
    texts = [prose(80, i) if i % 3 else prose(40, i).upper() * 3 for i in range(80)] + [None, "", "é" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(80)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    makers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False) for raw in (model.good, model.bad)]
    for r in quality.score_quality(docs, labels).collect():
        data = (texts[r["doc_id"]] or "").encode()
        g, b = (sum(len(m.compress(data[i : i + quality.BLOCK])) for i in range(0, len(data), quality.BLOCK)) for m in makers)
        d, ratio = 10 * (b - g) / max(g + b, 1), 3 * (g / len(data) if data else 1.0)
        z = sum(w * x for w, x in zip(model.weights, (1, d, ratio, ratio * ratio, d * ratio)))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_all_columns_of_the_shards(spark):
    r = random.Random(5)
    rows = [(i, None if i % 17 == 0 else prose(r.randint(0, 60), i % 30), r.choice(["en", "fr", None]), f"https://host/{r.randint(0, 9)}") for i in range(203)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = sorted(sharding.shard_rows(docs, 24).collect(), key=lambda x: x["rank"])
    text = {i: (t or "").encode() for i, t, _, _ in rows}
    assert [x["rank"] for x in found] == list(range(203)) and sorted(x["doc_id"] for x in found) == list(range(203))
    order = [(x["h"], x["text_crc32"], x["doc_id"]) for x in found]
    assert order == sorted(order)
    for x in found:
        assert x["size"] == len(text[x["doc_id"]]) + 8 and x["text_crc32"] == zlib.crc32(text[x["doc_id"]])
        assert x["shard"] == x["rank"] * 24 // 203 and x["slot"] == x["rank"] - -(-x["shard"] * 203 // 24)
