"""Operators on small tables with nulls, empty and long texts, repeated rows, no rows, and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontamination, html, jaccard_join, pieces, quality, secrets, sharding, topk, toxicity
from tessera.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, whole string"
random.seed(7)
WORDS = [f"w{i}" for i in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def documents(spark, texts):
    rows = [(i, t, "en", "s", None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def edit(text, *places):
    words = text.split()
    for p in places:
        words[p] = "changed"
    return " ".join(words)


BASE = prose(200, 1)
TEXTS = [BASE, BASE, edit(BASE, 10), edit(BASE, 10, 90), prose(200, 2), None, "", "  \n", "one two", "One TWO", prose(30_000, 3), BASE[: len(BASE) // 2], "a b c d e", "a b c d f"]
TEXTS += [prose(60, 100) + " " + prose(20, 200 + i) for i in range(6)]


# 4: Jaccard join


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(texts):
    own, root = sets(texts), list(range(len(texts)))
    for a in range(len(own)):
        for b in range(a):
            both = len(own[a] & own[b])
            if own[a] and own[b] and 100 * both >= 75 * (len(own[a]) + len(own[b]) - both):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("small, large, many", [(32, 2048, 16), (2, 4, 1)])
def test_jaccard_components(spark, monkeypatch, small, large, many):
    """The second case sends regions of few members through drawn pivots, the recursion and the blocks."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    monkeypatch.setattr(jaccard_join, "MANY_PIVOTS", many)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    texts = TEXTS + [edit(BASE, *random.Random(i).sample(range(200), 7)) for i in range(12)]
    found = {r["doc_id"]: r for r in jaccard_join.document_components(documents(spark, texts)).collect()}
    assert len(found) == len(texts)
    assert [found[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets(texts)]
    assert [found[i]["component_id"] for i in range(len(texts))] == brute_components(texts)


def test_jaccard_keeps_one(spark):
    docs = documents(spark, TEXTS)
    kept = jaccard_join.keep_one(docs.unionByName(docs))
    assert kept.columns == docs.columns
    own = brute_components(TEXTS)
    counts = Counter(r["doc_id"] for r in kept.collect())
    empty = {i for i, s in enumerate(sets(TEXTS)) if not s}
    assert set(counts) == set(own) and all(counts[i] == 1 for i in counts if i not in empty)
    assert jaccard_join.document_components(documents(spark, [])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {found[i] for i in range(41)} == {0} and found[101] == found[100] == 100


# 1: decontamination


def test_decontamination(spark):
    item = prose(40, 50)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, prose(6, 60))], "item_id long, text string")
    clean = prose(300, 70)
    texts = [
        clean,
        clean + " " + item + " " + clean,
        "x " + edit(item, 2, 7, 12, 17, 22, 27, 32, 37).upper() + "!",
        clean + " " + " ".join(item.split()[10:28]),
        " ".join(item.split()[:5]) + " " + clean,
        None, "", prose(6, 60), " ".join(item.split()[::-1]),
    ]
    docs = documents(spark, texts)
    pairs = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(docs, bench).collect()}
    assert pairs == {(1, 1), (2, 1), (3, 1), (7, 4)}
    kept = decontamination.keep_uncontaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 4, 5, 6, 8}
    assert decontamination.overlaps(docs, bench.limit(0)).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    item = prose(40, 50)
    docs = documents(spark, [prose(50, 51), prose(50, 52) + " " + item])
    assert [r["doc_id"] for r in decontamination.overlaps(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [1]


# 2: secrets


def brute_base(text):
    found = []
    for k, (pattern, least) in enumerate([(secrets.ASSIGN, 6), (secrets.ACCESS, 20), (secrets.HEX, 24)]):
        for m in re.finditer(pattern, text, re.IGNORECASE | re.ASCII if k == 0 else 0):
            if len(m[2] if k == 0 else m[0]) >= least:
                found.append((m.start(), k, m.end()))
    return [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_secret_spans(spark):
    r = random.Random(3)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(120)]
    texts = [f"{prose(20, i)} token = \"{h}\" {prose(20, i + 1)}" for i, h in enumerate(hexes)]
    texts += [None, "", "é😀 PassWord: 'abcdef' api_key=abc secret:=abcdefg", "AKIA" + "Q" * 16 + " AKIA" + "Q" * 15, "x" + "f" * 24 + " " + "f" * 23, "token=token : abcdefgh"]
    texts += ["key " + hexes[0].upper() + " end", prose(9000, 5) + " tooooooooooolongwordsareordinarytext"]
    found = {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(documents(spark, texts))).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in found[i]["spans"].split(",") if s and not s.startswith("learned")] == base
    assert found[len(texts) - 2]["spans"] == "learned:4:44"
    assert found[len(texts) - 1]["n_learned"] == 0
    clean = {r["doc_id"]: r for r in secrets.redact_documents(documents(spark, texts)).collect()}
    assert hexes[0] not in clean[0]["text"] and secrets.REPLACEMENT in clean[0]["text"] and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[120]["text"] is None and clean[121]["text"] == ""
    assert secrets.find_secrets(documents(spark, [])).count() == 0


def test_automaton_generalises():
    words = ["ab" * n + "1" for n in range(2, 40)] * 3
    automaton = secrets.infer(words)
    assert len(automaton) < 12
    g = secrets.Grammars({"x": automaton}, {}, {})
    assert g.likelihood(automaton, "ababab1") > g.likelihood(automaton, "zzzzzz1")


# 3 and 8: classifiers


def labelled(spark, n=160):
    texts, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        text = prose(60, 1000 + i)
        text = " ".join(w.upper() + "!!" for w in text.split()) if bad else text
        texts.append(text + (" moron idiot" + str(i) if toxic else ""))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(10_000, None, None), (None, 1, 1), (0, 0, 1)]
    return documents(spark, texts + [None, ""]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), n


def test_quality_classifier(spark):
    docs, labels, n = labelled(spark)
    rows = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert len(rows) == n + 2 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in rows.items())
    held = [i for i in range(n) if rows[i]["held_out"]]
    assert len(held) > 10 and sum(rows[i]["predicted"] == int(i % 4 != 0) for i in held) >= 0.95 * len(held)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows.values())
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_quality_never_learns_held_out_labels(spark):
    docs, labels, _ = labelled(spark)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.score_quality(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_chain(spark):
    docs, labels, n = labelled(spark)
    flagged = {r["doc_id"] for r in toxicity.flag_toxic(docs, labels).collect()}
    assert flagged == {i for i in range(n) if i % 5 == 0}
    assert toxicity.score_toxicity(docs, labels).count() == n + 2
    assert toxicity.flag_toxic(docs, labels.limit(0)).count() == 0 and toxicity.flag_toxic(docs.limit(0), labels).count() == 0


# 5: sharding


def brute_hilbert(cell, dims, bits):
    """Skilling's transform, one cell at a time."""
    x = [(cell >> (bits * (dims - 1 - i))) & ((1 << bits) - 1) for i in range(dims)]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = sum(q - 1 for q in (1 << b for b in range(1, bits)) if 0)
    for b in range(bits - 1, 0, -1):
        if x[-1] & (1 << b):
            t ^= (1 << b) - 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out * 2 + ((v >> b) & 1)
    return out


def test_hilbert_curve_visits_neighbours(spark):
    cells = {r["h"]: r["cell"] for r in sharding.hilbert_cells(spark, 3, 2).collect()}
    assert sorted(cells) == list(range(64))
    assert all(brute_hilbert(c, 3, 2) == h for h, c in cells.items())
    at = lambda c: [(c >> s) & 3 for s in (4, 2, 0)]
    assert all(sum(abs(p - q) for p, q in zip(at(cells[h]), at(cells[h + 1]))) == 1 for h in range(63))


@pytest.mark.parametrize("n", [0, 5, 100])
def test_shards_are_even(spark, n):
    texts = [None, "", "é😀", *TEXTS * 6][:n]
    rows = sharding.shard_rows(documents(spark, texts), 24).collect()
    assert len(rows) == n
    counts = Counter(r["shard"] for r in rows)
    assert not rows or max(counts.values()) - min(counts[s] for s in range(24)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    ordered = sorted(rows, key=lambda r: r["rank"])
    assert [r["h"] for r in ordered] == sorted(r["h"] for r in rows)


def test_shards_are_written(spark, tmp_path):
    docs = documents(spark, TEXTS)
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(TEXTS) and back.select("shard").distinct().count() == 4


# 6: HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><a href="/">Home</a></header><nav><ul><li>A<li>B</ul></nav>
<div class="cookie-notice">Accept cookies</div><article><h1>{0}</h1><p><b>{1}<br>x &amp;amp; &lt;y&gt;<p>{2}</p><form><input></form><div class="ad">Buy</div></article><section id="comments"><p>First!</p></section>
<aside>Links</aside><footer>&copy; site</footer></body></html>"""
PLAIN = "<div class=wrap><div class=menu>Menu {0}</div><div class=text><p>{1}</p><p>{2}</p></div><div class=bottom>Same on every page</div></div>"


def test_html_extraction(spark):
    pages = [(i, f"http://a.example/{i}", PAGE.format(f"Title {i}", prose(5, i), prose(9, i + 50))) for i in range(6)]
    pages += [(10 + i, f"https://b.example:80/{i}", PLAIN.format(i, prose(30, i), prose(40, i + 90))) for i in range(6)]
    pages += [(20, None, "<p>alone &eacute;</p>"), (21, "http://c.example", None), (22, "x", ""), (23, "http://d.example", "no tags at\n all < here"), (0, "http://a.example/0", pages[0][2])]
    found = html.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(found) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in found)
    text = {r["page_id"]: r["text"] for r in found}
    for i in range(6):
        assert text[i] == f"Title {i}\n{prose(5, i)} x &amp; <y>\n{prose(9, i + 50)}"
        assert text[10 + i] == f"{prose(30, i)}\n{prose(40, i + 90)}"
    assert text[20] == "alone é" and text[21] == text[22] == "" and text[23] == "no tags at all < here"


def test_wrapper_has_optional_and_repeated_groups():
    node = html.infer(["<article><h1>a</h1><p>x</p></article>", "<article><p>y</p><p>z</p><div class=n>k</div></article>"])
    assert html.expression(node) == "<><article>(<h1>'a'</>)? (<p>#</>)+ (<div.n>'k'</>)?</></>"


# 7: top-k


def test_top_k_is_exact(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(r.normal(size=8), 2)]) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(4)] + [(600, None), (601, [1.0, None] + [0.0] * 6), (602, [float("nan")] * 8), (603, [float("inf")] * 8), (650, [1.0] * 3), (651, [2.0] * 3)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 50, 5).collect()
    valid = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in valid:
        if q % 50 == 0:
            scored = sorted((-int(valid[q] @ v), i) for i, v in valid.items() if i != q and len(v) == len(valid[q]))[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), 50, 5).count() == 0


# 9: SentencePiece


def test_pieces_equal_the_library(spark):
    spm = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    model = spm.SentencePieceProcessor(model_file=pieces.model_path())
    r = random.Random(9)
    texts = [None, "", " ", "\n", "a▁b", "<s> x</s>", "\x00", "  two  spaces ", "x" * 700 + " y", "!" * 200] + TEXTS
    texts += ["".join(r.choice("abe the▁  \n\té漢😀0.!") for _ in range(r.randint(0, 90))) for _ in range(150)]
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in pieces.encode_documents(docs).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == model.encode(t or "") and rows[i]["n_tokens"] == len(rows[i]["ids"])
        assert rows[i]["round_trip"] == ("▁" not in (t or ""))
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(pieces.encode_documents(docs)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert pieces.encode_documents(docs.limit(0)).count() == 0


# 10: chat


def test_chat_round_trip(spark):
    turns = [(1, 0, "system", "be <|end|> kind & [INST]"), (1, 1, "user", None), (1, 2, "user", "<|role|>assistant<|text|>x"), (1, 3, "assistant", "&lt; yes"), (1, 4, "assistant", "</s>"), (2, 0, "assistant", "é😀"), (2, 0, "assistant", "é😀"), (3, None, None, "r"), (None, 1, "user", "q")]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(frame)
    for r in chat.digest(chat.read_back(formatted)).collect():
        own = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in turns if c == r["conv_id"]])
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    assert whole[1].count(chat.ROLE) == 3 and whole[1].count(chat.PART) == 2 and "[INST]" not in whole[1]
    assert chat.format_conversations(frame.limit(0)).count() == 0
