"""Automata keep the lengths and fixed characters of formats; unlabelled credentials of a labelled format are found, prose is not."""

import random
import string

import pytest

from tessera.llm import secrets

ALNUM = string.ascii_letters + string.digits


def token(r, kind):
    body = lambda n, chars=ALNUM: "".join(r.choice(chars) for _ in range(n))
    return {"p": lambda: "ghx_" + body(36), "s": lambda: f"{body(8, string.digits)}-{body(8, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')}-{body(12)}", "h": lambda: body(40, "0123456789abcdef")}[kind]()


def words(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 22))) for _ in range(n)) + " see www.example.com/path/to.html or mail some.body.else@mail.example.com in 20240101.120000.csv"


def test_one_length_keeps_a_state_for_each_position():
    r = random.Random(1)
    automaton = secrets.infer([token(r, "h") for _ in range(200)])
    assert len(automaton) >= 41
    g = secrets.Grammars({"x": automaton}, {}, {})
    per_character = [g.likelihood(automaton, w) / (len(w) + 1) for w in ("0a" * 20, "0a" * 19, "0a" * 21)]
    assert per_character[0] > max(per_character[1:]) + 0.1
    prefixed = secrets.infer([token(r, "p") for _ in range(60)])
    likelihood = secrets.Grammars({"x": prefixed}, {}, {}).likelihood
    assert likelihood(prefixed, "ghx_" + "aB3" * 12) > likelihood(prefixed, "qrx_" + "aB3" * 12) + 4 > likelihood(prefixed, "qrxx" + "aB3" * 12) + 4


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(7)
    rows, truth = [], {}
    for i in range(400):
        text, spans = words(r, 30) + " ", set()
        if i % 2 == 0:
            text += f'token = "{token(r, "psh"[i // 2 % 3])}" '
        elif i % 5 == 0:
            for kind in "ps":
                own = token(r, kind)
                text += ("auth=" if i % 15 == 0 else "") + own
                spans.add((len(text) - len(own), len(text)))
                text += " "
        text += words(r, 20)
        rows.append((i, text))
        truth[i] = spans
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"]: x["spans"] for x in secrets.find_secrets(docs).collect()}
    return {i: {(s["start"], s["end"]) for s in spans if s["kind"] == "learned"} for i, spans in found.items()}, truth, found


def test_precision_and_recall_of_learned_spans(planted):
    learned, truth, _ = planted
    hits, all_found, all_true = sum(len(learned[i] & truth[i]) for i in truth), sum(map(len, learned.values())), sum(map(len, truth.values()))
    assert all_true == 80
    assert hits >= 0.9 * all_true and hits >= 0.95 * all_found


def test_base_spans_are_scored(planted):
    scores = [s["score"] for spans in planted[2].values() for s in spans if s["kind"] == "assign"]
    assert len(scores) == 200 and sum(x > 0 for x in scores) >= 190


def test_prose_has_no_learned_spans(spark):
    r = random.Random(9)
    docs = spark.createDataFrame([(i, words(r, 60) + (f' secret: "{token(r, "p")}"' if i < 40 else "")) for i in range(300)] + [(None, None), (None, "")], "doc_id long, text string")
    assert sum(s["kind"] == "learned" for x in secrets.find_secrets(docs).collect() for s in x["spans"]) == 0
