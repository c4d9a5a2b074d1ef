"""Abbreviations that a corpus teaches, against counts in plain Python, and sentences that they hold together."""

import math
import re
from collections import Counter

import pytest

from lodestar.operators import ends

TEXTS = [
    "We met Dr. Smith at noon. The doctor was late. He had seen Mr. Jones before.",
    "Then Dr. Brown and Mr. Green came, etc. The rest stayed. Nobody saw the doctor again.",
    "Apples, pears, etc. were sold. The shop of Mr. Miller was closed! Was Dr. Who there?\nYes.  No.",
    "See the list, etc. The end of it was lost. See Dr. Smith, etc. and ask him.",
    "the e.g. rule holds, e.g. here. They asked Dr.\nBlack about the rule",
    None, "", "   ", "...", "x" * 5000 + ". Then the end.", "-" * 5000 + "a. The end", "Dr. Smith",
] + ["The old house stood on a hill. It was empty, and the wind blew. They said Dr. Grey lived near Mr. White."] * 6


def core(token):
    if len(token) > 64:
        return None
    bare = re.sub(r"^[\W_]+", "", token)
    bare = re.sub(r"[^A-Za-z0-9.]+$", "", bare)
    return bare if re.search("[A-Za-z]", bare) else None


def counted():
    ended, opened, small, large = Counter(), Counter(), Counter(), Counter()
    for t in TEXTS:
        words = (t or "").split()
        for before, w in zip([None, *words], words):
            if (c := core(w)) is None:
                continue
            word = c.rstrip(".").lower()
            (ended if c.endswith(".") else opened)[word] += 1
            small[word] += c[0].islower()
            large[word] += c[0].isupper() and before is not None and before[-1] not in ".!?:"
    return ended, opened, small, large


def scores():
    ended, opened, _, _ = counted()
    p = sum(ended.values()) / (sum(ended.values()) + sum(opened.values()))
    made = {}
    for w in {*ended, *opened}:
        k, rest = ended[w], opened[w]
        size = len(w.replace(".", ""))
        ratio = -2 * (k * math.log(p) + rest * math.log(1 - p) - k * math.log(0.99) - rest * math.log(0.01))
        made[w] = ratio * math.exp(-size) * (len(w) - size + 1) * size ** -float(rest)
    return made


def split(text):
    _, _, small, large = counted()
    short = {w for w, s in scores().items() if s >= 0.3}
    made, start = [], 0
    for m in re.finditer(r"[.!?]\s+", text):
        last = core(text[: m.start() + 1].split()[-1])
        following = (text[m.end() :].split() or [""])[0]
        following = core(following)
        if text[m.start()] == "." and last and last.rstrip(".").lower() in short:
            word = following and following.rstrip(".").lower()
            if not (following and following[0].isupper() and small[word] > large[word]):
                continue
        made.append(text[start : m.end()])
        start = m.end()
    return [s.strip() for s in [*made, text[start:]] if s.strip()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


def test_scores_equal_plain_counts(docs):
    found = {r["word"]: r["score"] for r in ends.scored(ends.word_counts(docs)).collect()}
    want = scores()
    assert found.keys() == want.keys()
    assert all(math.isclose(found[w], want[w], rel_tol=1e-9, abs_tol=1e-12) for w in want)
    assert {"dr", "mr", "etc"} <= {r["word"] for r in ends.learn(docs).abbreviations.collect()}


def test_sentences_equal_plain_splitting(docs):
    found = {r["doc_id"]: r["sentences"] for r in ends.with_sentences(docs, ends.learn(docs)).collect()}
    assert found == {i: split(t or "") for i, t in enumerate(TEXTS)}
    assert found[0] == ["We met Dr. Smith at noon.", "The doctor was late.", "He had seen Mr. Jones before."]
    assert found[1][0] == "Then Dr. Brown and Mr. Green came, etc."  # "The" is written small elsewhere
    assert found[2][0] == "Apples, pears, etc. were sold." and found[2][-2:] == ["Yes.", "No."]
    assert found[4][-1] == "They asked Dr.\nBlack about the rule" and found[11] == ["Dr. Smith"]


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ends.with_sentences(none, ends.learn(none)).count() == 0
    plain = spark.createDataFrame([(1, "no stop at all", "x"), (1, "no stop at all", "y")], "doc_id long, text string, _n string")
    made = ends.with_sentences(plain, ends.learn(plain))
    assert made.columns == ["doc_id", "text", "_n", "sentences"] and [r["sentences"] for r in made.collect()] == [["no stop at all"]] * 2


def test_a_text_is_cut_once_not_for_each_sentence(spark):
    """No plan splits a text by an expression inside of a loop over its sentences, and odd marks are told apart as before."""
    docs = spark.createDataFrame([(1, "Dr. Who.\tYes\u00a0no. x\x01y. dr.  "), (2, "a.\u2028 b! Dr. "), (3, None), (4, " \n")], "doc_id long, text string")
    learned = ends.Learned(spark.createDataFrame([("dr", 1, 0, 1.0)], "word string, n_ended long, n_open long, score double"), spark.createDataFrame([("x", )], "word string"))
    made = ends.with_sentences(docs, learned)
    assert "split(" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: r["sentences"] for r in made.collect()}
    assert got == {1: ["Dr. Who.", "Yes\u00a0no.", "x", "y.", "dr."], 2: ["a.\u2028 b!", "Dr."], 3: [], 4: []}
