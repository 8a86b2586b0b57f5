"""Restored words, the language model, and accuracy on rows that training did not see."""

import itertools
import random
import zlib

import numpy as np
import pytest

from floeline.llm import toxicity as tx

CLEAN = "the river runs over old stones and under the wooden bridge where children were playing games".split()
BAD = ["idiot", "moron", "stupid", "loser"]


@pytest.fixture(scope="module")
def model():
    pick = random.Random(2)
    texts = [" ".join(pick.choices([*CLEAN, *BAD], k=40)) for _ in range(100)]
    counts = tx.letter_counts(texts).astype(float)
    return tx._smoothed(counts)


def test_model_sums_to_one(model):
    assert np.allclose(np.exp(model).sum(axis=-1), 1, atol=1e-4)


@pytest.mark.parametrize("run,word", [("1d10t", "idiot"), ("m0r0n!!", "moron"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"), ("l.o.s.e.r", "loser"), ("L053R", "loser"), ("1-d-i-0-t,", "idiot")])
def test_restored(model, run, word):
    assert word in tx.restored(run, model)


def test_plain_runs_have_one_reading(model):
    assert tx.restored("River,", model) == ["river"]
    assert tx.restored("!!!", model) == []
    assert tx.restored("2024", model) == ["2024"]


def test_viterbi_finds_the_best_path(model):
    places = tx.lattice("1d!00ot")
    def cost(word):
        codes = [0, 0, 0, *map(tx._code, word), 0]
        return -sum(float(model[tuple(codes[i : i + 4])]) for i in range(len(codes) - 3))

    words = ["".join(p) for p in itertools.product(*places)]
    assert np.isclose(cost(tx.decode(places, model)), min(map(cost, words)))


def disguised(word, pick):
    leet = {"i": "1", "o": "0", "s": "$", "e": "3", "t": "7"}
    kind = pick.randrange(4)
    if kind == 0:
        return word
    if kind == 1:
        return "".join(leet.get(c, c) if pick.random() < 0.7 else c for c in word)
    return " ".join(word) if kind == 2 else word.replace(word[2], word[2] * 4)


@pytest.mark.parametrize("text,words", [
    ("you are a s t u p i d person", ["a", "stupid"]), ("such a l o s e r", ["a", "loser"]), ("I m o r o n", ["i", "moron"]),
    ("so s t u p i d i d i o t here", ["stupid", "idiot"]), ("a $ t u p 1 d l 0 s e r", ["a", "stupid", "loser"]), ("a s t u u u u p i d", ["stupid"]),
])
def test_boundaries_between_spaced_letters(text, words):
    pick = random.Random(2)
    texts = [" ".join(pick.choices([*CLEAN, *BAD, "a", "I"], k=40)) for _ in range(100)]
    model = tx._smoothed(tx.letter_counts(texts).astype(float))
    found = tx.Reader(model).features(text)
    for word in words:
        assert set(tx.features(word)) <= found, word


def test_long_spaced_runs_take_time_in_proportion(model):
    assert len(tx.Reader(model).features("a b " * 50_000)) > 0


def test_scores(spark):
    pick = random.Random(4)
    docs, labels = [], []
    for d in range(600):
        toxic = d % 4 == 0
        body = pick.choices(CLEAN, k=pick.randrange(20, 60))
        if toxic:
            body[5:5] = [disguised(pick.choice(BAD), pick) for _ in range(2)]
        docs.append((d, " ".join(body), "x"))
        if d % 3:
            labels.append((d, int(toxic)))
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "idiot", "x"), (0, docs[0][1], "x")]
    labels += [(3, None), (None, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic string").repartition(4)
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = tx.scores(frame, given).collect()
    assert len(rows) == len(docs)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    seen = [(r.predicted, int(r.doc_id % 4 == 0)) for r in rows if r.doc_id is not None and r.doc_id < 600 and (r.held_out or r.doc_id % 3 == 0)]
    assert np.mean([p == t for p, t in seen]) > 0.97
    by = {r.doc_id: r.score for r in rows}
    assert by[1000] == by[1001] < 0.5


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tx.scores(docs, none).collect()] == [0.5]
    assert tx.scores(docs.limit(0), none).count() == 0
