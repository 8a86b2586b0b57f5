"""Counts and base scores by force, the tree as a distribution, and its gain on texts it has not seen."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from floeline.llm import suffix_tree as st


def corpus(count=300):
    pick = random.Random(8)
    syllables = ["th", "er", "on", "an", "ing", "re", "é"]
    word = lambda: "".join(pick.choices(syllables, k=pick.randrange(1, 7)))
    docs = [(d, " ".join(word() for _ in range(pick.randrange(40)))) for d in range(count)]
    return docs + [(1000, None), (1001, ""), (1002, "A\tb\x0bC\n\n d\x85e "), (1003, "ÀB àb"), (None, "the id is null"), (5, docs[5][1])]


def tokens(text):
    small = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", small), "\n"]


def is_held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


@pytest.fixture(scope="module")
def rows(spark):
    frame = spark.createDataFrame([(d, t, "x") for d, t in corpus()], "doc_id long, text string, block string").repartition(3)
    return st.scores(frame).collect()


def test_base(rows):
    docs = corpus()
    train = Counter(t for d, x in docs if not is_held(d) for t in tokens(x))
    total, different = sum(train.values()), len(train)
    expected = []
    for d, x in docs:
        own = tokens(x)
        score = sum(math.log10((train[t] + 1) / (total + different + 1)) for t in own)
        expected.append((-1 if d is None else d, is_held(d), len(own), sum(train[t] > 0 for t in own), total, round(score, 6)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got) == sorted(expected)


def test_gain_on_unseen_texts(spark):
    pick = random.Random(1)
    cycle = ["stone", "river", "under", "ninety", "golden", "bridge", "walking", "often"]
    docs = []
    for d in range(300):
        at = pick.randrange(8)
        docs.append((d, " ".join(cycle[(at + i) % 8] if pick.random() < 0.9 else f"x{pick.randrange(999)}" for i in range(30))))
    unseen = [r for r in st.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.held_out]
    assert len(unseen) > 20
    assert sum(r.score for r in unseen) > 0.7 * sum(r.base_score for r in unseen)


def test_blended():
    tree, share = np.array([-1.0, -500.0, -2.0]), np.array([0.5, 0.25, 0.0])
    assert np.allclose(st.blended(tree, share, 0.5), [math.log10(0.3), math.log10(0.125), math.log10(0.005)])
    assert np.allclose(st.blended(tree, share, 0.0), tree)


def test_spelled():
    for words in ([b"ab", b"\n", b"c", "é".encode(), b"x" * 300], [b"\n"], []):
        letters, begins, sizes = st.spelled(pa.chunked_array([pa.array(words[:2], pa.binary()), pa.array(words[2:], pa.binary())]))
        want = [w if w == st.END else w + b" " for w in words] + [st.END * st.ORDER]
        assert [bytes(letters[b : b + n]) for b, n in zip(begins, sizes, strict=True)] == want


def test_tree(spark):
    docs = corpus(120)
    texts = [[t.encode() for t in tokens(x)[:-1]] for _, x in docs]
    keys, n = st.count_windows(texts)
    grams = spark.createDataFrame(list(zip(keys.view(np.int64).tolist(), n.tolist())), "gram long, n long")
    states, pairs = st.grow(grams)
    tree = st.compiled(states, pairs)
    # next bytes of any context have probabilities that sum to one
    pick = np.random.default_rng(3)
    contexts = np.concatenate([pick.choice(keys, 40) >> np.uint64(8), pick.integers(0, 2**40, 10).astype(np.uint64)])
    for context in contexts:
        window = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.isclose((10 ** tree.log10(window)).sum(), 1, atol=1e-9)
        assert np.array_equal(tree.remembered(window), tree.log10(window))
    # states are closed under suffixes, and pass the divergence test or have a longer state that does
    known = {(r.length, r.context) for r in states.collect()}
    counts = Counter()
    for key, value in zip(keys.tolist(), n.tolist()):
        raw = int(key).to_bytes(6, "big")
        for d in range(st.ORDER + 1):
            counts[raw[st.ORDER - d :]] += value
    totals = Counter()
    for pair, value in counts.items():
        totals[pair[:-1]] += value
    passing = set()
    for context, total in totals.items():
        if not context or total < 2:
            continue
        after = [p for p in counts if p[:-1] == context]
        gain = sum(counts[p] * math.log2(counts[p] / total / (counts[p[1:]] / totals[context[1:]])) for p in after)
        if gain > st.BITS * len(after):
            passing |= {context[i:] for i in range(len(context) + 1)}
    passing.add(b"")
    assert known == {(len(c), int.from_bytes(c, "big")) for c in passing}


def test_chances_by_joins(spark):
    texts = [[t.encode() for t in tokens(x)[:-1]] for _, x in corpus(60)]
    keys, n = st.count_windows(texts)
    n[::7] = 0  # as if met in held-out texts only
    grams = spark.createDataFrame(list(zip(keys.view(np.int64).tolist(), n.tolist())), "gram long, n long")
    states, table = st._grown(grams)
    found = {r.gram: r.log for r in st.chances(states, table).collect()}
    assert sorted(found) == sorted(keys.view(np.int64).tolist())
    expected = st.compiled(*st.grow(grams)).log10(keys)
    assert np.allclose([found[k] for k in keys.view(np.int64).tolist()], expected)
    assert np.allclose(st.Known(keys, expected)[keys[::-1]], expected[::-1])


@pytest.mark.parametrize("together", [50, 500_000])
def test_grouped_chances_equal_those_by_joins(spark, monkeypatch, together):
    monkeypatch.setattr(st, "TOGETHER", together)
    texts = [[t.encode() for t in tokens(x)[:-1]] for _, x in corpus(150)]
    keys, n = st.count_windows(texts)
    n[::7] = 0
    grams = spark.createDataFrame(list(zip(keys.view(np.int64).tolist(), n.tolist())), "gram long, n long")
    found = {r.gram: r.log for r in st.priced(grams).collect()}
    expected = {r.gram: r.log for r in st.chances(*st._grown(grams)).collect()}
    assert found.keys() == expected.keys()
    assert max(abs(found[k] - expected[k]) for k in found) < 1e-9
    assert st.priced(grams.limit(0)).count() == 0


def test_score_by_force(spark):
    """Every text scored token by token with the small tree in memory and the weight of the tuning rows."""
    docs = [(d, x) for d, x in corpus(200) if d is not None]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = {r.doc_id: r.t for r in frame.select("doc_id", st.tuning(F.col("doc_id")).alias("t")).collect()}
    counted = [[t.encode() for t in tokens(x)[:-1]] for d, x in docs if not is_held(d) and not marks[d]]
    keys, n = st.count_windows(counted)
    tree = st.compiled(*st.grow(spark.createDataFrame(list(zip(keys.view(np.int64).tolist(), n.tolist())), "gram long, n long")))
    share = Counter(t for d, x in docs if not is_held(d) for t in tokens(x))
    total = sum(share.values())

    def chances(x):
        raw, found = st.END * st.ORDER, []
        for token in tokens(x):
            spelled = token.encode() if token == "\n" else token.encode() + b" "
            raw += spelled
            at = [int.from_bytes(raw[i - st.ORDER : i + 1], "big") for i in range(len(raw) - len(spelled), len(raw))]
            found.append(tree.log10(np.array(at, dtype=np.uint64)).sum())
        return np.array(found)

    def score(x, weight, less=0):
        own = np.array([max(share[t] - less, 0) / total for t in tokens(x)])
        return st.blended(chances(x), own, weight).sum()

    weight = max(st.WEIGHTS, key=lambda w: sum(score(x, w, 1) for d, x in docs if marks[d]))
    got = {r.doc_id: r.score for r in st.scores(frame).collect()}
    assert sum(marks.values()) > 3
    for d, x in docs:
        assert math.isclose(got[d], score(x, weight), rel_tol=1e-6, abs_tol=1e-6), d


def test_rare_contexts_of_large_texts_are_states(spark):
    # "qzq" is met 40 times among 50 million bytes: a share below one in a million
    far = [(b"ab ab ab", 50_000_000), (b"xqzqv ", 40), (b"yqzqv ", 40)]
    grams = [(int.from_bytes(w[-6:].rjust(6, b" "), "big"), c) for w, c in far]
    grams += [(int.from_bytes(w, "big"), c) for w, c in ((b" xqzqv", 40), (b" yqzqw", 40), (b"ab xqz", 40), (b"b xqzq", 40))]
    states, pairs = st.grow(spark.createDataFrame(grams, "gram long, n long"))
    assert states.where((F.col("length") > 0) & (F.col("total") < 50)).count() > 0
    assert pairs.where("n < 50").count() > 0


def test_no_training_rows(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert st.scores(frame).count() == 0
    held = next(d for d in range(100) if is_held(d))
    row = st.scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 2)
    assert math.isclose(row.score, -4 * math.log10(256), rel_tol=1e-9) and row.base_score == 0
