"""Classes and links against a comparison of all pairs."""

import random

import numpy as np
import pytest

from floeline.llm import jaccard
from floeline.llm.components import components


def test_prefix_length_reaches_the_recall():
    length = jaccard.prefix_length(0.8)
    assert length == 4
    assert 1 - (1 - 0.8**length) ** jaccard.TREES >= jaccard.RECALL


def by_force(rows):
    sets = [set(jaccard.shingles(t).tolist()) for _, t in rows]
    links = [[] for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                links[i].append(j)
                links[j].append(i)
    root = list(range(len(rows)))
    for start in range(len(rows)):
        stack = [start]
        while stack:
            i = stack.pop()
            for j in links[i]:
                if root[j] > root[start]:
                    root[j] = root[start]
                    stack.append(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], d), d)
    return sorted((d, least[root[i]], len(links[i])) for i, (d, _) in enumerate(rows))


def corpus(seed):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(0, None), (1, ""), (2, "... !"), (3, "One two"), (4, "one, two."), (5, "one two three")]
    for base in range(25):
        text = pick.choices(vocabulary, k=pick.randrange(5, 150))
        for _ in range(pick.choice([1, 1, 2, 8])):
            copy = [w if pick.random() > 0.01 else pick.choice(vocabulary) for w in text]
            rows.append((len(rows) + 10, " ".join(copy)))
    rows += [(len(rows) + 100 + i, rows[20][1]) for i in range(4)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1500, 3])
def test_classes(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(7)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_links int").repartition(3)
    got = sorted(tuple(r) for r in jaccard.classes(docs).select("doc_id", "class_id", "n_links").collect())
    assert got == by_force(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in got})


def test_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "x")], "doc_id long, text string")
    rows = {tuple(r) for r in jaccard.classes(docs).collect()}
    assert rows == {(None, None, 1), (7, 7, 0)}
    assert jaccard.one_of_each(docs).count() == 2
    assert jaccard.classes(docs.limit(0)).count() == 0


def test_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("q", "q")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    found = dict(components(spark.createDataFrame(pairs, "u string, v string")).collect())
    assert found == {"b": "a", "c": "a", "y": "x"} | {f"n{i:03}": "n000" for i in range(1, 61)}


def test_common_counts():
    pick = np.random.default_rng(1)
    sets = [np.unique(pick.integers(0, 9000, pick.integers(1, 6000)).astype(np.uint64)) for _ in range(9)]
    found = jaccard.common(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert found[i, j] == len(np.intersect1d(a, b))


def test_registered_query(spark, small):
    from floeline.llm import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op3_jaccard_join(spark, small).select("doc_id", "class_id", "n_links").collect())
    assert got == by_force(docs)
