"""Spaced seeds against a comparison of every item with every document at every shift."""

import itertools
import random

import numpy as np
import pytest

from floeline.llm import decontamination as dc
from floeline.llm import words


def test_masks_meet_every_window_with_two_exchanges():
    for count in range(3):
        for bad in itertools.combinations(range(dc.WINDOW), count):
            met = any(
                all(shift + i not in bad for i in mask)
                for mask in dc.MASKS
                for shift in range(dc.WINDOW - mask[-1])
            )
            assert met, bad
    assert dc.needed(dc.WINDOW) == dc.WINDOW - 2


def by_force(docs, items):
    found = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = words.hashes(text), words.hashes(item)
        if len(b) < dc.SHORTEST:
            continue
        for shift in range(-len(b), len(a) + 1):
            hit = dc.best_overlap(a, b, shift)
            if hit:
                key = hit[1], hit[2], -(hit[0] + shift)
                found[d, i] = max(found.get((d, i), key), key)
    return {(d, i, -k[2], k[0], k[1]) for (d, i), k in found.items()}


def test_overlaps(spark):
    pick = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(pick.choices(vocabulary, k=pick.choice([3, 5, 7, 9, 10, 13, 30, 60])))) for i in range(40)]
    items += [(100, None), (101, ""), (3, items[3][1])]
    docs = []
    for d in range(150):
        body = pick.choices(vocabulary, k=pick.randrange(80))
        for _ in range(pick.randrange(4)):
            part = [w if pick.random() > 0.12 else "other" for w in (items[pick.randrange(40)][1] or "").split()]
            at = pick.randrange(len(body) + 1)
            body[at:at] = part[: pick.randrange(5, 70)]
        docs.append((d, " ".join(w.upper() + "###" if d % 7 == 0 else w for w in body)))
    docs += [(200, None), (201, ""), (5, docs[5][1])]
    got = dc.overlaps(
        spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string").repartition(4),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"),
    )
    expected = by_force(docs, items)
    rows = {tuple(r) for r in got.collect()}
    assert {r[:2] for r in rows} == {r[:2] for r in expected}
    assert rows == expected


def test_long_runs_of_hits_and_no_rows(spark):
    item = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(1, " ".join([item] * 200)), (2, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    row = dc.overlaps(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.first_word, r.n_words, r.n_equal) for r in row] == [(1, 9, 0, 40, 40)]
    assert dc.overlaps(docs.limit(0), items).count() == 0
    assert dc.overlaps(docs, items.limit(0)).count() == 0
    assert [r.doc_id for r in dc.clean(docs, items).collect()] == [2]


@pytest.mark.parametrize("length", [0, 3, 9, 10, 50])
def test_seeds_have_a_position_for_each_mask(length):
    found, at = dc.seeds(np.arange(1, length + 1, dtype=np.uint64), list(dc.MASKS))
    assert len(found) == len(at) == sum(max(0, length - m[-1]) for m in dc.MASKS)
