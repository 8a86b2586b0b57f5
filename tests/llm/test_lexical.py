"""Ranks against scoring every document in plain Python, blocks and skips, odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from floeline.llm import lexical as lx

DOCS = "doc_id long, text string, lang string, score string, rank int"
ITEMS = "item_id long, text string, doc_id string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return Counter(TERM.findall((text or "").translate(SMALL)))


def plain(docs, items, best=20):
    counted = [(i, terms(t)) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for key, text in sorted(set(items), key=str):
        scores = []
        for i, c, n in counted:
            m = 75 + (25 * n * n_docs) // length
            s = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, q in terms(text).items()
                if t in c
            )
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(key, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("text", ["", "The CAT's 2nd naïve_tëst\t\x00x", "ÀÉ Straße--日本 語", "a" * 50 + " B", None])
def test_terms(text):
    want = Counter({k.encode(): v for k, v in terms(text).items()})
    assert lx.term_counts(text.encode() if text is not None else None) == want


def test_pieces_change_nothing(monkeypatch):
    raw = " ".join(random.Random(1).choices(["one", "two", "Drei", "4,5"], k=400)).encode()
    whole = lx.term_counts(raw)
    monkeypatch.setattr(lx, "PIECE", 11)
    assert lx.term_counts(raw) == whole


def corpus(seed=3, n=400):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shares = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(pick.choices(vocabulary, shares, k=pick.randrange(1, 80)))) for i in range(n)]
    items = [(i, " ".join(pick.choices(vocabulary, shares, k=pick.randrange(1, 25)))) for i in range(30)]
    docs += [(1000 + i, items[i % 5][1] + " " + docs[i][1]) for i in range(40)]
    docs += [(2000 + i, docs[7][1]) for i in range(60)]  # a group of copies: ties
    return docs, items


@pytest.mark.parametrize("seed,best,shard,limit", [(3, 20, 4096, 2**20), (4, 5, 32, 2**20), (5, 20, 100, 600)])
def test_against_plain_python(spark, seed, best, shard, limit):
    docs, items = corpus(seed)
    d = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in docs], DOCS).repartition(4)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    assert got(lx.ranked(d, q, best=best, shard=shard, query_bytes=limit)) == plain(docs, items, best)


def test_skips_save_scores():
    docs, items = corpus(6, 3000)
    queries = lx.compiled([(i, t.encode()) for i, t in items])
    found = [lx.term_counts(t.encode()) for _, t in docs]
    n_docs, length = len(docs), sum(c.total() for c in found)
    parts = [[(queries.known[t], 10**9 * tf // (1000 * tf + 12 * (75 + 25 * c.total() * n_docs // length))) for t, tf in c.items() if t in queries.known] for c in found]
    ids = np.array([i for (i, _), p in zip(docs, parts, strict=True) if p])
    parts = [p for p in parts if p]
    shard = lx.Shard(ids, np.array([len(p) for p in parts]), np.array([t for p in parts for t, _ in p]), np.array([g for p in parts for _, g in p]), len(queries.known))
    holding, largest = np.bincount(shard.terms, minlength=shard.size), np.zeros(shard.size, dtype=np.int64)
    np.maximum.at(largest, shard.terms, shard.impacts)
    weight = lx.weights(holding, n_docs)
    none = np.zeros(len(items), dtype=np.int64)
    table = np.random.default_rng(1).normal(size=(shard.size, lx.DIRECTIONS)).astype(np.float32)

    def search(floors):
        plan = lx.planned(queries, weight, largest, floors, 20)
        best = lx.Best(plan)
        return lx.search_shard(shard, plan, weight, table, best, 0, len(items)), best

    every, first = search(none)
    floors = np.array([s[-1] if len(s) == 20 else 0 for s in first.scores])
    fewer, second = search(floors)
    assert fewer < 0.8 * every
    assert [s.tolist() for s in first.scores] == [s.tolist() for s in second.scores]
    assert [s.tolist() for s in first.docs] == [s.tolist() for s in second.docs]


def test_blocks_hold_every_row_once():
    pick = np.random.default_rng(1)
    directions = pick.normal(size=(500, 8)).astype(np.float32)
    for n in (1, 16, 17, 200):
        rows = np.sort(pick.choice(500, n, replace=False))
        order, starts = lx.blocks(rows, directions)
        assert sorted(order.tolist()) == rows.tolist()
        assert np.diff(np.append(starts, n)).max() <= lx.BLOCK and starts[0] == 0


def test_odd_rows(spark):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha"), (2, None), (3, ""), (4, "--- \n"), (5, "ALPHA gamma " * 3000), (6, "delta")]
    items = [(1, "alpha, beta"), (1, "alpha, beta"), (1, "gamma"), (None, "delta"), (2, None), (3, ""), (4, "unseen"), (5, "!!")]
    d = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    out = lx.ranked(d, q)
    assert got(out) == plain(docs, [(i, t or "") for i, t in items])
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    for docs_, items_ in ((d.limit(0), q), (d, q.limit(0)), (d.where("doc_id in (2, 3, 4)"), q)):
        empty = lx.ranked(docs_, items_)
        assert empty.count() == 0 and empty.columns == out.columns
