"""Vectors and nearest centroids against plain Python, accuracy on rows that training did not see, odd tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from floeline.llm import language as lg

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the river runs over old stones and under wooden bridge where children were playing games through night".split(),
    "de": "der fluss läuft über alte steine und unter einer brücke wo kinder spielten schöne straße größe".split(),
    "ru": "река течет через старые камни под деревянным мостом где играли дети ночью".split(),
}


def sequences(text):
    """The hashed sequences of a text, one at a time."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found = Counter()
    mask = 2**64 - 1
    for word in words:
        padded = [0, *map(ord, word), 0]
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                seq = padded[i : i + n]
                if (n == 1 and seq[0] == 0) or (n == 3 and seq[1] == 0):
                    continue
                value = 0
                for k, c in enumerate(seq, 1):
                    value = (value * 0x9E3779B97F4A7C15 + c + k) & mask
                value = ((value ^ (value >> 29)) * 0xBF58476D1CE4E5B9) & mask
                found[value >> 50] += 1
    return found


@pytest.mark.parametrize("text", ["a", "Das ist, 7 Mal; ÄÖÜ ß!", "x\ny--z", "日本語 テキスト", "Ünï ©ode  and   blanks ", "İstanbul ΣΑΣ"])
def test_counts(text):
    found = lg.counts(text)
    assert {int(b): int(found[b]) for b in np.flatnonzero(found)} == dict(sequences(text))


@pytest.mark.parametrize("text", [None, "", "  \n", "123 $$$ --", "²½"])
def test_no_letter(text):
    assert lg.counts(text) is None


def test_pieces_change_nothing(monkeypatch):
    text = " ".join(random.Random(1).choices(WORDS["de"] + ["1", "-", ",,"], k=500))
    whole = lg.counts(text)
    monkeypatch.setattr(lg, "PIECE", 37)
    assert (lg.counts(text) == whole).all()


def made(n=400, seed=2):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        lang = pick.choice(list(WORDS))
        rows.append((i, " ".join(pick.choices(WORDS[lang], k=pick.randrange(3, 60))), lang, "s", 0))
    return rows


def test_against_plain_python(spark):
    rows = made(60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    idf = lg.inverse_frequencies(lg.training(df))
    holding = Counter(b for r in train for b in sequences(r[1]))
    assert all(math.isclose(idf[b], math.log((1 + len(train)) / (1 + n)) + 1, rel_tol=1e-6) for b, n in holding.items())
    fitted = lg.centroids(lg.training(df), idf).collect()
    got = {r["doc_id"]: r for r in lg.predicted(df, at_once=2).collect()}
    for r in rows:
        weights = {b: (1 + math.log(n)) * float(idf[b]) for b, n in sequences(r[1]).items()}
        size = math.sqrt(sum(w * w for w in weights.values()))
        best = max(fitted, key=lambda c: sum(w * c["centroid"][b] for b, w in weights.items()))
        cosine = sum(w * best["centroid"][b] for b, w in weights.items()) / size
        assert abs(got[r[0]]["score"] - cosine) < 1e-5
        assert got[r[0]]["lang_pred"] == best["lang"] or cosine < 1e-5
        assert got[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 5 == 0)


def test_clusters_are_found():
    pick = np.random.default_rng(1)
    rows = np.concatenate([np.eye(4)[c] + 0.05 * np.abs(pick.normal(size=(30, 4))) for c in range(4)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centroids, owner = lg.clustered(rows, 4)
    assert len(centroids) == 4 and all(len(set(owner[30 * c : 30 * c + 30])) == 1 for c in range(4))
    assert len(lg.clustered(np.repeat(rows[:1], 5, axis=0), 4)[0]) == 1


def test_held_out_rows_of_the_small_table(spark, small):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lg.predicted(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got)
    assert len(got) > 150 and right / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_far_texts_are_rejected(spark):
    rows = [*made(), (1001, "ξένη γλώσσα που δεν έχει δει ποτέ", None, None, 0), (1002, "the river runs under old stones and children were playing games where the wooden bridge runs over", None, None, 0)]
    got = {r["doc_id"]: r for r in lg.predicted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1001]["rejected"] and not got[1002]["rejected"] and got[1002]["lang_pred"] == "en"
    assert sum(r["rejected"] for r in got.values()) < 20


def test_labels_are_no_input(spark):
    rows = made(80)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    other = [(i, t, "xx" if (i, t, lang, s, n) in held else lang, "other", n) for i, t, lang, s, n in rows]
    first, second = (sorted(map(tuple, lg.predicted(spark.createDataFrame(r, SCHEMA)).collect())) for r in (rows, other))
    assert first == second


def test_odd_rows(spark):
    rows = [*made(30), (None, "the river", "en", "s", 0), (501, None, "en", "s", 0), (502, "", None, None, None), (503, "12 !!", "de", "s", 0), (1, "der fluss", "de", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS lang_pred", "1 AS score", "2 AS reach")
    out = lg.predicted(df)
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in got if r["doc_id"] in (501, 502, 503))
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert lg.predicted(df.limit(0)).count() == 0
    nothing = lg.predicted(df.withColumn("lang", lg.F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and len(nothing) == len(rows)
