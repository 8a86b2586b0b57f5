"""Removed bytes against a comparison of all strings, and the interval tree against all substrings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter

from floeline.llm import decontamination, repeats
from floeline.sources import scratch


def by_force(docs):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by looking at every string of LENGTH bytes."""
    first = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in sorted(data):
        for s in range(len(b) - repeats.LENGTH + 1):
            first.setdefault(b[s : s + repeats.LENGTH], (d, s))
    rows = []
    for d, b in data:
        gone = np.zeros(len(b) + 2, dtype=bool)
        for s in range(len(b) - repeats.LENGTH + 1):
            if first[b[s : s + repeats.LENGTH]] < (d, s):
                gone[s + 1 : s + 1 + repeats.LENGTH] = True
        left = bytes(c for c, g in zip(b, gone[1:]) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum())
        rows.append((d, len(b), len(b) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return sorted(rows)


def corpus(seed):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choices("abcdeé", k=pick.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(pick.randrange(20, 120)) for _ in range(6)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(pick.randrange(1, 5)):
            kind = pick.randrange(5)
            if kind == 0:
                parts.append(text(pick.randrange(80)))
            elif kind < 3:
                parts.append(pick.choice(passages))
            elif kind == 3:
                p = pick.choice(passages)
                a, b = sorted(pick.choices(range(len(p)), k=2))
                parts.append(p[a:b] + text(2))
            else:
                parts.append(pick.choice(["it ", "a", "ab\n"]) * pick.randrange(20, 150))
        docs.append((d * 7 % 61, pick.choice(["", " ", "\n"]).join(parts)))
    docs += [(100, None), (101, ""), (102, docs[3][1]), (103, docs[3][1]), (104, docs[3][1][5:]), (105, "x" * 99), (106, "x" * 100), (107, "x" * 101)]
    base = text(300)
    for d in range(200, 230):
        at = pick.randrange(len(base))
        docs.append((d, base[:at] + "#" + base[at + 1 :]))
    return docs


@pytest.mark.parametrize("seed,hot,held,meet", [(1, 8_000, 1_000_000, 300_000), (2, 2, 500, 50), (3, 0, 1_000_000, 3)])
def test_removed(spark, monkeypatch, seed, hot, held, meet):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "MEET", meet)
    monkeypatch.setattr(repeats, "HELD", held)
    docs = corpus(seed)
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, doc string").repartition(5)
    got = sorted(tuple(r) for r in repeats.removed(frame).collect())
    assert got == by_force(docs)


def test_odd_ids(spark):
    same = "".join(random.Random(1).choices("abcdef ", k=400))
    frame = spark.createDataFrame([(None, same), (None, same), (1, same), (1, same)], "doc_id long, text string")
    rows = sorted((r.doc_id is None, r.n_removed) for r in repeats.removed(frame).collect())
    assert rows == [(False, 400), (False, 400), (True, 0), (True, 0)]
    assert repeats.removed(frame.limit(0)).count() == 0


@pytest.fixture
def written(spark, monkeypatch):
    """Rows of the staged tables by label; in tables with anchors those that have one."""
    rows, write = {}, DataFrameWriter.parquet

    def spy(self, path, *args, **kwargs):
        write(self, path, *args, **kwargs)
        frame, label = spark.read.parquet(path), path.rsplit("/", 1)[1].rsplit("-", 1)[0]
        rows[label] = rows.get(label, 0) + (frame.where("anchor is not null") if "anchor" in frame.columns else frame).count()

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    return rows


def test_contexts_of_meeting_classes_only(spark, monkeypatch, written):
    monkeypatch.setattr(decontamination, "FIELD_BITS", 1 << 12)  # as if there were more classes than any field holds
    pick = random.Random(4)
    text = lambda n: "".join(pick.choices("abcdefgh ", k=n))
    passages = [text(140) for _ in range(1500)]
    docs = [(d, "".join(text(250) + p for p in pick.sample(passages, 20))) for d in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in repeats.removed(frame).collect()) == by_force(docs)
    assert written["meeting"] > 5_000
    assert written["contexts"] == written["meeting"]


def test_hot_anchors_grow_with_their_classes(spark, monkeypatch, written):
    monkeypatch.setattr(repeats, "HOT", 40)
    pick = random.Random(5)
    text = lambda n: "".join(pick.choices("abcdefgh ", k=n))
    short, long_, cut = text(85), text(130), text(400)
    docs = [(d, text(200) + short + text(200) + long_ + text(200)) for d in range(300)]
    docs += [(d, text(90) + cut[a:] + text(90)) for d, a in zip(range(300, 400), pick.choices(range(300), k=100))]
    docs += [(d + 1000, t[150:450]) for d, t in docs[:30]]  # one neighbour of the line is copied as well
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in repeats.removed(frame).collect()) == by_force(docs)
    assert written["hot"] > 0
    assert written["contexts"] + written.get("parts", 0) < 4 * written["meeting"]


def test_shuffle_files_go_with_the_write(spark):
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before = held()
    staged, path = scratch.stage_alone(spark.range(1000).repartition(3, "id"), "test")
    assert held() <= before
    assert staged.count() == 1000
    assert spark.conf.get(scratch.FREED, "false") == "false"
    scratch.drop(spark, path)


def test_intervals_are_the_maximal_repeats():
    pick = random.Random(6)
    for _ in range(200):
        text = "".join(pick.choices("ab", k=pick.randrange(2, 40)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = [0]
        for a, b in zip(order, order[1:]):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            common.append(n)
        left = [ord(text[i - 1]) if i else -1 for i in order]
        got = {(text[order[a] : order[a] + n], b - a + 1) for n, a, b, _ in repeats.intervals(common, left, order)}
        expected = set()
        for s in {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}:
            at = [i for i in range(len(text)) if text.startswith(s, i)]
            if len(at) > 1 and len({text[i - 1 : i] for i in at}) > 1 and len({text[i + len(s) : i + len(s) + 1] for i in at}) > 1:
                expected.add((s, len(at)))
        # at the end of the text "no byte" differs from every byte, on the left as well
        assert got == expected


def test_window_hashes():
    data = np.frombuffer(b"abcabcabcd" * 30, dtype=np.uint8)
    for size in (1, 3, 32, 100):
        found = repeats.window_hashes(data, size)
        assert len(found) == len(data) - size + 1
        strings = [data[i : i + size].tobytes() for i in range(len(found))]
        assert len(set(strings)) == len(set(found.tolist())) == len(set(zip(strings, found.tolist())))


def test_registered_query(spark, small):
    from floeline.llm import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op9_repeated_passages(spark, small).collect())
    assert got == by_force(docs)
    assert sum(r[2] for r in got) > 0
